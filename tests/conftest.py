import os

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g --conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell")

import pytest  # noqa: E402

from tidemark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    own = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", 4, **{"spark.sql.warehouse.dir": str(own / "warehouse"), "spark.checkpoint.dir": f"file://{own}/shared"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
