"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their schema."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"model_calibrated", "model_boosted", "model_forest", "model_reg_boosted", "model_reg_huber", "model_logistic"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or str(v) == "<NA>":
            return "null"
        if isinstance(v, bool) or str(type(v)).find("bool") >= 0:
            return str(bool(v))
        if isinstance(v, (pd.Timestamp,)):
            return str(v)
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_has_values(spark, sf, name):
    """Queries without SQL: rows, finite numbers in every numeric column that is not optional, shares and p-values in range."""
    df = QUERIES[name](spark, sf).toPandas()
    assert len(df) and len(set(df.columns)) == len(df.columns)
    for c in df.select_dtypes("number"):
        v = df[c].dropna()
        assert len(v) or c in OPTIONAL
        if c in ("p", "p_adj", "covered", "coverage", "deploy_rate", "stable_share", "confidence") or c.endswith("_p"):
            assert ((v >= 0) & (v <= 1)).all()


#: Columns that a small table may leave empty.
OPTIONAL = {"nu", "skew", "deploy_precision", "mean_deployed", "hurst_100", "profit_factor"}
