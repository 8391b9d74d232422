"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g --conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell")

from tidemark.plans.catalogue import QUERIES  # noqa: E402
from tidemark.session import session  # noqa: E402

HEADLINE = (
    "ohlcv_resample", "ohlcv_daily_lineitem", "bars_tick", "bars_volume", "bars_dollar", "bars_volume_imbalance", "bars_volume_run", "ind_rv",
    "ind_ewm", "ind_slope", "targets_winsorized", "btc_lagged_asof", "reco_features", "rolling_perm_entropy", "backtest_equity", "cost_sweep",
    "perf_ratios", "cpcv_folds", "stat_ljung_box", "stat_bh", "cls_auc", "reg_qlike_mz", "gap_detection", "volume_profile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    out, sys.stdout = sys.stdout, sys.stderr
    spark = session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["ohlcv_resample"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    seconds = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}), file=out)


if __name__ == "__main__":
    main()
