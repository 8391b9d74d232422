"""Ingest and aggregation jobs, and their command lines."""

from __future__ import annotations

import argparse
import time
import uuid
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from . import paged, store
from .paged import INTERVALS

#: Thresholds that a bar type has unless another is given.
THRESHOLDS = {"tick": 1000.0, "volume": 1000.0, "dollar": 1_000_000.0, "tick_imbalance": 100.0, "volume_imbalance": 1000.0, "dollar_imbalance": 1_000_000.0, "tick_run": 100.0, "volume_run": 1000.0, "dollar_run": 1_000_000.0}

Call = Callable[[str, str, int], list[list]]


class Paging:
    """A transport of a call without a page size: call(asset, timeframe, cursor) gives a page."""

    def __init__(self, call: Call):
        self.call = call

    def __call__(self, asset: str, timeframe: str, open_ms: int, limit: int) -> list[list]:
        return self.call(asset, timeframe, open_ms)


def ingest_asset(spark: SparkSession, call: Call, name: str, asset: str, timeframe: str, start_ms: int, end_ms: int, incremental: bool = False, **kw) -> int:
    """ingest_universe() of one asset and timeframe: the number of candles added."""
    return ingest_universe(spark, call, name, [asset], [timeframe], start_ms, end_ms, incremental, **kw)[asset, timeframe]


def ingest_universe(
    spark: SparkSession, call: Call, name: str, assets: list[str], timeframes: list[str], start_ms: int, end_ms: int, incremental: bool = False, pause: Callable[[float], None] = time.sleep, **options
) -> dict[tuple[str, str], int]:
    """Page in the candles of all assets and timeframes in one plan and insert those whose key is new; the number added for each.

    Tasks page through assets and slices of time side by side, and candles go from them to the table. incremental: each
    pair from its stored maximum less a second, if that is later; a pair that is stored to end_ms is not asked for.
    """
    starts = dict.fromkeys(product(assets, timeframes), start_ms)
    if incremental:
        own = spark.table(name).filter(F.col("asset").isin(assets) & F.col("timeframe").isin(timeframes))
        top = own.groupBy("asset", "timeframe").agg(F.max(F.unix_millis(F.col("timestamp").cast("timestamp"))).alias("ms"))
        starts |= {(a, t): max(start_ms, ms - 1000) for a, t, ms in top.collect()}
    done = dict.fromkeys(starts, 0)
    if any(ms < end_ms for ms in starts.values()):
        source = f"tidemark_pages_{uuid.uuid4().hex}"
        paged.register(spark, source, Paging(call), pause)
        got = paged.candles(spark, source, assets, timeframes, starts, end_ms, **options)
        done |= store.ingest_by(got, name, store.CANDLE_KEY, ("asset", "timeframe"))
    return done


def aggregate(candles: DataFrame, bar_types: list[str], threshold: float = 0.0) -> dict[str, DataFrame]:
    """Bars of each type for all assets of candles at once; a threshold above 0 replaces every type's own."""
    return {t: B.bars(candles, t, threshold if threshold > 0 else THRESHOLDS[t]) for t in bar_types}


def ingest_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark-ingest", description="Store candles of a paged source")
    p.add_argument("--assets", nargs="+", required=True)
    p.add_argument("--timeframes", nargs="+", default=["1h"], choices=sorted(INTERVALS))
    p.add_argument("--start", required=True, help="date or time, UTC")
    p.add_argument("--end", required=True, help="date or time, UTC, exclusive")
    p.add_argument("--table", default="ohlcv")
    p.add_argument("--incremental", action="store_true")
    p.add_argument("--log-level", default="WARN")
    return p


def bars_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark-bars", description="Aggregate stored candles into bars")
    p.add_argument("--assets", nargs="+", required=True)
    p.add_argument("--bar-types", nargs="+", default=["volume"], choices=sorted(THRESHOLDS))
    p.add_argument("--threshold", type=float, default=0.0, help="above 0: for all types")
    p.add_argument("--timeframe", default="1h")
    p.add_argument("--source", default="ohlcv")
    p.add_argument("--out", required=True, help="folder, one parquet table for each type")
    return p


def _milliseconds(text: str) -> int:
    from datetime import UTC, datetime

    at = datetime.fromisoformat(text)
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def main_ingest(spark: SparkSession, call: Call, argv: list[str] | None = None) -> dict[tuple[str, str], int]:
    a = ingest_parser().parse_args(argv)
    spark.sparkContext.setLogLevel(a.log_level)
    return ingest_universe(spark, call, a.table, a.assets, a.timeframes, _milliseconds(a.start), _milliseconds(a.end), a.incremental)


def main_bars(spark: SparkSession, argv: list[str] | None = None) -> list[str]:
    """Write the bars of each type; the paths written."""
    a = bars_parser().parse_args(argv)
    rows = spark.table(a.source).filter(F.col("asset").isin(*a.assets) & (F.col("timeframe") == a.timeframe))
    floats = rows.select("asset", "timestamp", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    out = []
    for t, bars in aggregate(floats, a.bar_types, a.threshold).items():
        out.append(f"{a.out.rstrip('/')}/{t}")
        bars.write.mode("overwrite").parquet(out[-1])
    return out
