"""Structured Streaming forms of ingest, time bars and adaptive bars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: tuple[str, ...] = ("asset", "timestamp"), late: str = "1 day"):
    """Append each key once: duplicates within `late` of the watermark are dropped by state, as insert-or-ignore does."""
    once = stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(list(key))
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def time_bars(trades: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Candles of (asset, timestamp, seq, price, size) in event time; a window comes out once the watermark has passed it."""
    order = F.struct("timestamp", "seq")
    g = trades.withWatermark("timestamp", late).groupBy("asset", F.window("timestamp", every))
    return g.agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").cast("double").alias("volume")
    ).select("asset", F.col("window.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def imbalance_bars(candles: DataFrame, threshold: float, ewm_span: int = 100, warmup: int = 100) -> DataFrame:
    """(asset, bar_id, end_ts, imbalance) of volume imbalance bars: the fold's state (sum, threshold, bars) is kept by asset.

    Rows of a micro-batch are sorted by time first; rows that come later than those already folded count when they come.
    """
    alpha = 2.0 / (ewm_span + 1)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, limit, bar = state.get if state.exists else (0.0, threshold, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("timestamp", kind="stable")
        for t, o, c, v in zip(rows["timestamp"], rows["open"], rows["close"], rows["volume"]):
            total += v if c >= o else -v
            if abs(total) >= limit:
                out.append((key[0], bar, t, total))
                bar += 1
                if bar >= warmup:
                    limit = alpha * abs(total) + (1 - alpha) * limit
                total = 0.0
        state.update((total, limit, bar))
        yield pd.DataFrame(out, columns=["asset", "bar_id", "end_ts", "imbalance"])

    return candles.groupBy("asset").applyInPandasWithState(
        fold, "asset string, bar_id long, end_ts timestamp, imbalance double", "total double, threshold double, bars long", "append", GroupStateTimeout.NoTimeout
    )
