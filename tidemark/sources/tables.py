"""Candles and trades from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resample(trades: DataFrame, every: str = "hour") -> DataFrame:
    """OHLCV candles of trades(asset, timestamp, seq, price, size): one row per asset and `every`.

    Partial aggregates only; the first and last price are those of the least and greatest (timestamp, seq).
    """
    at = F.date_trunc(every, "timestamp").cast("timestamp_ntz")
    order = F.struct("timestamp", "seq")
    return trades.groupBy("asset", at.alias("timestamp")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").cast("double").alias("volume"),
    )


def trades_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("asset"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.col("user_id").alias("size"),
    )


def candles(spark: SparkSession, sf_dir: str, every: str = "hour") -> DataFrame:
    """Hourly candles of `events`: asset = event_type, price = value, volume = sum of user_id."""
    return resample(trades_of_events(spark, sf_dir), every)


def raw_candles(batch: DataFrame) -> DataFrame:
    """Candles of a raw kline table (open_ms, open, high, low, close, volume as text)."""
    money = lambda c: F.col(c).cast("decimal(18,8)").alias(c)
    return batch.select(
        F.timestamp_millis("open_ms").alias("timestamp"), money("open"), money("high"), money("low"), money("close"),
        F.col("volume").cast("double").alias("volume"),
    )
