"""The candle and bar stores: keyed tables with insert-or-ignore, half-open scans and catalogue queries.

Tables are parquet, partitioned by their leading keys, so a scan of one asset prunes to its files and the time
range is pushed to the reader.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialize

_MONEY = T.DecimalType(18, 8)
OHLCV = T.StructType(
    [T.StructField("asset", T.StringType()), T.StructField("timeframe", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, _MONEY) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.DoubleType())]
)
BARS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("asset", "bar_type", "bar_config_hash")]
    + [T.StructField(c, T.TimestampType()) for c in ("start_ts", "end_ts")]
    + [T.StructField(c, _MONEY) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.DoubleType()), T.StructField("tick_count", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("buy_volume", "sell_volume")]
    + [T.StructField("vwap", _MONEY)]
)
CANDLE_KEY = ("asset", "timeframe", "timestamp")
BAR_KEY = ("asset", "bar_type", "bar_config_hash", "start_ts")


def create(spark: SparkSession, name: str, schema: T.StructType, by: Sequence[str]) -> None:
    spark.createDataFrame([], schema).write.partitionBy(*by).mode("ignore").saveAsTable(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def fresh(batch: DataFrame, stored: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows of batch that insert-or-ignore would add: the first of each key by `order`, if the key is not stored."""
    w = Window.partitionBy(*key).orderBy(*(order or [F.monotonically_increasing_id()]))
    first = batch.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")
    return first.join(stored.select(*key), list(key), "left_anti").select(*batch.columns)


def ingest_by(batch: DataFrame, name: str, key: Sequence[str], by: Sequence[str]) -> dict[tuple, int]:
    """Append the fresh rows of batch to table `name`, partitioned by `by`; the number of rows added to each of its partitions.

    The batch, and then its fresh rows, are written to the shared folder first: they are fixed sets of rows, and a source is
    read once. Only the stored rows of the batch's partitions and span of the key's last column are read.
    """
    fixed = materialize(batch)
    stored, at = batch.sparkSession.table(name), key[-1]
    low, high = fixed.agg(F.min(at), F.max(at)).first()
    if low is None:
        discard(fixed)
        return {}
    near = stored.filter(F.col(at).between(F.lit(low), F.lit(high))).join(fixed.select(*by).distinct(), list(by), "left_semi")
    rows = materialize(fresh(fixed, near, key).select(*stored.columns))
    added = {tuple(r[:-1]): r[-1] for r in rows.groupBy(*by).count().collect()}
    if added:
        rows.write.mode("append").insertInto(name)
    discard(fixed, rows)
    return added


def ingest(batch: DataFrame, name: str, key: Sequence[str], by: Sequence[str]) -> int:
    """ingest_by() in all."""
    return sum(ingest_by(batch, name, key, by).values())


def ingest_parquet(spark: SparkSession, path: str, asset: str, timeframe: str, name: str) -> int:
    rows = spark.read.parquet(path).select(F.lit(asset).alias("asset"), F.lit(timeframe).alias("timeframe"), "timestamp", *[F.col(c).cast(_MONEY) for c in ("open", "high", "low", "close")], F.col("volume").cast("double"))
    return ingest(rows, name, CANDLE_KEY, ("asset", "timeframe"))


def ingest_csv(spark: SparkSession, path: str, asset: str, timeframe: str, name: str) -> int:
    """CSV with a header and the columns timestamp, open, high, low, close, volume."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(F.lit(asset).alias("asset"), F.lit(timeframe).alias("timeframe"), F.to_timestamp("timestamp").alias("timestamp"), *[F.col(c).cast(_MONEY) for c in ("open", "high", "low", "close")], F.col("volume").cast("double"))
    return ingest(rows, name, CANDLE_KEY, ("asset", "timeframe"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def scan(df: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None, at: str = "timestamp", **equal: str) -> DataFrame:
    """Rows with the given key values and start <= at < end."""
    for k, v in equal.items():
        df = df.filter(F.col(k) == v)
    kind = df.schema[at].dataType
    if start is not None:
        df = df.filter(F.col(at) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(at) < F.lit(end).cast(kind))
    return df


def scan_split(df: DataFrame, split: dict[str, tuple[str, str]], part: str, **equal: str) -> DataFrame:
    return scan(df, *split[part], **equal)


def scan_assets(df: DataFrame, assets: Sequence[str], start=None, end=None) -> DataFrame:
    return scan(df.filter(F.col("asset").isin(*assets)), start, end)


def assets(df: DataFrame) -> DataFrame:
    return df.select("asset").distinct()


def configs(df: DataFrame) -> DataFrame:
    return df.select("bar_type", "bar_config_hash").distinct()


def date_range(df: DataFrame, at: str = "timestamp", widen: bool = True) -> DataFrame:
    """(start, end) of each asset; a range of one moment ends a second later, unless widen is off."""
    r = df.groupBy("asset").agg(F.min(at).alias("start"), F.max(at).alias("end"))
    if widen:
        r = r.withColumn("end", F.when(F.col("start") == F.col("end"), F.col("end") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("end")))
    return r


def count_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


def count_by_config(bars: DataFrame, **equal: str) -> DataFrame:
    """(asset, bar_type, bar_config_hash, n) of the stored bars, of those with the given key values."""
    for k, v in equal.items():
        bars = bars.filter(F.col(k) == v)
    return bars.groupBy("asset", "bar_type", "bar_config_hash").agg(F.count(F.lit(1)).alias("n"))


def latest_end(bars: DataFrame) -> DataFrame:
    return bars.groupBy("asset").agg(F.max("end_ts").alias("latest"))


def delete(spark: SparkSession, name: str, asset: str, bar_type: str, config: str) -> int:
    """Remove one asset's bars of one configuration; the number of rows that were there."""
    own = (F.col("asset") == asset) & (F.col("bar_type") == bar_type) & (F.col("bar_config_hash") == config)
    n = spark.table(name).filter(own).count()
    if n:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (asset='{asset}', bar_type='{bar_type}', bar_config_hash='{config}')")
    return n


def since_high_water(batch: DataFrame, stored: DataFrame, start: str) -> DataFrame:
    """The incremental part of batch: per asset from the later of `start` and the stored maximum less one second.

    One row per asset is broadcast only if the planner finds it small. Whatever is read again is ignored on insert.
    """
    top = stored.groupBy("asset").agg((F.max("timestamp") - F.expr("INTERVAL 1 SECOND")).alias("__mark"))
    kind = batch.schema["timestamp"].dataType
    low = F.greatest(F.lit(start).cast(kind), F.col("__mark"))
    return batch.join(top, "asset", "left").filter(F.col("timestamp") >= low).drop("__mark")
