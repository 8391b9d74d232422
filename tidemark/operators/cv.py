"""Row-position splits: walk-forward windows, purged combinatorial folds, label uniqueness."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import ordered


def positioned(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(ordered()) - 1)


def walk_forward(sizes: DataFrame, train: int, test: int, step: int | None = None, expanding: bool = True) -> DataFrame:
    """Window bounds for each row of sizes(asset, n): training [train_start, test_start), test [test_start, test_end)."""
    step = step or test
    last = F.floor((F.col("n") - train - test) / step)
    w = sizes.filter(F.col("n") >= train + test).withColumn("window", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    start = F.lit(train) + F.col("window") * step
    return w.select("asset", "window", (F.lit(0) if expanding else start - train).cast("int").alias("train_start"), start.alias("test_start"), (start + test).alias("test_end"))


def pipeline_splits(n: int, windows: int = 5, ratio: float = 0.6, purge: int = 10, embargo: int = 5) -> list[tuple[int, int, int, int]]:
    """(train_start, train_end, test_start, test_end) of expanding windows after the first `ratio`; rounds half to even."""
    first = int(n * ratio)
    if first < 2 or n - first <= purge + embargo:
        raise ValueError("too few rows")
    points = [round(first + i * (n - first) / windows) for i in range(windows + 1)]
    out = [(0, a, a + purge + embargo, b) for a, b in zip(points, points[1:]) if a + purge + embargo < b and a >= 2]
    if not out:
        raise ValueError("no window is left")
    return out


def window_splits(sizes: DataFrame, windows: int = 5, ratio: float = 0.6, purge: int = 10, embargo: int = 5) -> DataFrame:
    """pipeline_splits() of each row of sizes(asset, n): (asset, window, train_start, train_end, test_start, test_end). An asset with
    too few rows has none."""
    gap = purge + embargo
    first = F.floor(F.col("n") * F.lit(ratio)).cast("int")
    at = lambda i: F.bround(first + i * (F.col("n") - first) / windows).cast("int")  # noqa: E731  rounds half to even
    w = sizes.filter((first >= 2) & (F.col("n") - first > gap)).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    w = w.withColumns({"train_end": at(F.col("__i")), "test_end": at(F.col("__i") + 1)}).filter((F.col("train_end") >= 2) & (F.col("train_end") + gap < F.col("test_end")))
    nth = F.row_number().over(Window.partitionBy("asset").orderBy("__i")) - 1
    return w.select("asset", nth.alias("window"), F.lit(0).alias("train_start"), "train_end", (F.col("train_end") + gap).alias("test_start"), "test_end")


def with_blocks(df: DataFrame, blocks: int = 6) -> DataFrame:
    """positioned rows with their contiguous block; the first n mod blocks blocks have a row more."""
    n = df.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    q, r = F.floor(F.col("n") / blocks), F.col("n") % blocks
    big = r * (q + 1)
    block = F.when(F.col("pos") < big, F.floor(F.col("pos") / (q + 1))).otherwise(r + F.floor(F.try_divide(F.col("pos") - big, q)))
    return df.join(n, "asset").withColumn("block", block.cast("int"))


def cpcv(df: DataFrame, blocks: int = 6, purge: int = 1, embargo: int = 1, after_only: bool = False, k: int = 2) -> DataFrame:
    """(asset, fold, pos, part): all folds that test k of the blocks; training rows within purge + embargo of a tested
    block's edge are left out (after_only: the embargo counts behind it only).

    A fold's tested blocks are an interval each, so purging is a join with their bounds, a few rows an asset.
    """
    spark: SparkSession = df.sparkSession
    rows = with_blocks(positioned(df.select("asset", "timestamp")), blocks).select("asset", "pos", "block")
    edges = rows.groupBy("asset", "block").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    folds = spark.createDataFrame([(i, b) for i, c in enumerate(combinations(range(blocks), k)) for b in c], "fold int, block int")
    bounds = edges.join(F.broadcast(folds), "block").groupBy("asset", "fold").agg(F.collect_list(F.struct("lo", "hi")).alias("tested"))
    before, after = purge + (0 if after_only else embargo), purge + embargo
    each = rows.join(bounds, "asset")
    inside = F.exists("tested", lambda b: (F.col("pos") >= b["lo"]) & (F.col("pos") <= b["hi"]))
    close = F.exists("tested", lambda b: (F.col("pos") >= b["lo"] - before) & (F.col("pos") <= b["hi"] + after))
    part = F.when(inside, "test").when(close, "purged").otherwise("train")
    return each.select("asset", "fold", "pos", part.alias("part"))


def uniqueness(df: DataFrame, horizon: int) -> DataFrame:
    """(asset, pos, uniqueness): mean over a label's span [pos, pos + horizon) of one by the labels alive there.

    At place t min(t + 1, horizon, n + horizon - 1 - t) labels are alive, so no matrix and no join of spans is needed.
    """
    rows = positioned(df.select("asset", "timestamp"))
    n = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    at = lambda t: F.least(t + 1, F.lit(horizon), F.col("n"), F.col("n") + horizon - 1 - t)
    span = F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / at(F.col("pos") + k))
    return rows.join(n, "asset").select("asset", "pos", (span / horizon).alias("uniqueness"))


def effective_n(weights: DataFrame, w: str = "uniqueness") -> DataFrame:
    return weights.groupBy("asset").agg(F.try_divide(F.sum(w) * F.sum(w), F.sum(F.col(w) * F.col(w))).alias("n_eff"))


def non_overlapping(df: DataFrame, horizon: int) -> DataFrame:
    return positioned(df).filter(F.col("pos") % horizon == 0)


def purge_by_time(df: DataFrame, window: float) -> DataFrame:
    """df(asset, fold, timestamp, part) with the training rows within `window` seconds of a tested segment marked purged.

    A fold's tested segments break where the step between its tested rows is above twice their median step; a segment is one
    row of (low, high), so the purge is a join with few bounds.
    """
    t = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    tested = df.filter("part = 'test'").select("asset", "fold", t.alias("t"))
    w = Window.partitionBy("asset", "fold").orderBy("t")
    gaps = tested.withColumn("gap", F.col("t") - F.lag("t").over(w))
    median = gaps.groupBy("asset", "fold").agg(F.percentile("gap", F.lit(0.5)).alias("m"))
    cut = gaps.join(median, ["asset", "fold"]).withColumn("new", F.coalesce((F.col("gap") > 2 * F.col("m")).cast("int"), F.lit(0)))
    parts = cut.withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = parts.groupBy("asset", "fold", "segment").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    bounds = bounds.groupBy("asset", "fold").agg(F.collect_list(F.struct("low", "high")).alias("__tested"))
    near = F.exists("__tested", lambda b: (t >= b["low"] - window) & (t <= b["high"] + window))
    out = df.join(bounds, ["asset", "fold"], "left")
    return out.withColumn("part", F.when((F.col("part") == "train") & F.coalesce(near, F.lit(False)), "purged").otherwise(F.col("part"))).drop("__tested")
