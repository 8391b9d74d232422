"""Forward-looking targets, cross-asset as-of features and the feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.windows import EPS, lag, lead, log_ratio, ordered, std

HORIZONS, VOL_HORIZONS = (1, 4, 24), (4, 24)


def forward_log_return(h: int) -> Column:
    return log_ratio(lead("close", h), F.col("close"))


def forward_volatility(h: int) -> Column:
    """Sample deviation of the next h one-row log returns (column __lr)."""
    ahead = ordered().rowsBetween(1, h)
    return F.when(F.count("__lr").over(ahead) >= h, F.stddev_samp("__lr").over(ahead))


def forward_zreturn(h: int, back: int = 24) -> Column:
    return forward_log_return(h) / (std("__lr", back) + F.lit(EPS))


def forward_direction(h: int) -> Column:
    r = forward_log_return(h)
    return F.when(r.isNotNull(), F.when(r >= 0, F.lit(1)).otherwise(F.lit(-1))).cast("tinyint")


def target_names() -> list[str]:
    out = [f"fwd_logret_{h}" for h in HORIZONS] + [f"fwd_zret_{h}" for h in HORIZONS] + [f"fwd_dir_{h}" for h in HORIZONS]
    return sorted(out + [f"fwd_vol_{h}" for h in VOL_HORIZONS])


def winsorized(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """columns clipped to exact quantiles of the whole asset (exact_quantiles()); one aggregate row per asset joins back."""
    q = exact_quantiles(df, columns, (low, high), ["asset"])
    cut = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"q_{c}")[0], F.least(F.col(f"q_{c}")[1], F.col(c)))) for c in columns}
    return df.join(q, "asset").withColumns(cut).drop(*[f"q_{c}" for c in columns])


def all_targets(candles: DataFrame, winsorize: bool = True) -> DataFrame:
    d = candles.withColumn("__lr", log_ratio(F.col("close"), lag("close")))
    cols = {f"fwd_logret_{h}": forward_log_return(h) for h in HORIZONS}
    cols |= {f"fwd_vol_{h}": forward_volatility(h) for h in VOL_HORIZONS}
    cols |= {f"fwd_zret_{h}": forward_zreturn(h) for h in HORIZONS}
    cols |= {f"fwd_dir_{h}": forward_direction(h) for h in HORIZONS}
    d = d.withColumns(cols).drop("__lr")
    return winsorized(d, [c for c in cols if not c.startswith("fwd_dir")]) if winsorize else d


def asof(left: DataFrame, right: DataFrame, values: list[str], by: list[str] | None = None, at: str = "timestamp") -> DataFrame:
    """left with the values of the latest right row at or before its time (backward as-of join).

    One union and one window, instead of a range join: right rows sort before left ones of the same time, and the
    last right row's values, as one struct, are carried on. Without `by` the rows pass one window; give keys, or use
    asof_bucketed() for a long common reference.
    """
    keys = by or []
    names = left.columns
    l = left.withColumns({"__side": F.lit(1), "__ref": F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType)})
    r = right.select(*keys, at, F.lit(0).alias("__side"), F.struct(*values).alias("__ref"))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__got", F.last("__ref", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*names, *[F.col(f"__got.{v}").alias(v) for v in values])


def asof_bucketed(left: DataFrame, right: DataFrame, values: list[str], segment: str = "day", at: str = "timestamp") -> DataFrame:
    """asof() without keys, cut into segments of time: each segment's window starts from the last right row before it."""
    seg = F.date_trunc(segment, at)
    ref = F.struct(*values)
    r = right.select(seg.alias("__seg"), at, ref.alias("__ref"))
    ends = r.groupBy("__seg").agg(F.max_by("__ref", at).alias("__end"))
    segs = left.select(seg.alias("__seg")).union(r.select("__seg")).distinct()
    w = Window.orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)  # one row per segment
    starts = segs.join(ends, "__seg", "left").select("__seg", F.last("__end", ignorenulls=True).over(w).alias("__start"))
    l = left.withColumns({"__side": F.lit(1), "__seg": seg, "__ref": F.lit(None).cast(r.schema["__ref"].dataType)})
    both = l.unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy("__seg").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__got", F.last("__ref", ignorenulls=True).over(inside)).filter("__side = 1").join(starts, "__seg", "left")
    got = got.withColumn("__got", F.coalesce("__got", "__start"))
    return got.select(*left.columns, *[F.col(f"__got.{v}").alias(v) for v in values])


def cross_asset_names() -> list[str]:
    return sorted(["btc_logret", "btc_rv", "btc_dir"])


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """The columns that after has and before has not, sorted."""
    return sorted(set(after.columns) - set(before.columns))


def is_reference(asset: str, reference: str = "BTCUSDT") -> bool:
    return asset.upper() == reference


def cross_asset(candles: DataFrame, reference: str, vol: int = 24) -> DataFrame:
    """The other assets' candles with the reference's return, volatility and direction as of their time, one row late."""
    ref = candles.filter(F.col("asset") == reference).withColumn("__lr", log_ratio(F.col("close"), lag("close")))
    ref = ref.withColumns({"btc_logret": F.col("__lr"), "btc_rv": std("__lr", vol)})
    ref = ref.withColumn("btc_dir", F.when(F.col("__lr").isNotNull(), F.when(F.col("__lr") >= 0, 1).otherwise(-1)))
    names = ["btc_logret", "btc_rv", "btc_dir"]
    got = asof_bucketed(candles.filter(F.col("asset") != reference), ref.select("timestamp", *names), names)
    return got.select(*candles.columns, *[lag(c).alias(c) for c in names])


def feature_matrix(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows without a null in the required columns; NaN stays."""
    for c in required:
        df = df.filter(F.col(c).isNotNull())
    return df


