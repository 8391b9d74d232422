"""Rule strategies: side (long, short, flat) and strength in [0, 1] of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import EPS, clip, lag, mean, rolling, std


def _signals(df: DataFrame, long: Column, short: Column | None, strength: Column) -> DataFrame:
    """A null condition is no signal."""
    side = F.when(long, F.lit("long"))
    if short is not None:
        side = side.when(short, F.lit("short"))
    active = long if short is None else (F.coalesce(long, F.lit(False)) | F.coalesce(short, F.lit(False)))
    return df.withColumns({"side": side.otherwise(F.lit("flat")), "strength": F.when(active, strength).otherwise(F.lit(0.0))})


def donchian(df: DataFrame, n: int = 20, atr: str = "atr_14") -> DataFrame:
    d = df.withColumn("__high1", lag("high"))
    d = d.withColumn("__top", rolling(F.max("__high1"), F.col("__high1"), n))
    up = F.col("close") > F.col("__top")
    return _signals(d, up, None, clip((F.col("close") - F.col("__top")) / (F.col(atr) + EPS), 0.0, 1.0)).drop("__high1", "__top")


def mean_reversion(df: DataFrame, n: int = 20, k: float = 2.5, regime: str = "hurst_100", limit: float = 0.5) -> DataFrame:
    d = df.withColumns({"__mid": mean("close", n), "__dev": std("close", n)})
    low, high = F.col("__mid") - k * F.col("__dev"), F.col("__mid") + k * F.col("__dev")
    ok = F.col(regime) < limit
    below, above = ok & (F.col("close") < low), ok & (F.col("close") > high)
    width = high - low + EPS
    strength = F.when(F.col("close") < low, clip((low - F.col("close")) / width, 0.0, 1.0)).otherwise(clip((F.col("close") - high) / width, 0.0, 1.0))
    return _signals(d, below, above, strength).drop("__mid", "__dev")


def momentum(df: DataFrame, column: str = "ema_xover_8_21", limit: float = 0.0) -> DataFrame:
    x = F.col(column)
    return _signals(df, x > limit, x < -limit, clip(F.abs(x), 0.0, 1.0))


def no_trade(df: DataFrame, entropy: float, column: str = "rv_24", entropy_limit: float = 0.98, low_vol: float = 0.01) -> DataFrame:
    calm = F.lit(1.0) if entropy > entropy_limit else F.when(F.col(column) < low_vol, 1.0).otherwise(0.0)
    return df.withColumns({"side": F.lit("flat"), "strength": calm})


def vol_target(df: DataFrame, target: float = 0.15, column: str = "rv_24") -> DataFrame:
    return df.withColumns({"side": F.lit("long"), "strength": clip(target / (F.col(column) + EPS), 0.0, 1.0)})
