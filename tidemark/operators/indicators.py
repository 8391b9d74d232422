"""Causal technical indicators: expressions over an asset's candles in time order."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import EPS, clip, ewm, lag, log_ratio, mean, ordered, slope, std, upto, zscore


def _c(name: str) -> Column:
    return F.col(name)


def log_return(n: int = 1) -> Column:
    return log_ratio(_c("close"), lag("close", n))


def garman_klass(n: int) -> Column:
    x = 0.5 * F.pow(log_ratio(_c("high"), _c("low")), F.lit(2.0)) - (2 * log(2) - 1) * F.pow(log_ratio(_c("close"), _c("open")), F.lit(2.0))
    return F.sqrt(mean(x, n))


def parkinson(n: int) -> Column:
    return F.sqrt(mean(F.pow(log_ratio(_c("high"), _c("low")), F.lit(2.0)) / (4 * log(2)), n))


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.abs(_c("high") - _c("low")), F.abs(_c("high") - before), F.abs(_c("low") - before))


def roc(n: int) -> Column:
    return F.try_divide(_c("close"), lag("close", n)) - 1


def amihud(n: int, ret: str = "__lr") -> Column:
    return mean(F.abs(_c(ret)) / (_c("close") * _c("volume") + EPS), n)


def bollinger_pct(n: int, k: float) -> Column:
    mid, dev = mean("close", n), std("close", n)
    return F.try_divide(_c("close") - (mid - k * dev), 2 * k * dev + EPS)


def bollinger_width(n: int, k: float) -> Column:
    return F.try_divide(2 * k * std("close", n), mean("close", n) + EPS)


def obv() -> Column:
    return F.sum(_c("volume") * F.signum(_c("close") - lag("close"))).over(upto())


def with_steps(df: DataFrame) -> DataFrame:
    """df with the row number __rn, the one-row log return __lr and the true range __tr."""
    return df.withColumns({"__rn": F.row_number().over(ordered()).cast("double"), "__lr": log_return(1), "__tr": true_range(), "__dv": _c("volume") * F.signum(_c("close") - lag("close"))})


def rolling_columns() -> dict[str, Column]:
    """The indicators that are plain windows over with_steps()."""
    out = {f"logret_{n}": log_return(n) for n in (1, 4, 12, 24)}
    out |= {f"rv_{n}": std("__lr", n) for n in (12, 24, 48)}
    out |= {"gk_vol_24": garman_klass(24), "park_vol_24": parkinson(24)}
    out |= {f"roc_{n}": roc(n) for n in (1, 4, 12)}
    out |= {"vol_zscore_24": zscore("volume", 24), "amihud_24": amihud(24), "ret_zscore_24": zscore("__lr", 24)}
    out |= {"bbpctb_20_2": bollinger_pct(20, 2.0), "bbwidth_20_2": bollinger_width(20, 2.0)}
    out |= {"slope_14": slope(_c("close"), _c("__rn"), 14)}
    return out


def with_obv_slope(df: DataFrame, n: int = 14) -> DataFrame:
    """df (of with_steps) with obv_slope: the slope of the running signed volume, null on the first row."""
    step = df.withColumn("__obv", F.when(_c("__dv").isNotNull(), F.sum("__dv").over(upto())))
    return step.withColumn(f"obv_slope_{n}", slope(_c("__obv"), _c("__rn"), n)).drop("__obv")


def with_ewm(df: DataFrame) -> DataFrame:
    """df (of with_steps) with atr_14, ema_xover_8_21 and rsi_14."""
    change = _c("close") - lag("close")
    d = df.withColumns({"__gain": F.greatest(change, F.lit(0.0) * change), "__loss": F.greatest(-change, F.lit(0.0) * change)})
    d = ewm(
        d, __fast=("close", 2 / 9), __slow=("close", 2 / 22), atr_14=("__tr", 1 / 14), __up=("__gain", 1 / 14), __down=("__loss", 1 / 14)
    )
    rs = F.try_divide(_c("__up"), _c("__down") + EPS)
    return d.withColumns({"ema_xover_8_21": (_c("__fast") - _c("__slow")) / (_c("atr_14") + EPS), "rsi_14": 100 - 100 / (1 + rs)}).drop(
        "__gain", "__loss", "__fast", "__slow", "__up", "__down"
    )


def hurst_rs(x: np.ndarray, least: int = 10) -> float:
    """Hurst exponent by rescaled range: slope of ln(mean R/S) on ln(block size), between 0 and 1; NaN with few sizes."""
    n = len(x)
    sizes, means = [], []
    for size in range(least, n // 2 + 1):
        blocks = x[: n // size * size].reshape(-1, size)
        dev = blocks.std(axis=1, ddof=1)
        walk = (blocks - blocks.mean(axis=1, keepdims=True)).cumsum(axis=1)
        ok = dev >= EPS
        if ok.any():
            rs = ((walk.max(axis=1) - walk.min(axis=1))[ok] / dev[ok]).mean()
            if rs > 0:
                sizes.append(np.log(size))
                means.append(np.log(rs))
    if len(sizes) < 3:
        return float("nan")
    return float(np.clip(np.polyfit(sizes, means, 1)[0], 0.0, 1.0))


def with_hurst(df: DataFrame, n: int = 100, rows: int = 256) -> DataFrame:
    """df with hurst_n: hurst_rs() of the last n closes.

    An asset's rows are cut into segments of `rows`, each with the n - 1 rows before it, so a kernel holds one segment.
    """
    at = F.row_number().over(ordered()) - 1
    own = df.withColumn("__at", at).withColumn("__own", F.floor(F.col("__at") / rows))
    ahead = -(-(n - 1) // rows)  # segments that a row may be context of
    seen = F.filter(F.transform(F.sequence(F.lit(0), F.lit(ahead)), lambda k: F.col("__own") + k), lambda s: (s == F.col("__own")) | (F.col("__at") >= s * rows - (n - 1)))
    each = own.withColumn("__seg", F.explode(seen))

    names = df.columns

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("__at", kind="stable")
        x = g["close"].to_numpy(float)
        mine = np.flatnonzero((g["__own"] == g["__seg"]).to_numpy())
        out = [hurst_rs(x[i - n + 1 : i + 1]) if i >= n - 1 else np.nan for i in mine]
        return g.iloc[mine][names].assign(**{f"hurst_{n}": np.array(out, float)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", hurst_{n} double"
    return each.groupBy("asset", "__seg").applyInPandas(run, schema)


#: The features and the prefixes of their groups.
GROUPS = {"returns": ("logret_",), "volatility": ("rv_", "gk_vol_", "park_vol_", "atr_"), "momentum": ("ema_xover_", "rsi_", "roc_"), "volume": ("vol_zscore_", "amihud_", "obv_slope_"), "statistical": ("ret_zscore_", "bbpctb_", "bbwidth_", "slope_", "hurst_")}


def all_indicators(candles: DataFrame, bound: float = 5.0) -> DataFrame:
    """candles with the 23 features, clipped to [-bound, bound] (so rsi and raw atr saturate)."""
    d = with_steps(candles)
    d = d.withColumns(rolling_columns())
    d = with_hurst(with_ewm(with_obv_slope(d)))
    own = [c for c in d.columns if c not in candles.columns and not c.startswith("__")]
    return d.select(*candles.columns, *[clip(F.nanvl(_c(c), F.lit(None).cast("double")), -bound, bound).alias(c) for c in own])
