"""Guarded window expressions over an asset's rows in time order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12
KEY, TIME = "asset", "timestamp"


def ordered() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(n: int) -> WindowSpec:
    return ordered().rowsBetween(-(n - 1), 0)


def upto() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy(KEY)


def rolling(agg: Column, over: Column, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, null while fewer than `least` (n) values are there."""
    w = trailing(n)
    return F.when(F.count(over).over(w) >= (least or n), agg.over(w))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean(c, n: int, least: int | None = None) -> Column:
    return rolling(F.avg(col(c)), col(c), n, least)


def std(c, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp(col(c)), col(c), n, least)


def zscore(c, n: int, eps: float = EPS) -> Column:
    return F.try_divide(col(c) - mean(c, n), std(c, n) + F.lit(eps))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null where either is not positive."""
    return F.when((a > 0) & (b > 0), F.log(a / b))


def lag(c, n: int = 1) -> Column:
    return F.lag(col(c), n).over(ordered())


def lead(c, n: int = 1) -> Column:
    return F.lead(col(c), n).over(ordered())


def clip(c: Column, low: float, high: float) -> Column:
    """c between low and high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def slope(y: Column, x: Column, n: int) -> Column:
    return rolling(F.regr_slope(y, x), y, n)


def ewm(df: DataFrame, **means: tuple[str, float]) -> DataFrame:
    """df with the exponentially weighted means name=(column, alpha): m = alpha x + (1 - alpha) m, started at the first
    value. A series' fold is sequential, so an asset's series is one group; the groups run side by side."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n in means)

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TIME, kind="stable")
        return g.assign(**{n: g[c].astype(float).ewm(alpha=a, adjust=False, ignore_na=True).mean() for n, (c, a) in means.items()})

    return df.groupBy(KEY).applyInPandas(fold, schema)
