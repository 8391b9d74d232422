"""Alternative bars: tick, volume and dollar bars, imbalance and run bars."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STANDARD = ("tick", "volume", "dollar")
INFORMATION = tuple(f"{m}_{k}" for k in ("imbalance", "run") for m in STANDARD)
REQUIRED = ("timestamp", "open", "high", "low", "close", "volume")


def check_columns(df: DataFrame) -> None:
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def metric(kind: str) -> Column:
    return {"tick": F.lit(1.0), "volume": F.col("volume"), "dollar": F.col("close") * F.col("volume")}[kind.split("_")[0]]


def config_hash(bar_type: str, threshold: float, ewm_span: int = 100, warmup: int = 100) -> str:
    """16 hex digits that name a configuration."""
    text = json.dumps({"bar_type": bar_type, "threshold": float(threshold), "ewm_span": ewm_span, "warmup_period": warmup}, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def is_information_driven(bar_type: str) -> bool:
    return bar_type in INFORMATION


def running_total(df: DataFrame, value: Column, name: str, segment: str = "day") -> DataFrame:
    """df with `name`: the sum of value up to and with the row, by asset in time order.

    The sum has two levels, so no task holds an asset's whole history: each segment of time is summed in a window of
    its own, and the segments' totals, few rows, are summed before it.
    """
    seg = F.date_trunc(segment, "timestamp")
    part = df.withColumn("__v", value).withColumn("__seg", seg)
    inside = Window.partitionBy("asset", "__seg").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("asset").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("asset", "__seg").agg(F.sum("__v").alias("__t"))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0.0))).drop("__t")
    out = part.withColumn("__in", F.sum("__v").over(inside)).join(totals, ["asset", "__seg"])
    return out.withColumn(name, F.col("__before") + F.col("__in")).drop("__v", "__seg", "__in", "__before")


def with_bar_id(candles: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The bucket of each row by the total before it: floor((cumulated - own) / threshold). Overshoot carries on."""
    check_columns(candles)
    m = metric(kind)
    return running_total(candles, m, "__c").withColumn("bar_id", F.floor((F.col("__c") - m) / threshold).cast("long")).drop("__c")


def candle_period(candles: DataFrame) -> DataFrame:
    """(asset, period): the second timestamp less the first, one minute if there is none or it is not later.

    The two first rows of an asset are found within each task before they meet.
    """
    nth = F.row_number().over(Window.partitionBy("asset").orderBy("timestamp"))
    two = candles.select("asset", "timestamp").withColumn("__n", nth).filter("__n <= 2")
    ends = two.groupBy("asset").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    minute = F.expr("INTERVAL '0 00:01:00' DAY TO SECOND")
    return ends.select("asset", F.when(F.col("a") == F.col("b"), minute).otherwise(F.col("b") - F.col("a")).alias("period"))


def collect_bars(rows: DataFrame, period: DataFrame | None = None) -> DataFrame:
    """One bar for each (asset, bar_id): OHLC, volume, ticks, estimated buy and sell volume, vwap."""
    spread = F.col("high") - F.col("low")
    buy = F.when(spread > 0, F.try_divide(F.col("close") - F.col("low"), spread)).otherwise(F.lit(0.5))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    rows = rows.withColumns({"__buy": F.col("volume") * buy, "__sell": F.col("volume") * (1.0 - buy), "__usd": typical * F.col("volume")})
    b = rows.groupBy("asset", "bar_id").agg(
        F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.min_by("open", "timestamp").alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("tick_count"), F.sum("__buy").alias("buy_volume"),
        F.sum("__sell").alias("sell_volume"), F.sum("__usd").alias("__usd"),
    )
    b = b.withColumn("vwap", F.when(F.col("volume") > 0, F.try_divide("__usd", "volume")).otherwise(F.col("close"))).drop("__usd")
    if period is not None:
        b = b.join(period, "asset").withColumn("end_ts", F.col("end_ts") + F.col("period")).drop("period")
    return b


def standard_bars(candles: DataFrame, kind: str, threshold: float) -> DataFrame:
    return collect_bars(with_bar_id(candles, kind, threshold), candle_period(candles))


def information_ids(candles: DataFrame, kind: str, threshold: float, ewm_span: int = 100, warmup: int = 100) -> DataFrame:
    """candles with bar_id of imbalance or run bars.

    The threshold adapts to the bars formed so far, so an asset's rows are one sequential fold; only the ids
    are found there, bars are then aggregated as any other.
    """
    run = kind.endswith("_run")
    base = kind.split("_")[0]
    alpha = 2.0 / (ewm_span + 1)

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("timestamp", kind="stable")
        up = (g["close"] >= g["open"]).to_numpy()
        size = {"tick": g["volume"] * 0 + 1.0, "volume": g["volume"], "dollar": g["close"] * g["volume"]}[base].to_numpy(float)
        limit, formed, bar = threshold, 0, 0
        ids = []
        total = best = stretch = 0.0
        side = None
        for u, m in zip(up.tolist(), size.tolist()):
            ids.append(bar)
            if run:
                stretch = stretch + m if side == u else m
                side = u
                best = max(best, stretch)
                reached = best
            else:
                total += m if u else -m
                reached = abs(total)
            if reached >= limit:
                formed += 1
                bar += 1
                if formed >= warmup:
                    limit = alpha * reached + (1.0 - alpha) * limit
                total = best = stretch = 0.0
                side = None
        return g.assign(bar_id=ids)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candles.schema) + ", bar_id long"
    return candles.groupBy("asset").applyInPandas(fold, schema)


def information_bars(candles: DataFrame, kind: str, threshold: float, ewm_span: int = 100, warmup: int = 100) -> DataFrame:
    check_columns(candles)
    return collect_bars(information_ids(candles, kind, threshold, ewm_span, warmup), candle_period(candles))


def bars(candles: DataFrame, kind: str, threshold: float, ewm_span: int = 100, warmup: int = 100) -> DataFrame:
    if kind in STANDARD:
        return standard_bars(candles, kind, threshold)
    if kind in INFORMATION:
        return information_bars(candles, kind, threshold, ewm_span, warmup)
    raise ValueError(f"unknown bar type {kind}")


def keyed(df: DataFrame, kind: str, threshold: float, ewm_span: int = 100, warmup: int = 100) -> DataFrame:
    """Bars in the store's form."""
    return df.drop("bar_id").withColumns({"bar_type": F.lit(kind), "bar_config_hash": F.lit(config_hash(kind, threshold, ewm_span, warmup))})
