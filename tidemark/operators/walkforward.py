"""Walk-forward backtests: windows in turn with carried cash, one chained curve, all trades."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .backtest import fixed_fraction, fold

CURVE = ["asset", "window", "timestamp", "equity", "drawdown"]
TRADE = ["asset", "window", "side", "size", "entry_price", "exit_price", "entry_time", "exit_time", "gross_pnl", "net_pnl", "commission"]


def windows_of(n: int, train: int, test: int, step: int | None = None, expanding: bool = True) -> list[tuple[int, int, int]]:
    """(train_start, test_start, test_end) of each window that lies within n rows."""
    step = step or test
    return [(0 if expanding else a - train, a, a + test) for a in range(train, n - test + 1, step)]


def walk_forward(
    bars: DataFrame, factory: Callable[[pd.DataFrame], Callable], train: int, test: int, step: int | None = None, expanding: bool = True,
    bps: float = 10.0, cash: float = 100_000.0, size=None, trades: bool = False,
) -> DataFrame:
    """The equity curve by window (or the trades) of bars(asset, timestamp, open, high, low, close, ...).

    factory(training bars) gives the strategy of a window, signal(i, held side) -> (side, strength) or None. It is run over the
    window's test bars with the cash that the window before ended with: so an asset's windows are one sequential kernel, and
    assets run side by side. An asset with fewer bars than one window needs is an error.
    """
    size = size or fixed_fraction()
    kind = bars.schema["timestamp"].dataType.simpleString()
    schema = f"asset string, window int, timestamp {kind}, equity double, drawdown double"
    if trades:
        schema = f"asset string, window int, side string, size double, entry_price double, exit_price double, entry_time {kind}, exit_time {kind}, gross_pnl double, net_pnl double, commission double"

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("timestamp", kind="stable").reset_index(drop=True)
        specs = windows_of(len(g), train, test, step, expanding)
        if not specs:
            raise ValueError(f"{key[0]}: {len(g)} bars, a window needs {train + test}")
        t = g["timestamp"]
        seconds = (t.astype("int64") / 10 ** {"ns": 9, "us": 6, "ms": 3, "s": 0}[t.dt.unit]).to_numpy(float)
        prices = [g[c].to_numpy(float) for c in ("open", "high", "low", "close")]
        left, out = cash, []
        for nr, (first, a, b) in enumerate(specs):
            got = fold(seconds[a:b], *[p[a:b] for p in prices], list(t[a:b]), factory(g.iloc[first:a]), bps, left, size)
            out += [(key[0], nr, *row) for row in (got.trades if trades else got.curve)]
            if got.curve:
                left = got.curve[-1][1]
        return pd.DataFrame(out, columns=TRADE if trades else CURVE)

    return bars.groupBy("asset").applyInPandas(one, schema)


def chained(curve: DataFrame) -> DataFrame:
    """(asset, timestamp, equity): the windows' curves as one; a window adds only what lies after all windows before it."""
    before = Window.partitionBy("asset").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each window
    ends = curve.groupBy("asset", "window").agg(F.max("timestamp").alias("__end")).withColumn("__seen", F.max("__end").over(before))
    out = curve.join(ends.drop("__end"), ["asset", "window"]).filter(F.col("__seen").isNull() | (F.col("timestamp") > F.col("__seen")))
    return out.select("asset", "timestamp", "equity")


def momentum(train: pd.DataFrame):
    """A strategy that holds the side of the training window's trend."""
    close = train["close"].to_numpy(float)
    side = 1 if len(close) < 2 or close[-1] >= np.median(close) else -1
    return lambda i, held: (side, 1.0) if held == 0 else None
