"""The event backtest: a fold over an asset's bars, run for all assets and fees side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fees of the cost sweep in basis points.
FEES = (5.0, 10.0, 15.0, 20.0, 30.0)


@dataclass
class Account:
    """What the fold carries from bar to bar."""

    cash: float
    peak: float
    side: int = 0
    size: float = 0.0
    entry: float = 0.0
    since: object = None
    stop: float | None = None
    take: float | None = None
    curve: list = field(default_factory=list)
    trades: list = field(default_factory=list)

    def equity(self, price: float) -> float:
        held = self.entry * self.size + self.side * (price - self.entry) * self.size
        return max(0.0, self.cash + held)

    def close(self, price: float, when, rate: float) -> None:
        gross = self.side * (price - self.entry) * self.size
        paid_in, paid_out = self.entry * self.size * rate, price * self.size * rate
        self.trades.append(("long" if self.side > 0 else "short", self.size, self.entry, price, self.since, when, gross, gross - paid_in - paid_out, paid_in + paid_out))
        self.cash += self.entry * self.size + gross - paid_out
        self.side, self.size, self.entry, self.since = 0, 0.0, 0.0, None


def fixed_fraction(fraction: float = 1.0) -> Callable[[float, float], float]:
    return lambda equity, strength: equity * fraction * strength


def regime_conditional(fraction: float = 1.0, da: float = 0.5, breakeven: float = 0.5, entropy_cut: float = 1.0, tier_cut: float = 1.0):
    edge = max(0.0, (da - breakeven) / breakeven)
    return lambda equity, strength: equity * fraction * strength * edge * entropy_cut * tier_cut


def buy_and_hold(i: int, held: int) -> tuple[int, float] | None:
    """Long whenever flat."""
    return (1, 1.0) if held == 0 else None


def random_side(p: float = 0.1, seed: int = 42):
    """A signal with probability p on a bar, either side alike."""
    rng = np.random.default_rng(seed)

    def on_bar(i: int, held: int):
        if rng.random() < p:
            return (1 if rng.random() < 0.5 else -1), 1.0
        return None

    return on_bar


def staleness(gaps: np.ndarray) -> float:
    """Twice the upper median of the gaps between bars, 0 if there are none."""
    return 2.0 * float(np.sort(gaps)[len(gaps) // 2]) if len(gaps) else 0.0


def fold(seconds, opens, highs, lows, closes, times, signal, bps: float, cash: float, size) -> Account:
    """Run one asset's bars. signal(i, held side) -> (side, strength) or None, filled at the next bar's open.

    On each bar: a gap beyond staleness() skips it, keeping what is pending; pending signals are filled, an opposite
    position is closed first, one of the same side is overwritten (its collateral is gone); the book is marked at the
    close; stops are tried before takes. What is open at the end is closed at the last close.
    """
    a, rate, n = Account(cash, cash), bps / 1e4, len(closes)
    stale = staleness(np.diff(seconds)) if n > 1 else 0.0
    pending = None
    for i in range(n):
        if i and stale > 0 and seconds[i] - seconds[i - 1] > stale:
            continue
        if pending:
            side, strength = pending
            # the book is valued at the close of the bar before
            notional = size(a.equity(mark) if a.side else a.equity(a.entry), strength)
            units = notional / opens[i]
            if units > 0:
                if a.side and a.side != side:
                    a.close(opens[i], times[i], rate)
                cost = opens[i] * units * (1 + rate)
                if a.cash >= cost:
                    a.cash -= cost
                    a.side, a.size, a.entry, a.since = side, units, opens[i], times[i]
        pending = None
        mark = closes[i]
        if a.side:
            for level, hit in ((a.stop, lambda x: lows[i] <= x if a.side > 0 else highs[i] >= x), (a.take, lambda x: highs[i] >= x if a.side > 0 else lows[i] <= x)):
                if level is not None and a.side and hit(level):
                    a.close(level, times[i], rate)
        equity = a.equity(mark)
        a.peak = max(a.peak, equity)
        a.curve.append([times[i], equity, equity / a.peak - 1 if a.peak > 0 else 0.0])
        pending = signal(i, a.side)
    if a.side and n:
        a.close(closes[-1], times[-1], rate)
        if a.curve:
            a.curve[-1] = [times[-1], max(0.0, a.cash), min(0.0, a.cash / a.peak - 1) if a.peak > 0 else 0.0]
    return a


REQUIRED = ("timestamp", "open", "high", "low", "close", "volume")


def check_bars(bars: DataFrame) -> None:
    """An error for bars without rows or without one of the columns."""
    if bars.isEmpty():
        raise ValueError("bars must not be empty")
    missing = sorted(set(REQUIRED) - set(bars.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def effective_bps(multipliers: dict[str, float], fee: str = "fee_bps") -> Column:
    """The commission of a row's asset: fee by the asset's multiplier, 1 unless given."""
    own = F.coalesce(F.create_map(*[F.lit(x) for pair in multipliers.items() for x in pair])[F.col("asset")], F.lit(1.0)) if multipliers else F.lit(1.0)
    return F.col(fee) * own


def run(bars: DataFrame, fees: tuple[float, ...] = (10.0,), cash: float = 100_000.0, size=None, strategy: Callable | None = None, trades: bool = False, multipliers: dict[str, float] | None = None) -> DataFrame:
    """The equity curve (or the trades) of bars(asset, timestamp, open, high, low, close[, side, strength]).

    Signals come from the columns side and strength, or from strategy(): a maker of signal functions. One fold per
    asset and fee: the bars are repeated for each fee, the folds are parallel. multipliers: of an asset's fees.
    """
    size = size or fixed_fraction()
    each = bars.withColumn("fee_bps", F.explode(F.array(*[F.lit(float(f)) for f in fees]))).withColumn("__bps", effective_bps(multipliers or {}))
    kind = bars.schema["timestamp"].dataType.simpleString()
    schema = f"asset string, fee_bps double, timestamp {kind}, equity double, drawdown double"
    if trades:
        schema = f"asset string, fee_bps double, side string, size double, entry_price double, exit_price double, entry_time {kind}, exit_time {kind}, gross_pnl double, net_pnl double, commission double"

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("timestamp", kind="stable")
        if strategy is None:
            sides = g["side"].map({"long": 1, "short": -1}).fillna(0).to_numpy(int)
            strengths = g["strength"].fillna(0.0).to_numpy(float)
            signal = lambda i, held: (int(sides[i]), float(strengths[i])) if sides[i] else None
        else:
            signal = strategy()
        t = g["timestamp"]
        seconds = (t.astype("int64") / 10 ** {"ns": 9, "us": 6, "ms": 3, "s": 0}[t.dt.unit]).to_numpy(float)
        cols = [g[c].to_numpy(float) for c in ("open", "high", "low", "close")]
        a = fold(seconds, *cols, list(t), signal, float(g["__bps"].iloc[0]), cash, size)
        names = [x.split(" ")[0] for x in schema.split(", ")][2:]
        out = pd.DataFrame(a.trades if trades else a.curve, columns=names)
        out.insert(0, "fee_bps", key[1])
        out.insert(0, "asset", key[0])
        return out

    return each.groupBy("asset", "fee_bps").applyInPandas(one, schema)


def cost_sweep(bars: DataFrame, fees: tuple[float, ...] = FEES, **kw) -> DataFrame:
    """The last equity of each asset and fee."""
    curve = run(bars, fees, **kw)
    return curve.groupBy("asset", "fee_bps").agg(F.max_by("equity", "timestamp").alias("final_equity"), F.count(F.lit(1)).alias("n_bars"))
