"""Streams with keyed state and timers: insert-or-ignore of keys seen before, and bars that close in event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import INFORMATION, STANDARD

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, as keyed processors need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class FirstSeen(StatefulProcessor):
    """The rows whose time the key has not seen. A key is one day's; its state goes when the watermark has passed the day, from
    when on rows of that day are late and do not count."""

    def __init__(self, at: str, names: list[str], key: tuple[str, ...]):
        self.at, self.names, self.key = at, names, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "at long", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, day = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            fresh = []
            for t in frame[self.at]:
                k = (int(t.value),)
                day = t
                fresh.append(t.value // 1_000_000 >= passed and not self.seen.containsKey(k))
                if fresh[-1]:
                    self.seen.updateValue(k, (1,))
            out = frame[fresh]
            yield out.assign(**{c: v for c, v in zip(self.key, key) if c not in out.columns})[self.names]
        if day is not None:
            self.handle.registerTimer((day.value // DAY + 1) * DAY // 1_000_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


DAY = 86_400_000_000_000


def insert_or_ignore(stream: DataFrame, late: str = "7 days", key: tuple[str, ...] = ("asset",), at: str = "timestamp") -> DataFrame:
    """The first row of each (key, at) of a stream, which may come `late` behind the newest one.

    State is kept by key and day, so no task holds a key's whole history, and a day's goes by a timer of event time.
    """
    x = stream.withWatermark(at, late).withColumn("__day", F.date_trunc("day", at))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return x.groupBy(*key, "__day").transformWithStateInPandas(FirstSeen(at, stream.columns, key), schema, "Append", "EventTime")


#: A bar's columns, as collect_bars() gives them.
BAR = "asset string, bar_id long, start_ts timestamp, end_ts timestamp, open double, high double, low double, close double, volume double, tick_count long, buy_volume double, sell_volume double, vwap double"
_FOLD = "total double, boundary double, formed long, bar long, best double, stretch double, side int, first long, period long, last long"
_OPEN = "bar long, start long, last long, open double, high double, low double, close double, volume double, ticks long, buy double, sell double, usd double"
MINUTE = 60_000_000


class Bars(StatefulProcessor):
    """Bars of one asset. Candles wait, by their time, until the watermark has passed them, so they are folded in time order whatever
    order they came in; the first candle of a time counts, one that comes behind the watermark does not. The last bar
    of an asset that is silent for idle_us of event time is closed as it is."""

    def __init__(self, kind: str, threshold: float, span: int, warmup: int, idle_us: int):
        self.kind, self.threshold, self.alpha, self.warmup, self.idle_us = kind, threshold, 2.0 / (span + 1), warmup, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "open double, high double, low double, close double, volume double")
        self.fold = handle.getValueState("fold", _FOLD)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.fold.get()[9] if self.fold.exists() else None
        latest = None
        for frame in rows:
            for r in frame.itertuples(index=False):
                at = r.timestamp.value // 1000
                if (last is None or at > last) and not self.waiting.containsKey((at,)):
                    self.waiting.updateValue((at,), (float(r.open), float(r.high), float(r.low), float(r.close), float(r.volume)))
                    latest = max(at, latest or at)
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
            self.handle.registerTimer(-(-(latest + self.idle_us) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        ready = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator() if k[0] <= now)
        fold = list(self.fold.get()) if self.fold.exists() else [0.0, self.threshold, 0, 0, 0.0, 0.0, -1, None, None, None]
        bar = list(self.open.get()) if self.open.exists() else None
        done = []
        for at, (o, h, low, c, v) in ready:
            self.waiting.removeKey((at,))
            if fold[7] is None:
                fold[7] = at
            elif fold[8] is None:
                fold[8] = at - fold[7]
            fold[9] = at
            nr = self.place(fold, o, c, v)
            if bar is not None and bar[0] != nr:
                done.append((bar, fold[8]))
                bar = None
            buy = v * ((c - low) / (h - low) if h > low else 0.5)
            sell = v * (1.0 - ((c - low) / (h - low) if h > low else 0.5))
            usd = (h + low + c) / 3.0 * v
            if bar is None:
                bar = [nr, at, at, o, h, low, c, v, 1, buy, sell, usd]
            else:
                bar = [nr, bar[1], at, bar[3], max(bar[4], h), min(bar[5], low), c, bar[7] + v, bar[8] + 1, bar[9] + buy, bar[10] + sell, bar[11] + usd]
        if bar is not None and fold[9] + self.idle_us <= now:
            done.append((bar, fold[8]))
            bar = None
        if ready:
            self.fold.update(tuple(fold))
        if bar is not None:
            self.open.update(tuple(bar))
        elif self.open.exists():
            self.open.clear()
        if done:
            yield pd.DataFrame([self.told(key[0], b, period or MINUTE) for b, period in done], columns=[c.split(" ")[0] for c in BAR.split(", ")])

    def place(self, fold: list, o: float, c: float, v: float) -> int:
        """The bar that the next candle is in, with the fold moved past it."""
        size = {"tick": 1.0, "volume": v, "dollar": c * v}[self.kind.split("_")[0]]
        if self.kind in STANDARD:
            nr = int(fold[0] // self.threshold)
            fold[0] += size
            return nr
        nr, up = fold[3], int(c >= o)
        if self.kind.endswith("_run"):
            fold[5] = fold[5] + size if fold[6] == up else size
            fold[6] = up
            fold[4] = reached = max(fold[4], fold[5])
        else:
            fold[0] += size if up else -size
            reached = abs(fold[0])
        if reached >= fold[1]:
            fold[2] += 1
            fold[3] += 1
            if fold[2] >= self.warmup:
                fold[1] = self.alpha * reached + (1.0 - self.alpha) * fold[1]
            fold[0] = fold[4] = fold[5] = 0.0
            fold[6] = -1
        return nr

    @staticmethod
    def told(asset: str, b: list, period: int) -> tuple:
        at = lambda us: pd.Timestamp(us, unit="us")
        return (asset, b[0], at(b[1]), at(b[2] + period), b[3], b[4], b[5], b[6], b[7], b[8], b[9], b[10], b[11] / b[7] if b[7] > 0 else b[6])

    def close(self) -> None:
        pass


def bars(candles: DataFrame, kind: str, threshold: float, ewm_span: int = 100, warmup: int = 100, late: str = "0 seconds", idle_hours: int = 24 * 365) -> DataFrame:
    """Bars of any type (BAR) from a stream of candles(asset, timestamp, open, high, low, close, volume), equal to those of
    operators.bars.bars() over all candles. A candle may come `late` behind the newest one."""
    if kind not in STANDARD + INFORMATION:
        raise ValueError(kind)
    x = candles.select("asset", "timestamp", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]).withWatermark("timestamp", late)
    fold = Bars(kind, float(threshold), ewm_span, warmup, idle_hours * 3_600_000_000)
    return x.groupBy("asset").transformWithStateInPandas(fold, BAR, "Append", "EventTime")


def run(out: DataFrame, target: str, checkpoint: str) -> None:
    """Write what is there of a stream to parquet at target and wait for it; a later run goes on from the checkpoint."""
    with rocks(out.sparkSession):
        q = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
