"""Candles from a paged API as a Spark data source, for batches and streams.

Each task pages through one asset, timeframe and slice of time, so pages go from the API to the executors and never pass the
driver. The API is a transport: a callable (asset, timeframe, open_ms, limit) -> rows [open_ms, open, high, low, close, volume, ...].
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .rest import pages

#: Milliseconds of a timeframe.
INTERVALS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}
SCHEMA = "asset string, timeframe string, timestamp timestamp, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume double"
#: Candles of a request, and requests of a slice.
LIMIT, SLICE_PAGES = 1000, 32
ROWS = 10_000

Transport = Callable[[str, str, int, int], list[list]]


class Slice(InputPartition):
    """One task's part: candles that open in [start_ms, end_ms); the last slice keeps what its last page has beyond end_ms."""

    def __init__(self, asset: str, timeframe: str, start_ms: int, end_ms: int, last: bool):
        self.asset, self.timeframe, self.start_ms, self.end_ms, self.last = asset, timeframe, start_ms, end_ms, last


def sliced(jobs: list[tuple[str, str, int]], end_ms: int, limit: int, slice_pages: int) -> list[Slice]:
    """Slices of (asset, timeframe, start_ms): whole pages of a source without gaps, so requests fall as if paged in one go."""
    out = []
    for asset, timeframe, start in jobs:
        step = INTERVALS[timeframe] * limit * slice_pages
        at = range(start, end_ms, step)
        out += [Slice(asset, timeframe, a, min(a + step, end_ms), a == at[-1]) for a in at]
    return out


def read_slice(s: Slice, transport: Transport, limit: int, **retry) -> Iterator[pa.RecordBatch]:
    """The slice's candles as Arrow batches of SCHEMA."""
    rows: list[list] = []
    for page in pages(lambda cursor: transport(s.asset, s.timeframe, cursor, limit), s.start_ms, s.end_ms, INTERVALS[s.timeframe], **retry):
        rows += [r for r in page if s.last or s.start_ms <= int(r[0]) < s.end_ms]
        if len(rows) >= ROWS:
            yield batch_of(s, rows)
            rows = []
    if rows:
        yield batch_of(s, rows)


def batch_of(s: Slice, rows: list[list]) -> pa.RecordBatch:
    money = lambda k: pa.array([Decimal(str(r[k])).quantize(Decimal("1e-8")) for r in rows], pa.decimal128(18, 8))
    opened = pa.array([int(r[0]) * 1000 for r in rows], pa.timestamp("us", tz="UTC"))
    columns = [pa.array([s.asset] * len(rows)), pa.array([s.timeframe] * len(rows)), opened, *[money(k) for k in range(1, 5)], pa.array([float(r[5]) for r in rows])]
    return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in SCHEMA.split(", ")])


class _Options:
    """What both readers take from the options: the job list as JSON, the end, page and slice sizes, retries."""

    def __init__(self, options: dict, transport: Transport, pause: Callable[[float], None]):
        self.transport = transport
        self.jobs = [(a, t, int(ms)) for a, t, ms in json.loads(options["jobs"])]
        self.end_ms = int(options.get("end_ms", 0))
        self.limit = int(options.get("limit", LIMIT))
        self.slice_pages = int(options.get("slice_pages", SLICE_PAGES))
        self.retry = {"retries": int(options.get("retries", 5)), "pause": pause}


class CandleReader(DataSourceReader):
    def __init__(self, o: _Options):
        self.o = o

    def partitions(self) -> list[Slice]:
        return sliced(self.o.jobs, self.o.end_ms, self.o.limit, self.o.slice_pages)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(partition, self.o.transport, self.o.limit, **self.o.retry)


class CandleStreamReader(DataSourceStreamReader):
    """Offsets are opening times: a batch takes what opens from the last one to the newest closed candle, or to end_ms.

    A slice ends at the offset, so a candle is in one batch only, however often a batch is tried.
    """

    def __init__(self, o: _Options, now: Callable[[], float]):
        self.o, self.now = o, now

    def initialOffset(self) -> dict:
        return {"ms": min(ms for _, _, ms in self.o.jobs)}

    def latestOffset(self) -> dict:
        widest = max(INTERVALS[t] for _, t, _ in self.o.jobs)
        closed = int(self.now() * 1000) // widest * widest
        return {"ms": max(min(closed, self.o.end_ms) if self.o.end_ms else closed, self.initialOffset()["ms"])}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        jobs = [(a, t, max(ms, start["ms"])) for a, t, ms in self.o.jobs]
        out = sliced(jobs, end["ms"], self.o.limit, self.o.slice_pages)
        for s in out:
            s.last = False
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(partition, self.o.transport, self.o.limit, **self.o.retry)


def register(spark: SparkSession, name: str, transport: Transport, pause: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> None:
    """Make spark.read.format(name) and spark.readStream.format(name) page through `transport`, which is sent to the tasks.

    Options: jobs (JSON list of [asset, timeframe, start_ms]), end_ms, limit, slice_pages, retries.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> CandleReader:
            return CandleReader(_Options(self.options, transport, pause))

        def streamReader(self, schema) -> CandleStreamReader:
            return CandleStreamReader(_Options(self.options, transport, pause), now)

    spark.dataSource.register(Source)


def candles(spark: SparkSession, name: str, assets: list[str], timeframes: list[str], start_ms: int | dict[tuple[str, str], int], end_ms: int, stream: bool = False, **options) -> DataFrame:
    """Candles of every asset and timeframe from start_ms (or each pair's own) on, in one plan."""
    jobs = [(a, t, start_ms[a, t] if isinstance(start_ms, dict) else start_ms) for a, t in product(assets, timeframes)]
    jobs = [j for j in jobs if stream or j[2] < end_ms]
    r = (spark.readStream if stream else spark.read).format(name).option("jobs", json.dumps(jobs)).option("end_ms", end_ms)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


class Refused(ConnectionError):
    """The server failed in a way that may pass."""


class HttpTransport:
    """Pages over HTTP: GET url?symbol=..&interval=..&startTime=..&limit=.. gives a JSON list of candle rows.

    429 raises RateLimited, which is not tried again here; other errors of the server or the network are.
    """

    def __init__(self, url: str, timeout: float = 10.0):
        self.url, self.timeout = url, timeout

    def __call__(self, asset: str, timeframe: str, open_ms: int, limit: int) -> list[list]:
        from .rest import RateLimited

        asked = urllib.parse.urlencode({"symbol": asset, "interval": timeframe, "startTime": open_ms, "limit": limit})
        try:
            with urllib.request.urlopen(f"{self.url}?{asked}", timeout=self.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(f"{asset} {timeframe}") from e
            raise Refused(f"{e.code} for {asset} {timeframe}") from e
        except urllib.error.URLError as e:
            raise Refused(str(e.reason)) from e


class TableTransport:
    """Pages of a candle table (asset, open_ms, open, high, low, close, volume) in parquet at a path that workers can read: the first
    `limit` rows of an asset from open_ms on, found by the files' statistics."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, asset: str, timeframe: str, open_ms: int, limit: int) -> list[list]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        at, where = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        until = open_ms + limit * INTERVALS[timeframe]
        data, columns = ds.dataset(where, filesystem=at), ["open_ms", "open", "high", "low", "close", "volume"]
        mine = pc.field("asset") == asset
        rows = data.to_table(columns=columns, filter=mine & (pc.field("open_ms") >= open_ms) & (pc.field("open_ms") < until))
        if not rows.num_rows:  # a gap longer than a page
            rows = data.to_table(columns=columns, filter=mine & (pc.field("open_ms") >= open_ms))
        return [list(r.values()) for r in rows.sort_by("open_ms").slice(0, limit).to_pylist()]
