"""The paged candle source: paging, slices, retries, batches, streams, HTTP, and ingest through it."""

import http.server
import json
import threading
import urllib.parse
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import jobs, paged, rest, store

HOUR = 3_600_000


class Server:
    """Hourly candles of x without gaps and of y with a gap; counts the requests of its process."""

    def __init__(self, n=100, fail=0):
        self.n, self.fail, self.asked = n, fail, 0

    def __call__(self, asset, timeframe, open_ms, limit):
        self.asked += 1
        if self.asked <= self.fail:
            raise TimeoutError
        opens = [k * HOUR for k in range(self.n) if asset == "x" or (asset == "y" and not 20 <= k < 60)]
        return [[t, str(1 + t / HOUR), "2", "0.5", 1.5, "7", "more"] for t in opens if t >= open_ms][:limit]


def test_pages_move_retry_and_stop():
    waits, s = [], Server(25, fail=2)
    got = [len(p) for p in rest.pages(lambda c: s("x", "1h", c, 10), 0, 100 * HOUR, HOUR, pause=waits.append)]
    assert got == [10, 10, 5] and waits == [1.0, 2.0]
    assert [len(p) for p in rest.pages(lambda c: s("x", "1h", c, 10), 0, 15 * HOUR, HOUR)] == [10, 10]  # the last one reaches past the end
    stuck = list(rest.pages(lambda c: [[0]], 5, 100, 1))
    assert len(stuck) == 1
    with pytest.raises(TimeoutError):
        list(rest.pages(lambda c: Server(5, fail=99)("x", "1h", c, 1), 0, HOUR, HOUR, retries=3, pause=waits.append))

    def limited(cursor):
        raise rest.RateLimited

    waits.clear()
    with pytest.raises(rest.RateLimited):
        list(rest.pages(limited, 0, HOUR, HOUR, pause=waits.append))
    assert not waits


def test_slices_cover_the_range_once():
    got = paged.sliced([("x", "1h", 0), ("y", "4h", 7 * HOUR), ("z", "1h", 99 * HOUR)], 50 * HOUR, 10, 2)
    assert [(s.asset, s.start_ms // HOUR, s.end_ms // HOUR, s.last) for s in got] == [("x", 0, 20, False), ("x", 20, 40, False), ("x", 40, 50, True), ("y", 7, 50, True)]


@pytest.mark.parametrize("slice_pages", [1, 3, 32])
def test_batch_equals_one_run_of_pages(spark, slice_pages):
    paged.register(spark, f"pages_{slice_pages}", Server(100, fail=1), pause=lambda s: None)
    df = paged.candles(spark, f"pages_{slice_pages}", ["x", "y", "none"], ["1h"], 0, 75 * HOUR, limit=10, slice_pages=slice_pages)
    assert df.rdd.getNumPartitions() == 3 * -(-75 // (10 * slice_pages))
    rows = df.collect()
    keys = sorted((r["asset"], int(r["timestamp"].timestamp() * 1000) // HOUR) for r in rows)
    x = [("x", k) for k in range(80)]  # eight whole pages
    assert [k for k in keys if k[0] == "x"] == x and len(set(keys)) == len(keys)
    assert {k for _, k in keys[80:] if k < 75} == {*range(20), *range(60, 75)}
    one = next(r for r in rows if r["asset"] == "x" and r["timestamp"] == datetime.fromtimestamp(3 * 3600))
    assert (str(one["open"]), str(one["high"]), one["volume"], one["timeframe"]) == ("4.00000000", "2.00000000", 7.0, "1h")


def test_stream_takes_each_candle_once(spark, tmp_path):
    clock = tmp_path / "clock"
    clock.write_text(str(30 * 3600 + 59))
    at = str(clock)
    paged.register(spark, "pages_stream", Server(100), now=lambda: float(open(at).read()))
    stream = paged.candles(spark, "pages_stream", ["x", "y"], ["1h"], 0, 0, stream=True, limit=7, slice_pages=1)
    for hour in (30, 30, 64):
        clock.write_text(str(hour * 3600 + 59))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).groupBy("asset").agg(F.count(F.lit(1)), F.countDistinct("timestamp")).collect()
        assert {tuple(r) for r in rows} == {("x", hour, hour), ("y", min(hour, 20) + max(0, hour - 60), min(hour, 20) + max(0, hour - 60))}


def test_http_transport():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query).items()}
            code = {"slow": 429, "broken": 500}.get(q["symbol"], 200)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(Server(50)(q["symbol"], q["interval"], int(q["startTime"]), int(q["limit"]))).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    t = paged.HttpTransport(f"http://127.0.0.1:{server.server_port}/candles")
    assert [r[0] for r in t("x", "1h", 5 * HOUR, 3)] == [5 * HOUR, 6 * HOUR, 7 * HOUR]
    with pytest.raises(rest.RateLimited):
        t("slow", "1h", 0, 3)
    with pytest.raises(ConnectionError):
        t("broken", "1h", 0, 3)
    server.shutdown()
    with pytest.raises(ConnectionError):
        paged.HttpTransport("http://127.0.0.1:9/none", 0.5)("x", "1h", 0, 1)


def test_ingest_of_a_universe_is_one_plan(spark):
    store.drop(spark, "paged_candles")
    store.create(spark, "paged_candles", store.OHLCV, ("asset", "timeframe"))
    server = Server(100)
    call = lambda a, t, c: server(a, t, c, 10)
    got = jobs.ingest_universe(spark, call, "paged_candles", ["x", "y", "none"], ["1h"], 0, 30 * HOUR)
    assert got == {("x", "1h"): 30, ("y", "1h"): 30, ("none", "1h"): 0}
    # y's third page began behind the gap; both go on from their last candle, and their last page reaches past the end to 78
    assert jobs.ingest_universe(spark, call, "paged_candles", ["x", "y"], ["1h"], 0, 70 * HOUR, incremental=True) == {("x", "1h"): 49, ("y", "1h"): 9}
    assert jobs.ingest_asset(spark, call, "paged_candles", "x", "1h", 0, 60 * HOUR, incremental=True) == 0
    t = spark.table("paged_candles")
    assert t.count() == t.dropDuplicates(list(store.CANDLE_KEY)).count() == 118
    store.drop(spark, "paged_candles")


def test_table_transport_pages_a_table(spark, tmp_path):
    rows = [(a, k * HOUR, "1", "1", "1", "1", 2.0) for a in "xy" for k in range(30) if not 5 <= k < 25]
    spark.createDataFrame(rows, "asset string, open_ms long, open string, high string, low string, close string, volume double").write.parquet(str(tmp_path / "t"))
    t = paged.TableTransport(str(tmp_path / "t"))
    assert [r[0] // HOUR for r in t("x", "1h", 2 * HOUR, 4)] == [2, 3, 4]
    assert [r[0] // HOUR for r in t("x", "1h", 6 * HOUR, 4)] == [25, 26, 27, 28] and t("x", "1h", 99 * HOUR, 4) == []
