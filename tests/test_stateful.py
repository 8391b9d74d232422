"""Stateful streams against the batch operators, with rows out of order, again, late, and runs that go on."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.streaming import stateful, twins

from .test_operators import SCHEMA, T0, candles

STREAM = SCHEMA.replace("timestamp_ntz", "timestamp")


def put(spark, rows, path, nr):
    spark.createDataFrame(rows, STREAM).coalesce(1).write.parquet(f"{path}/{nr:03d}")


def source(spark, path):
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def end(spark, path, nr):
    """A row far ahead, whose asset makes no bars that are looked at, moves the watermark past all others."""
    put(spark, [("~", T0 + timedelta(days=4000), 1.0, 1.0, 1.0, 1.0, 0.0)], path, nr)


def test_first_rows_win_over_runs(spark, tmp_path):
    rows, _ = candles(spark, 60)
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put(spark, rows[:30] + rows[10:20], path, 0)
    stateful.run(stateful.insert_or_ignore(source(spark, path)), out, state)
    assert spark.read.parquet(out).count() == 30
    changed = [(r[0], r[1], -1.0, *r[3:]) for r in rows]
    put(spark, changed[20:45], path, 1)
    put(spark, changed[40:], path, 2)
    stateful.run(stateful.insert_or_ignore(source(spark, path)), out, state)
    got = {r["timestamp"]: r["open"] for r in spark.read.parquet(out).collect()}
    assert got == {r[1]: (r[2] if k < 30 else -1.0) for k, r in enumerate(rows)}
    assert spark.read.parquet(out).count() == 60


@pytest.mark.parametrize("kind,threshold", [("volume", 20.0), ("tick_run", 3.0), ("dollar_imbalance", 900.0)])
def test_bars_equal_the_batch(spark, tmp_path, kind, threshold):
    a, b = candles(spark, 70, "a", 1)[0], candles(spark, 50, "b", 2)[0]
    rows = sorted(a + b, key=lambda r: r[1])
    path = str(tmp_path / "in")
    rng = random.Random(3)
    for nr in range(4):
        some = rows[30 * nr : 30 * nr + 30] + (rows[30 * nr - 4 : 30 * nr] if nr else [])  # some come again
        rng.shuffle(some)
        put(spark, some, path, nr)
    end(spark, path, 9)
    stateful.run(stateful.bars(source(spark, path), kind, threshold, 10, 3, late="6 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(stateful.BAR).parquet(str(tmp_path / "out")).filter("asset <> '~'")
    want = bars.bars(spark.createDataFrame(a + b, SCHEMA), kind, threshold, 10, 3)
    columns = [c.split(" ")[0] for c in stateful.BAR.split(", ")]
    key = lambda df: sorted(tuple(str(v) if k in (0, 2, 3) else round(float(v), 9) for k, v in enumerate(r)) for r in df.select(columns).collect())
    assert key(got) == key(want) and want.count() > 5


def test_late_candles_do_not_count(spark, tmp_path):
    rows, _ = candles(spark, 40)
    path = str(tmp_path / "in")
    put(spark, rows[:10] + rows[11:30], path, 0)
    put(spark, rows[30:35], path, 1)
    put(spark, rows[10:11] + rows[35:], path, 2)
    end(spark, path, 3)
    stateful.run(stateful.bars(source(spark, path), "tick", 5.0), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("asset = 'a'").agg(F.sum("tick_count"), F.count(F.lit(1))).first()
    assert tuple(got) == (39, 8)
    with pytest.raises(ValueError):
        stateful.bars(source(spark, path), "range", 1.0)


def test_rows_of_days_behind_the_watermark_are_late(spark, tmp_path):
    rows, _ = candles(spark, 72)
    path = str(tmp_path / "in")
    for nr, some in enumerate((rows[:20], rows[40:], rows[18:22] + rows[45:46])):
        put(spark, some, path, nr)
    stateful.run(stateful.insert_or_ignore(source(spark, path), "12 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(r["timestamp"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [r[1] for r in rows[:20] + rows[40:]]


def test_the_older_ingest_agrees(spark, tmp_path):
    rows, _ = candles(spark, 30)
    put(spark, rows + rows[:7], str(tmp_path / "in"), 0)
    twins.ingest(source(spark, str(tmp_path / "in")), str(tmp_path / "a"), str(tmp_path / "b")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 30
