"""Operators against plain Python on small frames, and their edge cases."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.functions.digamma import digamma
from tidemark.operators import backtest, bars, cv, models, profiling, targets, thresholds, validation
from tidemark.sources import store
from tidemark.sources.tables import resample
from tidemark.streaming import twins

T0 = datetime(2024, 1, 1)
SCHEMA = "asset string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double"


def candles(spark, n=60, asset="a", seed=1):
    rng = random.Random(seed)
    rows, price = [], 100.0
    for i in range(n):
        close = price + rng.gauss(0, 1)
        rows.append((asset, T0 + timedelta(hours=i), price, max(price, close) + 0.5, min(price, close) - 0.5, close, float(rng.randint(0, 9))))
        price = close
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_volume_bars_carry_overshoot(spark):
    rows, df = candles(spark)
    got = {r["bar_id"]: r for r in bars.standard_bars(df, "volume", 20.0).collect()}
    want, total = {}, 0.0
    for r in rows:
        want.setdefault(int(total // 20), []).append(r)
        total += r[6]
    assert set(got) == set(want)
    for k, rs in want.items():
        assert got[k]["open"] == rs[0][2] and got[k]["close"] == rs[-1][5] and got[k]["tick_count"] == len(rs)
        assert got[k]["end_ts"] == rs[-1][1] + timedelta(hours=1)


def test_bars_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bars.bars(empty, "tick", 5.0).count() == 0
    assert bars.bars(empty, "volume_run", 5.0).count() == 0
    one = spark.createDataFrame([("a", T0, 1.0, 1.0, 1.0, 1.0, 0.0)], SCHEMA)
    r = bars.bars(one, "dollar", 1e9).first()
    assert r["vwap"] == 1.0 and r["end_ts"] == T0 + timedelta(minutes=1)
    with pytest.raises(ValueError):
        bars.check_columns(one.drop("open"))
    with pytest.raises(ValueError):
        bars.bars(one, "range", 1.0)
    assert len(bars.config_hash("tick", 1.0)) == 16


def test_asof_and_bucketed_agree(spark):
    left = spark.createDataFrame([(T0 + timedelta(hours=7 * i), i) for i in range(30)], "timestamp timestamp_ntz, i int")
    right = spark.createDataFrame([(T0 + timedelta(hours=11 * i + 3), i * 10) for i in range(15)], "timestamp timestamp_ntz, v int")
    a = {r["i"]: r["v"] for r in targets.asof(left, right, ["v"]).collect()}
    b = {r["i"]: r["v"] for r in targets.asof_bucketed(left, right, ["v"]).collect()}
    want = {i: max((10 * j for j in range(15) if 11 * j + 3 <= 7 * i), default=None) for i in range(30)}
    assert a == want and b == want


def test_store_round_trip(spark):
    store.drop(spark, "t_bars")
    store.create(spark, "t_bars", store.OHLCV, ["asset", "timeframe"])
    assert store.exists(spark, "t_bars")
    rows = [("x", "1h", T0 + timedelta(hours=i % 3), 1, 1, 1, 1, float(i)) for i in range(5)]
    batch = spark.createDataFrame(rows, "asset string, timeframe string, timestamp timestamp, open int, high int, low int, close int, volume double")
    batch = batch.select(*[batch[f.name].cast(f.dataType) for f in store.OHLCV])
    assert store.ingest(batch, "t_bars", store.CANDLE_KEY, ("asset", "timeframe")) == 3
    assert store.ingest(batch, "t_bars", store.CANDLE_KEY, ("asset", "timeframe")) == 0
    assert store.scan(spark.table("t_bars"), T0, T0 + timedelta(hours=2), asset="x").count() == 2
    store.drop(spark, "t_bars")
    assert not store.exists(spark, "t_bars")


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_classifiers_fit_after_an_ingest_and_an_observation(spark, kind):
    from pyspark.sql import Observation

    store.create(spark, "t_before_fit", store.OHLCV, ["asset", "timeframe"])
    batch = spark.createDataFrame([("x", "1h", T0, 1, 1, 1, 1, 1.0)], "asset string, timeframe string, timestamp timestamp, open int, high int, low int, close int, volume double")
    assert store.ingest(batch.select(*[batch[f.name].cast(f.dataType) for f in store.OHLCV]), "t_before_fit", store.CANDLE_KEY, ("asset", "timeframe")) == 1
    store.drop(spark, "t_before_fit")
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    x = spark.range(200).selectExpr("CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "IF(id % 10 > 4, 1, -1) AS y").withColumn("a", F.when(F.col("a") != 9, F.col("a")))
    got = models.classify(x, x, ["a", "b"], kind).collect()
    assert len(got) == 180 and all((r["p_up"] >= 0.5) == (r["y"] == 1) == (r["pred"] == 1) for r in got)


def test_logistic_column_equals_the_fitted_model(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.linalg import Vectors

    x = spark.range(300).selectExpr("id", "CAST(id % 13 AS DOUBLE) AS a", "CAST((id * 7) % 11 AS DOUBLE) AS b", "CAST((id * 5) % 13 > 6 AS DOUBLE) AS label")
    m = Pipeline(stages=[models._features(["a", "b"]), models.classifier("logistic", 300)]).fit(x)
    got = x.select("a", "b", models.logistic_column(m.stages[-1], ["a", "b"]).alias("p")).collect()
    assert all(math.isclose(m.stages[-1].predictProbability(Vectors.dense([r["a"], r["b"]]))[1], r["p"], rel_tol=1e-12) for r in got)


def test_resample_breaks_ties_by_sequence(spark):
    t = spark.createDataFrame([("a", T0, 2, 5.0, 1), ("a", T0, 1, 3.0, 1)], "asset string, timestamp timestamp_ntz, seq long, price double, size long")
    r = resample(t).first()
    assert (r["open"], r["close"]) == (3.0, 5.0)


def test_backtest_fold():
    n = 6
    secs = np.arange(n) * 3600.0
    o = np.array([10.0, 10, 11, 12, 13, 14])
    c = o + 0.5
    a = backtest.fold(secs, o, c, o, c, list(range(n)), backtest.buy_and_hold, 10.0, 1000.0, backtest.fixed_fraction(0.5))
    assert len(a.curve) == n and len(a.trades) == 1
    units = 50.0
    assert a.trades[0][1] == units
    assert math.isclose(a.cash, 1000 - units * 10 * 1.001 + units * 14.5 - units * 14.5 * 0.001)
    flat = backtest.fold(secs, o, c, o, c, list(range(n)), lambda i, h: None, 10.0, 1000.0, backtest.fixed_fraction())
    assert flat.cash == 1000.0 and not flat.trades
    gap = np.array([0, 1, 2, 50, 51, 52.0])
    assert len(backtest.fold(gap, o, c, o, c, list(range(n)), lambda i, h: None, 0.0, 1.0, backtest.fixed_fraction()).curve) == n - 1


def test_splits(spark):
    assert cv.pipeline_splits(1000)[0] == (0, 600, 615, 680)
    with pytest.raises(ValueError):
        cv.pipeline_splits(20)
    sizes = spark.createDataFrame([("a", 1000), ("b", 333), ("c", 20), ("d", 47), ("e", 0)], "asset string, n long")
    for windows in (3, 4, 5):
        got = {}
        for r in cv.window_splits(sizes, windows).orderBy("asset", "window").collect():
            got.setdefault(r["asset"], []).append((r["train_start"], r["train_end"], r["test_start"], r["test_end"]))
        for asset, n in (("a", 1000), ("b", 333), ("d", 47)):
            try:
                want = cv.pipeline_splits(n, windows)
            except ValueError:
                want = None
            assert got.get(asset) == want
        assert "c" not in got and "e" not in got
    _, df = candles(spark, 31)
    f = cv.cpcv(df).groupBy("fold").count().collect()
    assert len(f) == 15 and all(r["count"] == 31 for r in f)
    u = [r["uniqueness"] for r in cv.uniqueness(df, 4).orderBy("pos").collect()]
    alive = [sum(1 for i in range(31) if i <= t < i + 4) for t in range(34)]
    assert np.allclose(u, [np.mean([1 / alive[t] for t in range(i, i + 4)]) for i in range(31)])


def test_tails():
    assert math.isclose(tails.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.t_sf(2.2281388519649385, 10), 0.025, rel_tol=1e-8)
    assert math.isclose(tails.f_sf(4.102821015127, 2, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(float(digamma(np.array([1.0]))[0]), -0.5772156649015329, rel_tol=1e-10)


def test_statistics():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    assert abs(profiling.variance_ratio(x, 8)[0] - 1) < 0.2
    assert profiling.stationarity(x)["verdict"] == "stationary" and profiling.stationarity(np.cumsum(x))["verdict"] == "unit_root"
    assert profiling.stationarity(np.ones(50))["verdict"] == "inconclusive"
    h, r = 1.0, []
    for _ in range(2500):
        r.append(math.sqrt(h) * rng.normal())
        h = 0.05 + 0.1 * r[-1] ** 2 + 0.85 * h
    g = profiling.garch_fit(np.array(r) / 100)
    assert 0.02 < g["alpha"] < 0.25 and 0.6 < g["beta"] < 0.97
    assert 3 < profiling.student_fit(rng.standard_t(5, 3000))["nu"] < 9
    assert all(abs(stat) < 3 for _, stat, _ in profiling.bds(x[:400]))
    assert validation.mutual_information(x, x + 0.1 * rng.normal(size=3000)) > 1 > 0.05 > validation.mutual_information(x, rng.normal(size=3000))
    assert sorted(validation.block_permute(np.arange(10), 3, rng)) == list(range(10))
    assert (validation.block_permute(np.arange(3), 5, rng) == np.arange(3)).all()


def test_pacf_of_ar1():
    assert np.allclose(profiling.pacf([0.5, 0.25, 0.125]), [0.5, 0, 0])
    assert profiling.kish_n_eff(100, [0.5, 0.25]) == pytest.approx(100 / 2.5)


def test_thresholds():
    assert thresholds.breakeven_da(0.01, 0.002) == pytest.approx(0.6)
    assert thresholds.feasibility(0.6, 0.55) == "feasible" and thresholds.feasibility(0.5, 0.55) == "underpowered"
    assert thresholds.harvey_z(1) == 3.0 and thresholds.stability_threshold(5) == 3
    assert 0 < thresholds.deflated_sharpe(0.1, 500, 10) < 1


def test_streams(spark, tmp_path):
    rows = [("a", T0 + timedelta(minutes=10 * i), i, float(i), 1) for i in range(60)]
    t = spark.createDataFrame(rows, "asset string, timestamp timestamp, seq long, price double, size long")
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = twins.time_bars(twins.source(spark, str(tmp_path / "in"), t.schema))
    q = out.writeStream.format("memory").queryName("t_bars_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("t_bars_stream").orderBy("timestamp").collect()
    assert len(got) >= 7 and got[0]["open"] == 0.0 and got[0]["close"] == 5.0
    twins.ingest(twins.source(spark, str(tmp_path / "in"), t.schema), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_stream_of_imbalance_bars(spark, tmp_path):
    _, df = candles(spark, 80)
    df.withColumn("timestamp", df["timestamp"].cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = twins.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = twins.imbalance_bars(src, 15.0, 20, 5).writeStream.format("memory").queryName("t_imb").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = bars.information_ids(df, "volume_imbalance", 15.0, 20, 5).agg({"bar_id": "max"}).first()[0]
    assert spark.table("t_imb").count() in (closed, closed + 1)


def test_feature_gate_runs_at_production_numbers(spark, sf, monkeypatch):
    from tidemark.plans import learning

    seen, stable = {}, {}

    def tests(long, n, block=50, ridge=None, **more):
        (seen if ridge else stable).update(n=n, ridge=ridge)
        return long.select("asset", "feature").distinct().selectExpr("*", "0.01 AS p_mi", "0.01 AS p_da", "0.6D AS da", "0.5D AS da_null")

    monkeypatch.setattr(learning.V, "permutation_tests", tests)
    whole = learning.V.stability
    monkeypatch.setattr(learning.V, "stability", lambda long, windows, n, **kw: seen.update(windows=windows) or whole(long, windows, n, **kw))
    rows = learning.feature_validation(spark, sf).collect()
    assert seen["n"] >= 1000 and seen["ridge"] >= 500 and stable["n"] >= 500 and len(seen["windows"]) >= 2
    assert len(rows) == 20


def test_feature_gate_corrects_and_needs_stable_weeks(spark):
    rows = [("a", f"f{i}", p, 0.01, 0.6, 0.5, 1.0, True) for i, p in enumerate([0.01, 0.02, 0.04, 0.2, 0.9])]
    report = spark.createDataFrame(rows, "asset string, feature string, p_mi double, p_da double, da double, da_null double, stable_share double, stable boolean")
    got = {r["feature"]: r for r in validation.keep(report, least=1).collect()}
    assert [got[f"f{i}"]["q_mi"] for i in range(5)] == pytest.approx([0.05, 0.05, 0.2 / 3, 0.25, 0.9])
    assert not got["f2"]["kept"] and got["f0"]["kept"]
    x = spark.range(400).selectExpr("'a' AS asset", "'f' AS feature", "timestamp_ntz '2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS timestamp", "CAST(id % 7 AS DOUBLE) AS x", "IF(id < 168, id % 7, id % 2) * 1.0D AS y")
    weeks = [("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-01-22")]
    assert validation.stability(x, weeks[:2], 60, block=6).first()["stable_share"] == 0.5
    assert validation.stability(x, weeks[2:], 60).first()["stable_share"] == 1.0


def test_bar_checks_and_multiplied_fees(spark):
    rows, df = candles(spark, 40)
    backtest.check_bars(df)
    with pytest.raises(ValueError):
        backtest.check_bars(df.limit(0))
    with pytest.raises(ValueError):
        backtest.check_bars(df.drop("volume"))
    both = df.unionByName(spark.createDataFrame([("b", *r[1:]) for r in rows], SCHEMA)).withColumns({"side": F.lit("long"), "strength": F.lit(1.0)})
    got = {r["asset"]: r for r in backtest.run(both, (10.0,), size=backtest.fixed_fraction(0.5), trades=True, multipliers={"b": 2.5}).groupBy("asset").agg(F.max("fee_bps").alias("fee"), F.sum("commission").alias("c"), F.sum("size").alias("s")).collect()}
    assert got["a"]["fee"] == got["b"]["fee"] == 10.0 and got["b"]["c"] / got["b"]["s"] == pytest.approx(2.5 * got["a"]["c"] / got["a"]["s"], rel=1e-9)


def test_names_suggestions_and_thresholds(spark):
    assert targets.cross_asset_names() == ["btc_dir", "btc_logret", "btc_rv"]
    df = spark.range(1)
    assert targets.new_columns(df, df.withColumns({"z": F.lit(1), "a": F.lit(1)})) == ["a", "z"]
    names = ["atr_14", "gk_vol_24", "rv_24", "hurst_100", "slope", "arv_"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(profiling.suggested(F.col("n"))).collect()]
    assert got == ["pct_atr", "rolling_zscore", "first_difference", "first_difference", None, None]
    rows = [("a", "dollar", 5286, 5000.0, 0.02), ("b", "dollar", 100, 0.0, 0.0), ("c", "tick", 900, 808.0, 0.5)]
    for r in thresholds.all_thresholds(spark.createDataFrame(rows, "asset string, bar_type string, n_bars long, n_eff double, mean_abs_return double")).collect():
        assert r["breakeven_da"] == pytest.approx(thresholds.breakeven_da(r["mean_abs_return"], 0.002)) and r["mde_da"] == pytest.approx(thresholds.mde_da(r["n_eff"]))
        assert r["feasibility"] == thresholds.feasibility(r["breakeven_da"], r["mde_da"]) and r["harvey_z"] == thresholds.harvey_z(345)
        assert math.ceil(r["n_eff_required"]) == thresholds.required_n(r["breakeven_da"]) and r["stability_windows"] == 2


def test_neighbour_search_equals_all_pairs():
    rng = np.random.default_rng(12)
    cases = [rng.normal(size=(2, 700)), rng.random((2, 5)), np.round(rng.normal(size=(2, 300)), 1) + 1e-10 * rng.normal(size=(2, 300)), np.stack([np.zeros(90), rng.normal(size=90)]), np.stack([np.arange(400.0)] * 2)]
    for x, y in cases:
        for k in (1, 3, 4):
            d = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
            assert (validation.kth_distances(x, y, k) == np.sort(d, axis=1)[:, k]).all()
    x, y = rng.normal(size=(2, 20_000))
    assert validation.mutual_information(x, x + y) == pytest.approx(0.5 * math.log(2), abs=0.03)


def test_exact_quantiles_equal_sorted_values(spark, monkeypatch):
    from tidemark.functions import quantiles

    rng = np.random.default_rng(13)
    data = {"a": rng.normal(size=5000), "b": np.round(rng.normal(size=3000), 1), "c": np.array([2.0]), "d": np.full(50, 7.0), "e": rng.normal(size=7), "n": np.array([np.nan])}
    rows = [(k, None if v != v else float(v), float(i)) for k, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "asset string, v double, w double").repartition(6)
    shares = (0.0, 0.01, 0.35, 0.5, 0.99, 1.0)
    for accuracy in (10_000, 50):  # a coarse sketch brackets widely and stays exact
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        got = {r["asset"]: r for r in quantiles.exact_quantiles(df, ["v", "w"], shares, ["asset"]).collect()}
        for k, x in data.items():
            if k == "n":
                assert got[k]["q_v"] == [None] * 6
            else:
                assert got[k]["q_v"] == pytest.approx(list(np.quantile(x, shares)), rel=1e-12, abs=1e-12)
            assert got[k]["q_w"] == pytest.approx(list(np.quantile(np.arange(len(x)), shares)))
