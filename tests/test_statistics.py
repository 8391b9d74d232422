"""Tests, fits, runs and jobs against independent computations."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tail_columns, tails
from tidemark.operators import backtest, battery, bars, forecast, indicators, models, profiling, recommend, research, thresholds, validation, walkforward
from tidemark.sources import jobs, store

T0 = datetime(2024, 1, 1)


def hours(n, asset="a"):
    return [(asset, T0 + timedelta(hours=i)) for i in range(n)]


def test_tails_as_columns(spark):
    z = [-8.0, -7.0, -3.3, -0.5, 0.0, 1e-9, 0.7, 2.0, 6.9, 9.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(tail_columns.norm_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([tails.norm_cdf(v) for v in z], abs=2e-12)
    cases = [(0.0, 1), (3.84, 1), (0.3, 2), (11.1, 5), (18.3, 10), (30.0, 3), (50.0, 40), (25.0, 25)]
    got = [r[0] for r in spark.createDataFrame(cases, "x double, k int").select(tail_columns.chi2_sf(F.col("x"), F.col("k"))).collect()]
    assert got == pytest.approx([tails.chi2_sf(x, k) for x, k in cases], abs=1e-9)
    p = [0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(profiling.probit(F.col("p"))).collect()]
    assert got == pytest.approx([tails.norm_ppf(v) for v in p], abs=1e-7)
    assert tails.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and tails.t_ppf(0.2, 3) == pytest.approx(-0.978472, abs=1e-5)


def test_unit_root_tests():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=500)
    assert profiling.stationarity(noise)["verdict"] == "stationary"
    walks = [profiling.stationarity(np.random.default_rng(s).normal(size=500).cumsum())["verdict"] for s in range(12)]
    assert walks.count("unit_root") >= 9
    assert profiling.stationarity(np.ones(50))["verdict"] == "inconclusive"
    low, mid = profiling.ADF_LOW, profiling.ADF_HIGH
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):  # MacKinnon's asymptotic critical values
        assert tails.norm_cdf(sum(c * t**i for i, c in enumerate(low))) == pytest.approx(p, abs=2e-3)
    assert sum(c * (-1.61) ** i for i, c in enumerate(low)) == pytest.approx(sum(c * (-1.61) ** i for i, c in enumerate(mid)), abs=0.05)
    # the statistic at its own lags, by the normal equations
    x = noise.cumsum()[:120]
    most = math.ceil(12 * 1.2**0.25)

    def fit(k, skip):
        d = np.diff(x)
        rows = [[x[t], 1.0, *[d[t - j] for j in range(1, k + 1)]] for t in range(skip, len(d))]
        a, y = np.array(rows), d[skip:]
        w = np.linalg.solve(a.T @ a, a.T @ y)
        rss = float(((y - a @ w) ** 2).sum())
        return w, rss, a, y

    best = min(range(most + 1), key=lambda k: len(x[most:-1]) * math.log(fit(k, most)[1] / len(x[most:-1])) + 2 * (k + 2))
    w, rss, a, y = fit(best, best)
    assert profiling.adf(x)[0] == pytest.approx(w[0] / math.sqrt(rss / (len(y) - best - 2) * np.linalg.inv(a.T @ a)[0, 0]), rel=1e-6)


def test_bds_by_counting_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=70)
    eps, n = 1.5 * x.std(ddof=1), 70
    near = abs(x[:, None] - x[None, :]) < eps
    c = np.mean([near[i, j] for i in range(n) for j in range(i + 1, n)])
    k = ((near.sum(1).astype(float) ** 2).sum() - 3 * near.sum() + 2 * n) / (n * (n - 1) * (n - 2))
    for m, stat, p in profiling.bds(x, block=16):
        nm = n - m + 1
        cm = np.mean([all(near[i + t, j + t] for t in range(m)) for i in range(nm) for j in range(i + 1, nm)])
        c1 = np.mean([near[i, j] for i in range(m - 1, n) for j in range(i + 1, n)])
        var = 4 * (k**m + 2 * sum(k ** (m - j) * c ** (2 * j) for j in range(1, m)) + (m - 1) ** 2 * c ** (2 * m) - m * m * k * c ** (2 * m - 2))
        assert stat == pytest.approx(math.sqrt(nm) * (cm - c1**m) / math.sqrt(var))
        assert p == pytest.approx(2 * (1 - tails.norm_cdf(abs(stat))))
    assert [m for m, _, _ in profiling.bds(x)] == [2, 3, 4, 5] and profiling.bds(np.ones(40)) == []
    logistic = [0.3]
    for _ in range(400):
        logistic.append(3.9 * logistic[-1] * (1 - logistic[-1]))
    assert profiling.bds(np.array(logistic))[0][2] < 1e-6


def garch_path(n=1500, seed=1, a=0.15, b=0.75, nu=None):
    rng = np.random.default_rng(seed)
    out, h = [], 1e-4
    for _ in range(n):
        z = rng.normal() if nu is None else rng.standard_t(nu) / math.sqrt(nu / (nu - 2))
        out.append(math.sqrt(h) * z)
        h = 1e-5 + a * out[-1] ** 2 + b * h
    return np.array(out)


def test_garch_laws_and_residual_tests():
    x = garch_path()
    fit = profiling.garch_fit(x)
    assert fit["alpha"] == pytest.approx(0.15, abs=0.07) and fit["alpha"] + fit["beta"] == pytest.approx(0.9, abs=0.08)
    heavy = garch_path(nu=4, seed=3)
    assert profiling.garch_best(heavy)[0] != "normal"
    z = profiling.std_residuals(x, fit)
    assert z.std() == pytest.approx(1.0, abs=0.05)
    assert profiling.arch_lm(x)[1] < 0.01 < profiling.arch_lm(z)[1]
    bias = profiling.sign_bias(np.random.default_rng(8).normal(size=800))
    assert all(0 <= bias[f"{k}_p"] <= 1 for k in ("sign", "negative", "positive", "joint"))
    grid = np.linspace(-40, 40, 400_001)
    for shape in ((), (5.0,), (6.0, 0.4)):  # densities of mean 0 and variance 1
        f = np.exp(profiling.log_density(grid, shape))
        step = grid[1] - grid[0]
        assert f.sum() * step == pytest.approx(1, abs=1e-4) and (f * grid).sum() * step == pytest.approx(0, abs=1e-3)
        assert (f * grid**2).sum() * step == pytest.approx(1, abs=0.02)


def test_shapiro_and_ks():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])  # the published example: W = 0.79
    w, p = forecast.shapiro_wilk(x)
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.004)
    rng = np.random.default_rng(4)
    assert forecast.shapiro_wilk(rng.normal(size=300))[1] > 0.05 > forecast.shapiro_wilk(rng.exponential(size=300))[1]
    assert profiling.ks_normal(rng.normal(size=400))[1] > 0.05 > profiling.ks_normal(rng.exponential(size=400))[1]


def test_ridge_signal_against_noise():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([1.0, -0.5, 0.0]) + rng.normal(size=400) * 0.3
    real, noise = profiling.snr_r2(x, y)
    assert real > 0.8 and abs(noise) < 0.1 and profiling.snr_r2(x[:12], y[:12]) == (0.0, 0.0)


def test_variance_ratios_join():
    rng = np.random.default_rng(7)
    ratios, top, p = profiling.variance_ratios(rng.normal(size=800), 2.0)
    assert [q for _, q, *_ in ratios] == [2, 6, 14, 28] and top == max(abs(r[3]) for r in ratios) and 0 <= p <= 1
    assert [h for h, *_ in profiling.variance_ratios(rng.normal(size=800), 2.0, short=True)[0]] == [1.0, 3.0, 7.0]
    assert [q for _, q, *_ in profiling.variance_ratios(rng.normal(size=800), 0.1)[0]] == [2]


def test_profile_and_pooled_correction(spark):
    x = garch_path(2100)
    rows = [("a", "time_1h", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(x)] + [("b", "volume", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(x[:600])]
    rows += [("c", "volume", T0, 0.1)]
    df = spark.createDataFrame(rows, "asset string, bar_type string, timestamp timestamp_ntz, ret double")
    p = battery.profile_all(df)
    got = {(r["asset"], r["name"], r["parameter"]): (r["value"], r["p"]) for r in p.collect()}
    assert got["a", "n", ""][0] == 2100 and got["b", "acf", "lag=1"][0] == pytest.approx(battery.acf(x[:600], 1)[0])
    assert ("a", "bds", "dim=2") in got and ("b", "garch", "alpha") not in got and ("c", "n", "") in got
    assert got["a", "permutation_entropy", "d=3"][0] == pytest.approx(battery.entropy_of(x, 3)[0])
    c = battery.corrected(p).collect()
    assert {r["test"] for r in c} <= set(battery.INFERENTIAL) and all(r["p_adj"] >= r["p"] - 1e-12 for r in c)
    order = sorted((r["p"], r["p_adj"]) for r in c)
    m = len(order)
    for i, (_, adj) in enumerate(order):
        assert adj == pytest.approx(min(1.0, min(order[k][0] * m / (k + 1) for k in range(i, m))))


def test_adaptive_conformal(spark):
    rng = random.Random(3)
    scores = [("a", rng.gauss(0, 1)) for _ in range(80)]
    rows = [("a", T0 + timedelta(hours=i), 0.0, rng.gauss(0, 2)) for i in range(60)]
    got = forecast.adaptive_conformal(spark.createDataFrame(scores, "asset string, residual double"), spark.createDataFrame(rows, "asset string, timestamp timestamp_ntz, pred double, actual double")).orderBy("timestamp").collect()
    alpha, v = 0.1, np.abs([s for _, s in scores])
    for (_, _, p, y), r in zip(rows, got):
        width = float(np.quantile(v, 1 - alpha))
        inside = p - width <= y <= p + width
        assert (r["alpha"], r["upper"], r["covered"]) == (pytest.approx(alpha), pytest.approx(p + width), inside)
        alpha = min(0.5, max(0.001, alpha + 0.01 * ((0.0 if inside else 1.0) - 0.1)))
    assert got[-1]["alpha"] != 0.1


def test_gate_decision(spark):
    base = [("a", f"f{i}", 0.001 if i < 6 else 0.2, 0.01, 0.6, 0.5, 1.0, True) for i in range(7)]
    schema = "asset string, feature string, p_mi double, p_da double, da double, da_null double, stable_share double, stable boolean"
    got = {r["feature"]: r["kept"] for r in validation.keep(spark.createDataFrame(base, schema)).collect()}
    assert got == {f"f{i}": i < 6 for i in range(7)}
    weak = [("a", f"f{i}", 0.5, 0.5, 0.5 + i / 100, 0.5, 0.1, False) for i in range(7)]
    got = {r["feature"]: r["kept"] for r in validation.keep(spark.createDataFrame(weak, schema)).collect()}
    assert got == {f"f{i}": i >= 2 for i in range(7)}  # the five best by DA above its null
    few = validation.keep(spark.createDataFrame(weak[:4], schema)).collect()
    assert not any(r["kept"] for r in few)


def test_gate_batteries(spark):
    rng = np.random.default_rng(1)
    n = 260
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = x + 0.3 * rng.normal(size=n)
    rows = [("a", T0 + timedelta(hours=i), float(x[i]), float(x[i] * 2 + 0.1 * z[i]), float(z[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "asset string, timestamp timestamp_ntz, rv_1 double, rv_2 double, slope_1 double, y double")
    windows = [("2024-01-01", "2024-01-06"), ("2024-01-06", "2024-01-12"), ("2025-01-01", "2025-02-01")]
    report, pairs = validation.validate(df, ["rv_1", "rv_2", "slope_1"], "y", windows, 60, 60, 40, least=3, block=6)
    got = {r["feature"]: r for r in report.collect()}
    assert got["rv_1"]["stable_share"] == 1.0 and got["slope_1"]["stable_share"] < 1.0 and got["rv_1"]["da"] > 0.8
    assert got["rv_1"]["da_null"] == pytest.approx(0.5, abs=0.1) and got["rv_1"]["group"] == "volatility"
    g = pairs.collect()
    assert [r["group"] for r in g] == ["volatility"]
    a = np.column_stack([x, x * 2 + 0.1 * z])
    a, b = a - a.mean(0), y - y.mean()

    def r2(m):
        w = np.linalg.solve(m.T @ m + np.eye(m.shape[1]), m.T @ b)
        return 1 - ((b - m @ w) ** 2).sum() / (b @ b)

    assert g[0]["combined_r2"] == pytest.approx(r2(a)) and g[0]["sum_r2"] == pytest.approx(r2(a[:, :1]) + r2(a[:, 1:])) and g[0]["is_redundant"]
    one = validation.stability(df.select("asset", F.lit("f").alias("feature"), "timestamp", F.col("rv_1").alias("x"), "y"), windows[2:], 10)
    assert one.first()["stable_share"] == 1.0
    with pytest.raises(ValueError):
        validation.validate(df.withColumn("rv_1", F.lit(None).cast("double")), ["rv_1"], "y", windows)


def test_hurst_segments(spark):
    rng = np.random.default_rng(9)
    x = 100 + rng.normal(size=330).cumsum()
    df = spark.createDataFrame([(*k, float(v)) for k, v in zip(hours(330), x)], "asset string, timestamp timestamp_ntz, close double")
    for rows in (64, 30):
        got = [r["hurst_50"] for r in indicators.with_hurst(df, 50, rows).orderBy("timestamp").collect()]
        want = [indicators.hurst_rs(x[i - 49 : i + 1]) if i >= 49 else None for i in range(330)]
        assert len(got) == 330 and all((a is None or a != a) == (b is None or b != b) for a, b in zip(got, want))
        assert [a for a in got if a is not None and a == a] == pytest.approx([b for b in want if b is not None and b == b])
    trend, noise = indicators.hurst_rs(np.arange(200.0) + rng.normal(size=200)), indicators.hurst_rs(rng.normal(size=200))
    assert trend > 0.8 > noise
    # one size by hand: mean rescaled range of blocks
    y = rng.normal(size=40)
    logs = []
    for size in range(10, 21):
        rs = []
        for k in range(40 // size):
            b = y[k * size : (k + 1) * size]
            w = (b - b.mean()).cumsum()
            rs.append((w.max() - w.min()) / b.std(ddof=1))
        logs.append((math.log(size), math.log(sum(rs) / len(rs))))
    s = np.array(logs)
    slope = ((s[:, 0] - s[:, 0].mean()) * s[:, 1]).sum() / ((s[:, 0] - s[:, 0].mean()) ** 2).sum()
    assert indicators.hurst_rs(y) == pytest.approx(min(1.0, max(0.0, slope)))


def priced(spark, n=260, seed=4):
    rng = random.Random(seed)
    rows, p = [], 100.0
    for k in hours(n):
        c = p * math.exp(rng.gauss(0, 0.01))
        rows.append((*k, p, max(p, c) * 1.001, min(p, c) * 0.999, c))
        p = c
    return rows, spark.createDataFrame(rows, "asset string, timestamp timestamp_ntz, open double, high double, low double, close double")


def test_walk_forward_carries_cash(spark):
    rows, df = priced(spark)
    seen = []
    factory = lambda train: seen.append(len(train)) or backtest.buy_and_hold
    curve = walkforward.walk_forward(df, lambda train: backtest.buy_and_hold, 100, 40, size=backtest.fixed_fraction(0.5), cash=1000.0)
    cash, want = 1000.0, []
    assert walkforward.windows_of(260, 100, 40) == [(0, 100, 140), (0, 140, 180), (0, 180, 220), (0, 220, 260)]
    assert walkforward.windows_of(260, 100, 40, 30, expanding=False)[1] == (30, 130, 170)
    secs = [(r[1] - T0).total_seconds() for r in rows]
    for _, a, b in walkforward.windows_of(260, 100, 40):
        part = rows[a:b]
        got = backtest.fold(secs[a:b], *[[r[k] for r in part] for k in (2, 3, 4, 5)], [r[1] for r in part], factory(part), 10.0, cash, backtest.fixed_fraction(0.5))
        want += [(t, e) for t, e, _ in got.curve]
        cash = got.curve[-1][1]
    chain = [(r["timestamp"], r["equity"]) for r in walkforward.chained(curve).orderBy("timestamp").collect()]
    assert [t for t, _ in chain] == [t for t, _ in want] and [e for _, e in chain] == pytest.approx([e for _, e in want])
    trades = walkforward.walk_forward(df, lambda train: backtest.buy_and_hold, 100, 40, size=backtest.fixed_fraction(0.5), trades=True).collect()
    assert [r["window"] for r in sorted(trades, key=lambda r: r["window"])] == [0, 1, 2, 3]
    overlapping = walkforward.chained(walkforward.walk_forward(df, lambda train: backtest.buy_and_hold, 100, 40, step=20))
    assert overlapping.count() == overlapping.select("timestamp").distinct().count() == 160
    with pytest.raises(Exception, match="a window needs"):
        walkforward.walk_forward(df, lambda train: backtest.buy_and_hold, 300, 40).collect()


def test_stops_and_trades_by_hand():
    o, h, lo, c = [10, 10, 12, 11.0], [10, 12, 13, 12.0], [10, 9, 11, 7.0], [10, 11, 12, 8.0]
    times = [T0 + timedelta(hours=i) for i in range(4)]
    got = backtest.fold([0, 3600, 7200, 10800], o, h, lo, c, times, backtest.buy_and_hold, 100.0, 1000.0, backtest.fixed_fraction(0.5))
    # 500 of notional at 10 plus 1 %, closed at the last close of 8
    assert got.trades == [("long", 50.0, 10, 8.0, times[1], times[3], pytest.approx(-100.0), pytest.approx(-100 - 5 - 4), pytest.approx(9.0))]
    assert [e for _, e, _ in got.curve] == pytest.approx([1000, 1000 - 5 + 50, 1000 - 5 + 100, 1000 - 5 - 100 - 4])
    fees = [backtest.fold([0, 3600, 7200, 10800], o, h, lo, c, times, backtest.buy_and_hold, f, 1000.0, backtest.fixed_fraction(0.5)).cash for f in backtest.FEES]
    assert fees == sorted(fees, reverse=True)
    a = backtest.Account(1000.0, 1000.0, side=1, size=10.0, entry=50.0, stop=45.0, take=60.0)
    a.close(45.0, times[0], 0.01)
    assert a.trades[0][6] == -50.0 and a.cash == 1000 + 500 - 50 - 4.5


def test_boosted_trees_and_recommenders(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) * (x[:, 1] > 0.5) + 0.05 * rng.normal(size=600)
    m = models.Boosted().fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) - y[400:]) ** 2).mean() < 0.2 * y[400:].var()
    assert models.Boosted(rounds=3).fit(x[:5], y[:5]).predict(x[:2]) == pytest.approx([y[:5].mean()] * 2)  # too few rows for a split
    r, go, size = recommend.random_recommender(4000, 1)
    assert abs(go.mean() - 0.5) < 0.03 and (abs(r) <= 0.01).all() and (size[~go] == 0).all() and abs((r > 0).mean() - 0.5) < 0.03


def test_recommender_run_stays_within_its_slices(spark):
    rows, df = priced(spark, 300)
    bars_ = df.select("asset", "timestamp", "close")
    signals = df.select("asset", "timestamp", F.when(F.hour("timestamp") % 3 == 0, "flat").otherwise(F.when(F.hour("timestamp") % 2 == 0, "long").otherwise("short")).alias("side"))
    market = df.select("asset", "timestamp", F.col("close").alias("volatility"))
    got = recommend.run(bars_, signals, market, {}, ["volatility", "absent"], windows=3, purge=4, embargo=2)
    rec = [r for r in got.collect() if r["recommender"] == "gradient_boosting"]
    want = {}
    from tidemark.operators.cv import pipeline_splits

    for w, (a, b, c, d) in enumerate(pipeline_splits(300, 3, 0.6, 4, 2)):
        for i in range(c, d - 7):  # a label needs the close seven bars on, within the slice
            t = rows[i][1]
            if t.hour % 3:
                ratio = rows[i + 7][5] / rows[i][5] - 1
                want[w, t] = (ratio if t.hour % 2 == 0 else -ratio) - 0.002
    assert {(r["window"], r["timestamp"]): r["actual"] for r in rec} == pytest.approx(want)
    assert all(r["deploy"] == (r["pred"] > 0) and 0 <= r["size"] <= 1 and 0 <= r["confidence"] <= 1 for r in rec)
    chance = [r for r in got.collect() if r["recommender"] == "random"]
    assert len(chance) == len(rec) and all(r["size"] == 0 for r in chance if not r["deploy"])


def test_conformal_quantile_is_exact(spark):
    rng = random.Random(1)
    rows = [(a, rng.choice([rng.gauss(0, 1), 0.5])) for a in "ab" for _ in range(rng.randint(5, 90))] + [("c", 1.0)]
    got = {r["asset"]: r["q"] for r in recommend.conformal_quantile(spark.createDataFrame(rows, "asset string, r double"), F.col("r")).collect()}
    for a in "abc":
        v = np.abs([r for k, r in rows if k == a])
        assert got[a] == pytest.approx(np.quantile(v, min(1.0, 0.9 * (1 + 1 / len(v)))))


def test_ingest_jobs(spark, tmp_path):
    store.drop(spark, "job_candles")
    store.create(spark, "job_candles", store.OHLCV, ("asset", "timeframe"))
    start, hour = 1_704_067_200_000, 3_600_000

    def call(asset, timeframe, cursor):
        first = max(0, (cursor - start + hour - 1) // hour)
        return [[start + i * hour, "1.5", "2", "1", str(1 + i / 100), "3.5"] for i in range(first, min(first + 10, 48 if asset == "x" else 0))]

    got = jobs.ingest_universe(spark, call, "job_candles", ["x", "y"], ["1h"], start, start + 30 * hour)
    assert got == {("x", "1h"): 30, ("y", "1h"): 0}
    assert jobs.ingest_asset(spark, call, "job_candles", "x", "1h", start, start + 30 * hour) == 0
    assert jobs.ingest_asset(spark, call, "job_candles", "x", "1h", start, start + 48 * hour, incremental=True) == 18
    argv = ["--assets", "x", "--start", "2024-01-01", "--end", "2024-01-02", "--table", "job_candles", "--incremental"]
    assert jobs.main_ingest(spark, call, argv) == {("x", "1h"): 0}
    paths = jobs.main_bars(spark, ["--assets", "x", "--bar-types", "tick", "volume", "--threshold", "7", "--source", "job_candles", "--out", str(tmp_path)])
    assert len(paths) == 2 and spark.read.parquet(paths[0]).count() == bars.bars(spark.table("job_candles").select("asset", "timestamp", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]), "tick", 7.0).count()
    store.drop(spark, "job_candles")


def test_config_hash_names_fields_in_order():
    import hashlib

    text = '{"bar_type":"tick","threshold":1000.0,"ewm_span":100,"warmup_period":100}'
    assert bars.config_hash("tick", 1000) == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_bootstraps(spark):
    df = spark.createDataFrame([("a", i % 2, i % 2 if i % 5 else 1 - i % 2) for i in range(500)], "asset string, y int, pred int")
    r = forecast.bootstrap_accuracy(df, ["asset"]).first()
    half = 1.96 * math.sqrt(0.8 * 0.2 / 500)
    assert r["da"] == 0.8 and r["low"] == pytest.approx(0.8 - half, abs=0.006) and r["high"] == pytest.approx(0.8 + half, abs=0.006)
    with pytest.raises(NotImplementedError):
        forecast.wdl()


def test_shuffled_labels_of_a_fair_learner(spark):
    rng = random.Random(2)
    rows = [("a", T0 + timedelta(hours=i), rng.choice([1, -1]), rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "asset string, timestamp timestamp_ntz, y int, x double")
    seen = []

    def fit(train, test, names):
        seen.append(sorted(r["y"] for r in train.select("y").collect()))
        return test.withColumn("pred", F.when(F.hour("timestamp") % 2 == 0, 1).otherwise(-1))

    got = forecast.shuffled_labels(df.limit(400), df, ["x"], fit, 2).collect()
    assert len(got) == 2 and got[0]["mean_da"] == pytest.approx(sum(r["da"] for r in got) / 2) and seen[0] == seen[1]


def test_result_tables_of_a_profile(spark):
    rows = [("a", "t", "n", "", 900.0, None), ("a", "t", "n_eff", "", 450.0, None), ("b", "t", "n", "", 800.0, None), ("b", "t", "n_eff", "", 700.0, None), ("a", "t", "variance_ratio", "horizon=1.0d", 1.1, 0.2)]
    p = spark.createDataFrame(rows, "asset string, bar_type string, name string, parameter string, value double, p double")
    assert [(r["asset"], r["ratio"]) for r in research.n_eff_table(p).collect()] == [("b", 0.875), ("a", 0.5)]
    assert [tuple(r) for r in research.profile_rows(p, "variance_ratio", "horizon", "vr").collect()] == [("a", "t", "horizon=1.0d", 1.1, 0.2)]
    assert thresholds.feasibility(0.6, 0.55) == "feasible"
    s = pd.Series(np.random.default_rng(1).normal(size=50))
    d = spark.createDataFrame([("a", float(v)) for v in s], "asset string, v double")
    r = research.distributions(d, ["v"], ["asset"]).first()
    assert r["skew"] == pytest.approx(s.skew()) and r["kurtosis"] == pytest.approx(s.kurtosis()) and r["median"] == pytest.approx(s.median())


def test_recurrent_gradients_and_fits(spark):
    from tidemark.operators.recurrent import Gru, recurrent_forecast

    rng = np.random.default_rng(4)
    net = Gru(3, hidden=4, layers=2, seed=1)
    x, y = rng.normal(size=(5, 6, 3)), rng.integers(0, 2, 5).astype(float)
    masks = net.masks(5, 6)
    for classes in (True, False):
        z, kept = net.forward(x, masks)
        grads = net.backward(kept, masks, net.loss(z, y, classes)[1])
        for i, p in enumerate(net.p):  # against finite differences
            for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]:
                old, ends = p[at], []
                for d in (1e-6, -1e-6):
                    p[at] = old + d
                    ends.append(net.loss(net.forward(x, masks)[0], y, classes)[0])
                p[at] = old
                assert grads[i][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)
    s = np.sin(np.arange(400) / 5)
    rows = [("a", T0 + timedelta(hours=i), float(s[i]), float(s[i + 1] - s[i]), 1 if s[i + 1] > s[i] else -1) for i in range(399)] + [("b", T0, 0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "asset string, timestamp timestamp_ntz, x double, move double, side int")
    got = recurrent_forecast(df, ["x"], "side", True, steps=8, hidden=12, epochs=40, passes=10).collect()
    true = {(r[0], r[1]): r for r in rows}
    assert len(got) == 399 - int(399 * 0.7) and all(0.5 <= r["spread"] <= 1 for r in got)
    assert np.mean([r["pred"] == true["a", r["timestamp"]][4] for r in got]) > 0.85
    moves = recurrent_forecast(df, ["x"], "move", False, steps=8, hidden=12, epochs=40, passes=10).collect()
    assert np.corrcoef([r["pred"] for r in moves], [true["a", r["timestamp"]][3] for r in moves])[0, 1] > 0.8
