"""Sweeps, variance inflation, ablation, Granger and HAR against NumPy on whole matrices."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import matrices, tail_columns, tails
from tidemark.operators import linear, profiling

T0 = datetime(2024, 1, 1)


def frame(spark, x, names, asset="a"):
    rows = [(asset, T0 + timedelta(hours=i), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "asset string, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in names))


def test_sweeps_fit_and_undo(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 1e4
    df = matrices.moments(frame(spark, x, "pqrs"), list("pqrs"), ["asset"])
    r = df.select("n", "means", "cross", matrices.swept(F.col("cross"), [0, 2, 1], 0.0).alias("m")).withColumn("back", matrices.swept(F.col("m"), [1, 0], 0.0, back=True))
    r = r.withColumn("less", matrices.swept(F.col("cross"), [2], 0.0)).first()
    d = x - x.mean(axis=0)
    c = d.T @ d
    assert r["n"] == 200 and np.allclose(r["means"], x.mean(axis=0)) and np.allclose(r["cross"], c)
    m = np.array(r["m"])
    b = np.linalg.solve(c[:3, :3], c[:3, 3])
    assert np.allclose(m[:3, 3], b) and np.allclose(m[3, :3], b) and np.allclose(m[:3, :3], -np.linalg.inv(c[:3, :3])) and m[3, 3] == pytest.approx(c[3, 3] - b @ c[:3, 3])
    assert np.allclose(r["back"], r["less"])


def test_variance_inflation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    x[:, 3] = x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=300)
    names = list("pqrst")
    got = {r["feature"]: r["vif"] for r in linear.vif(frame(spark, x, names), names).collect()}
    want = []
    for j in range(5):
        a = np.column_stack([np.ones(300), np.delete(x, j, 1)])
        e = x[:, j] - a @ np.linalg.lstsq(a, x[:, j], rcond=None)[0]
        want.append(((x[:, j] - x[:, j].mean()) ** 2).sum() / (e @ e))
    assert [got[c] for c in names] == pytest.approx(want, rel=1e-8) and max(want) > 50
    # rows that are not finite go; exact relations, constants and short groups are infinite; the others keep their value
    y = np.column_stack([x[:, :3], x[:, 0] + 2 * x[:, 1], np.full(300, 3.0)])
    y[5, 2], y[6, 0] = np.nan, np.inf
    other = frame(spark, y, names).unionByName(frame(spark, y[:6], names, "few"))
    got = {(r["asset"], r["feature"]): r["vif"] for r in linear.vif(other, names).collect()}
    assert [got["a", c] for c in "pqst"] == [math.inf] * 4 and got["a", "r"] < 1.1
    assert all(got["few", c] == math.inf for c in names)
    assert linear.vif(other.limit(0), names).count() == 0
    with pytest.raises(ValueError):
        linear.vif(other, [])


def ridge(x, y, alpha):
    d = x - x.mean(axis=0)
    b = np.linalg.solve(d.T @ d + alpha * np.eye(x.shape[1]), d.T @ (y - y.mean()))
    return lambda z: y.mean() + (z - x.mean(axis=0)) @ b


def dm_test(a, b):
    d = a - b
    n, h = len(d), int(len(d) ** (1 / 3))
    e = d - d.mean()
    v = (e @ e) / n + sum(2 * (1 - k / (h + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, h + 1))
    dm = d.mean() / math.sqrt(v / n)
    return dm, 2 * tails.t_sf(abs(dm), n - 1)


def test_ablations_equal_refits(spark):
    rng = np.random.default_rng(3)
    names = ["clf_confidence", "clf_direction", "reg_prediction_std", "vol_regime", "other"]
    x = rng.normal(size=(500, 5))
    x[:, 4] += x[:, 0]
    y = x @ [0.5, -0.3, 0.0, 0.2, 0.1] + rng.normal(size=500)
    df = frame(spark, np.column_stack([x, y]), [*names, "actual"])
    cut = F.lit(T0 + timedelta(hours=350)).cast("timestamp_ntz")
    groups = linear.GROUPS | {"none": ("missing",), "all": names}
    got = {r["grp"]: r for r in linear.ablation(df.filter(F.col("timestamp") < cut), df.filter(F.col("timestamp") >= cut), names, groups=groups).collect()}
    full = (y[350:] - ridge(x[:350], y[:350], 1.0)(x[350:])) ** 2
    assert set(got) == set(groups)
    for g in linear.GROUPS:
        keep = [k for k, c in enumerate(names) if c not in groups[g]]
        loss = (y[350:] - ridge(x[:350][:, keep], y[:350], 1.0)(x[350:][:, keep])) ** 2
        r, (dm, p) = got[g], dm_test(full, loss)
        assert (r["n_removed"], r["n_remaining"], r["n"]) == (5 - len(keep), len(keep), 150)
        assert (r["rmse_full"], r["rmse"], r["mean_loss"]) == pytest.approx((math.sqrt(full.mean()), math.sqrt(loss.mean()), loss.mean()), rel=1e-9)
        assert r["dm"] == pytest.approx(dm, rel=1e-6) and r["p"] == pytest.approx(p, abs=1e-8)
    assert got["classifier"]["dm"] < -2 and got["none"]["n_removed"] == 0 and got["none"]["dm"] is None and got["none"]["rmse_change"] == 0
    assert got["all"]["n_remaining"] == 0 and got["all"]["rmse"] is None and got["all"]["dm"] is None


def granger_p(x, y, k):
    """The F test by two whole regressions."""
    n = len(y) - k
    own = np.column_stack([np.ones(n), *[y[k - j : len(y) - j] for j in range(1, k + 1)]])
    full = np.column_stack([own, *[x[k - j : len(x) - j] for j in range(1, k + 1)]])
    r0, r1 = (float(((y[k:] - a @ np.linalg.lstsq(a, y[k:], rcond=None)[0]) ** 2).sum()) for a in (own, full))
    return tails.f_sf((r0 - r1) / k / (r1 / (n - 2 * k - 1)), k, n - 2 * k - 1)


def test_granger_equals_the_full_regressions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = np.concatenate([[0, 0], 0.3 * x[:-2]]) + rng.normal(size=400)
    df = frame(spark, np.column_stack([x, y]), ["x", "y"])
    for a, b, cause, effect in ((x, y, "x", "y"), (y, x, "y", "x")):
        got = {r["lag"]: r["p"] for r in linear.granger(df, cause, effect, [1, 2, 4]).collect()}
        assert [got[k] for k in (1, 2, 4)] == pytest.approx([granger_p(a, b, k) for k in (1, 2, 4)], rel=1e-7, abs=1e-12)
    assert linear.granger(df.limit(4), "x", "y", [2]).first()["p"] is None


def test_har_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    v = np.abs(rng.normal(size=200)).cumsum() / np.arange(1, 201) + 0.1 * rng.random(200)
    series = {"a": v, "b": v[::-1][:120]}
    df = frame(spark, v[:, None], ["rv"]).unionByName(frame(spark, series["b"][:, None], ["rv"], "b"))
    got = sorted((tuple(r) for r in linear.har(df).collect()), key=lambda r: r[:2])
    want = []
    for asset, x in series.items():
        m = np.array([[1, x[t - 1], x[t - 5 : t].mean(), x[t - 22 : t].mean()] for t in range(22, len(x))])
        y, cut = x[22:], int(len(m) * 0.7)
        w = np.linalg.lstsq(m[:cut], y[:cut], rcond=None)[0]
        want += [(asset, T0 + timedelta(hours=22 + t), math.sqrt(max(1e-12, p))) for t, p in zip(range(cut, len(m)), m[cut:] @ w)]
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], rel=1e-7)


def test_arch_and_sign_bias_equal_the_regressions(spark):
    rng = np.random.default_rng(8)
    x, h = [], 1.0
    for _ in range(500):
        x.append(math.sqrt(h) * rng.normal())
        h = 0.1 + 0.2 * x[-1] ** 2 + (0.3 * x[-1] ** 2 if x[-1] < 0 else 0) + 0.5 * h
    x = np.array(x)
    df = frame(spark, x[:, None], ["ret"]).unionByName(frame(spark, np.ones((20, 1)), ["ret"], "flat"))
    got = {r["asset"]: r for r in linear.arch_lm(df).collect()}
    assert (got["a"]["lm"], got["a"]["p"]) == pytest.approx(profiling.arch_lm(x), rel=1e-8, abs=1e-12) and got["flat"]["lm"] is None
    r, want = linear.sign_bias(df.filter("asset = 'a'")).first(), profiling.sign_bias(x / x.std())
    assert {k: r[k] for k in want} == pytest.approx(want, rel=1e-8, abs=1e-10)


def test_ks_of_columns_equals_the_kernel(spark):
    rng = np.random.default_rng(9)
    series = {"n": rng.normal(3, 2, 300), "e": rng.exponential(size=300), "t": np.repeat(rng.normal(size=40), 3), "flat": np.ones(9), "one": np.ones(1)}
    df = None
    for name, x in series.items():
        one = frame(spark, x[:, None], ["ret"], name)
        df = one if df is None else df.unionByName(one)
    for r in profiling.ks_test(df).collect():
        d, p = profiling.ks_normal(series[r["asset"]])
        assert (r["ks"], r["p"]) == (None, None) if d != d else (r["ks"], r["p"]) == pytest.approx((d, p), abs=1e-9)


def test_student_quantile_data(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_t(5, 60)
    fits = spark.createDataFrame([("a", 4.5, 0.1, 1.3)], "asset string, nu double, loc double, scale double")
    got = profiling.qq_student(frame(spark, x[:, None], ["ret"]), fits).orderBy("p").collect()
    assert [r["ordered"] for r in got] == pytest.approx(sorted(x))
    assert [r["theoretical"] for r in got] == pytest.approx([0.1 + 1.3 * tails.t_ppf((i - 0.375) / 60.25, 4.5) for i in range(1, 61)], rel=1e-8)


def test_beta_tails_as_columns(spark):
    t = [(a, v) for a in (-30.0, -2.5, -0.3, 0.0, 1e-6, 0.7, 1.96, 4.0, 200.0) for v in (1.0, 2.0, 3.5, 10.0, 57.0, 250000.0)]
    got = [r[0] for r in spark.createDataFrame(t, "t double, v double").select(tail_columns.t_sf(F.col("t"), F.col("v"))).collect()]
    assert got == pytest.approx([tails.t_sf(*r) for r in t], abs=1e-10, rel=1e-9)
    f = [(x, a, b) for x in (0.0, 0.01, 0.5, 1.0, 9.0, 80.0) for a in (1, 2, 5, 30) for b in (1, 4, 300, 20000)]
    got = [r[0] for r in spark.createDataFrame(f, "f double, a int, b int").select(tail_columns.f_sf(F.col("f"), F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([tails.f_sf(*r) for r in f], abs=1e-10)
    q = [(p, v) for p in (1e-4, 0.01, 0.2, 0.5, 0.6, 0.975, 0.9999) for v in (0.6, 1.0, 2.0, 7.5, 40.0, 5000.0)]
    got = [r[0] for r in spark.createDataFrame(q, "p double, v double").select(tail_columns.t_ppf(F.col("p"), F.col("v"))).collect()]
    assert got == pytest.approx([tails.t_ppf(*r) for r in q], rel=1e-8, abs=1e-10)
    x = [0.001, 0.5, 1.0, 2.0, 9.3, 100.0, 12345.6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(tail_columns.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-13)
