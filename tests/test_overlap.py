"""Overlapping labels against matrices of labels x times."""

import numpy as np
import pytest

from tidemark.operators import overlap


def random_labels(n, seed, longest=15):
    rng = np.random.default_rng(seed)
    start = rng.integers(0, 3 * n, n)
    return start, start + rng.integers(1, longest, n)


def matrix(start, end):
    return np.array([[float(a <= t < b) for t in range(int(end.max()))] for a, b in zip(start, end)])


def direct(n, horizon, draws, rng):
    """All labels' uniqueness anew before each draw."""
    alive, out = np.zeros(n + horizon - 1), []
    for _ in range(draws):
        u = np.lib.stride_tricks.sliding_window_view(1.0 / (alive + 1.0), horizon).mean(axis=1)
        i = int(rng.choice(n, p=u / u.sum()))
        alive[i : i + horizon] += 1
        out.append(i)
    return out


def frame(spark, *assets):
    rows = [(f"x{k}", i, int(a), int(b)) for k, (start, end) in enumerate(assets) for i, (a, b) in enumerate(zip(start, end))]
    return spark.createDataFrame(rows, "asset string, label long, start long, end long")


@pytest.mark.parametrize("segment", [7.0, 4096.0])
def test_uniqueness_and_concurrency_of_irregular_labels(spark, segment):
    sets = [random_labels(80, 1), random_labels(40, 2, 60), (np.array([5, 5, 5]), np.array([6, 6, 200]))]
    df = frame(spark, *sets)
    got = {(r["asset"], r["label"]): r["uniqueness"] for r in overlap.uniqueness(df, segment).collect()}
    steps = overlap.concurrency(df, segment).collect()
    assert len(got) == 123
    for k, (start, end) in enumerate(sets):
        m = matrix(start, end)
        alive = m.sum(axis=0)
        want = (m / np.maximum(alive, 1)).sum(axis=1) / m.sum(axis=1)
        assert [got[f"x{k}", i] for i in range(len(start))] == pytest.approx(list(want), rel=1e-12)
        seen = np.zeros(len(alive))
        for r in (r for r in steps if r["asset"] == f"x{k}"):
            seen[int(r["at"]) : int(r["until"])] = r["alive"]
        assert (seen == alive).all()


def test_indicator_and_empty_labels(spark):
    start, end = random_labels(20, 3)
    got = {(r["label"], r["at"]) for r in overlap.indicator(frame(spark, (start, end))).collect()}
    assert got == {(i, t) for i, row in enumerate(matrix(start, end)) for t in np.flatnonzero(row)}
    none = frame(spark, (start, end)).limit(0)
    assert overlap.uniqueness(none).count() == overlap.concurrency(none).count() == overlap.sequential_bootstrap(none, 2).count() == 0
    same = frame(spark, (np.array([3, 4]), np.array([3, 6])))
    assert [tuple(r) for r in overlap.uniqueness(same).collect()] == [("x0", 1, 1.0)]


def test_sum_tree():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 64, 100):
        v = rng.random(n) * (rng.random(n) > 0.3) + 1e-9
        t = overlap.SumTree(v.copy())
        for _ in range(20):
            a = rng.integers(0, n)
            new = rng.random(rng.integers(1, n - a + 1))
            v[a : a + len(new)] = new
            t.replace(a, new)
            assert t.levels[-1][0] == pytest.approx(v.sum())
            u = rng.random()
            assert t.find(u) == np.searchsorted(np.cumsum(v), u * v.sum(), "right")
    assert overlap.SumTree(np.array([0.0, 0.0, 1.0])).find(0.0) == 2


@pytest.mark.parametrize("n,horizon", [(1, 3), (30, 1), (60, 7), (40, 50)])
def test_draws_equal_the_direct_form(n, horizon):
    start = np.arange(n)
    got, given = overlap.drawn(start, start + horizon, 50, np.random.default_rng(9))
    assert got.tolist() == direct(n, horizon, 50, np.random.default_rng(9))
    assert ((given > 0) & (given <= 1)).all()


def test_draws_of_irregular_labels_equal_the_direct_form():
    start, end = (x[np.argsort(s, kind="stable")] for s in [random_labels(50, 6)[0]] for x in random_labels(50, 6))
    m, rng, other = matrix(start, end), np.random.default_rng(1), np.random.default_rng(1)
    got, given = overlap.drawn(start, end, 60, rng)
    alive = np.zeros(m.shape[1])
    for i, u in zip(got, given):
        unique = (m / (alive + 1)).sum(axis=1) / m.sum(axis=1)
        assert i == other.choice(50, p=unique / unique.sum()) and u == pytest.approx(unique[i])
        alive += m[i]


def test_replicates_are_reproducible_and_more_unique(spark):
    df = frame(spark, random_labels(60, 7), random_labels(90, 8))
    sample = overlap.sequential_bootstrap(df, 4)
    rows = sample.collect()
    assert len(rows) == 4 * 150 and sorted(rows) == sorted(overlap.sequential_bootstrap(df.repartition(5), 4).collect())
    u = overlap.sample_uniqueness(sample).collect()
    assert {(r["asset"], r["replicate"]) for r in u} == {(a, k) for a in ("x0", "x1") for k in range(4)}
    for r in u:
        mine = [x for x in rows if (x["asset"], x["replicate"]) == (r["asset"], r["replicate"])]
        m = matrix(*(np.array([int(x[c]) for x in mine]) for c in ("start", "end")))
        assert r["uniqueness"] == pytest.approx(((m / np.maximum(m.sum(axis=0), 1)).sum(axis=1) / m.sum(axis=1)).mean())
        assert r["n"] == len(mine) and r["n_distinct"] == len({x["label"] for x in mine})
    plain = np.random.default_rng(0)
    start, end = random_labels(60, 7)
    flat = []
    for _ in range(40):
        k = plain.integers(0, 60, 60)
        m = matrix(start[k], end[k])
        flat.append(((m / np.maximum(m.sum(axis=0), 1)).sum(axis=1) / m.sum(axis=1)).mean())
    assert np.mean([r["uniqueness"] for r in u if r["asset"] == "x0"]) > np.mean(flat)


def test_weights_by_method(spark):
    df = spark.range(50).selectExpr("'a' AS asset", "timestamp_ntz '2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS timestamp")
    w, n = overlap.weights(df, 8, "subsample")
    assert [r["pos"] for r in w.filter("weight > 0").orderBy("pos").collect()] == list(range(0, 50, 8))
    assert tuple(n.first()) == ("a", 50, 7.0)
    w, n = overlap.weights(df, 8)
    m = matrix(np.arange(50), np.arange(50) + 8)
    want = (m / np.maximum(m.sum(axis=0), 1)).sum(axis=1) / m.sum(axis=1)
    assert [r["weight"] for r in w.orderBy("pos").collect()] == pytest.approx(list(want))
    assert n.first()["n_eff"] == pytest.approx(want.sum() ** 2 / (want**2).sum())
    with pytest.raises(ValueError):
        overlap.weights(df, 8, "other")
