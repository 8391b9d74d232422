"""Boosted trees against a plain recomputation of their splits and leaves, and on held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B


def table(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    return names, spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in [*names, "y"]))


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, np.where(x[:, 0] > 0.3, 2.0, -1.0) + np.where((x[:, 1] > 0) & (x[:, 0] > 0.3), 1.5, 0.0) + 0.1 * rng.normal(size=n)


def test_a_tree_is_the_greedy_best_first_tree(spark):
    x, y = data(400)
    names, df = table(spark, x, y)
    m = B.fit(df, names, "y", rounds=1, leaves=5, rate=1.0, bins=8, least=10, together=1)
    bins = np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(m.edges)])
    g = y - y.mean()
    assert m.starts[0] == pytest.approx(y.mean())
    leaves = {0: np.arange(400)}

    def best(rows):
        found = (0.0, 0, 0)
        for j in range(3):
            for b in range(bins[rows, j].max()):
                left = bins[rows, j] <= b
                if 10 <= left.sum() <= len(rows) - 10:
                    a, c = g[rows][left], g[rows][~left]
                    gain = a.sum() ** 2 / len(a) + c.sum() ** 2 / len(c) - g[rows].sum() ** 2 / len(rows)
                    found = max(found, (gain, -j, -b))
        return found

    for nr in range(4):
        leaf = max(leaves, key=lambda k: best(leaves[k])[0])
        _, j, b = best(leaves[leaf])
        assert list(m.trees[0][0].splits.items())[nr] == (leaf, (-j, -b, 2 * nr + 1, 2 * nr + 2))
        rows = leaves.pop(leaf)
        leaves |= {2 * nr + 1: rows[bins[rows, -j] <= -b], 2 * nr + 2: rows[bins[rows, -j] > -b]}
    assert m.trees[0][0].values == pytest.approx({k: g[r].mean() for k, r in leaves.items()})
    got = [r["s"] for r in m.scores(df, ["s"]).select("s").collect()]
    want = m.starts[0] + m.trees[0][0].predict(bins)
    assert sorted(got) == pytest.approx(sorted(want))


def test_losses_side_by_side_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, size=(3000, 2))
    y = 2 * x[:, 0] + (0.2 + 0.8 * (x[:, 1] > 0)) * rng.normal(size=3000)
    names, train = table(spark, x[:2000], y[:2000])
    _, test = table(spark, x[2000:], y[2000:])
    got = B.quantiles(train, test, names, "y", rounds=25, leaves=8, rate=0.2, bins=16).collect()
    q = np.array([[r[c] for c in ("q05", "q25", "q50", "q75", "q95")] for r in got])
    held = np.array([r["y"] for r in got])
    assert (np.diff(q, axis=1) >= 0).all()
    for k, level in enumerate(B.QUANTILES):
        assert abs((held <= q[:, k]).mean() - level) < 0.035
    wide = (q[:, 4] - q[:, 0])[np.array([r["f1"] > 0 for r in got])].mean()
    assert wide > 2 * (q[:, 4] - q[:, 0])[np.array([r["f1"] <= 0 for r in got])].mean()


def test_classifier_and_edge_cases(spark):
    x, y = data(600, 2)
    names, df = table(spark, x, np.where(y > 0, 1, -1))
    df = df.withColumn("y", F.col("y").cast("int"))
    got = B.classify(df, df, names, rounds=8, leaves=4, bins=8).collect()
    assert np.mean([r["pred"] == r["y"] for r in got]) > 0.97 and all(0.5 <= r["confidence"] <= 1 for r in got)
    some = df.withColumn("f0", F.when(F.col("f0") > 0, F.col("f0")))
    assert B.classify(df, some, names, rounds=1, leaves=2, bins=4).count() == int((x[:, 0] > 0).sum())
    flat = B.fit(df.withColumn("y", F.lit(2.0)), names, "y", rounds=3)
    assert flat.trees == [[]] and flat.starts == [2.0]
    with pytest.raises(ValueError):
        B.fit(df.limit(0), names, "y")
