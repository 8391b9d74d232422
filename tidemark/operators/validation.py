"""The statistical gate on features: permutation nulls, single-feature tests, stability, redundancy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import GROUPS


def block_permute(x: np.ndarray, block: int, rng: np.random.Generator) -> np.ndarray:
    """x with its contiguous blocks shuffled (the last may be short); a copy if one block holds all."""
    if block >= len(x):
        return x.copy()
    parts = [x[i : i + block] for i in range(0, len(x), block)]
    return np.concatenate([parts[i] for i in rng.permutation(len(parts))])


#: Points of a leaf of the neighbour search, about.
LEAF = 24


def kth_distances(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The distance in the maximum norm from each point (x, y) to its k-th nearest other one.

    Points are halved along the wider side of their box down to leaves. A leaf's own points bound its distances; then only
    leaves whose box is no further than that are looked at, so the work is n log n and not n^2.
    """
    n, leaf = len(x), max(LEAF, 3 * (k + 1))
    points = np.stack([x, y])
    order, ends, todo = np.arange(n), [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            ends.append((a, b))
            continue
        own = points[:, order[a:b]]
        wider = int(np.ptp(own[1]) > np.ptp(own[0]))
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[wider], half)]
        todo += [(a, a + half), (a + half, b)]
    ends.sort()
    starts = np.array([a for a, _ in ends])
    placed = points[:, order]
    low, high = np.minimum.reduceat(placed, starts, axis=1), np.maximum.reduceat(placed, starts, axis=1)
    out = np.empty(n)
    for i, (a, b) in enumerate(ends):
        mine = placed[:, a:b]
        far = lambda other: np.maximum(abs(mine[0][:, None] - other[0]), abs(mine[1][:, None] - other[1]))  # noqa: B023, E731
        bound = np.partition(far(mine), k, axis=1)[:, k].max() if b - a > k else np.inf
        apart = np.maximum(np.maximum(low - high[:, i : i + 1], low[:, i : i + 1] - high), 0.0).max(axis=0)
        near = [slice(*ends[j]) for j in np.flatnonzero(apart <= bound)]
        others = np.concatenate([placed[:, s] for s in near], axis=1)
        out[order[a:b]] = np.partition(far(others), k, axis=1)[:, k]
    return out


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Kraskov's nearest-neighbour estimate (first form) in nats, 0 at least. Noise of 1e-10 deviations parts equal values."""
    from ..functions.digamma import digamma

    n = len(x)
    if n <= k + 1:
        return 0.0
    scale = lambda v: (v - v.mean()) / (v.std() or 1.0)
    noise = np.random.default_rng(0).normal(size=(2, n)) * 1e-10
    x, y = scale(x) + noise[0], scale(y) + noise[1]
    r = np.nextafter(kth_distances(x, y, k), 0)
    within = lambda v, s: np.searchsorted(s, v + r, "right") - np.searchsorted(s, v - r, "left") - 1
    total = (digamma(within(x, np.sort(x)) + 1) + digamma(within(y, np.sort(y)) + 1)).sum()
    return max(0.0, float(digamma(np.array([k]))[0] + digamma(np.array([n]))[0] - total / n))


def ridge_accuracy(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, split: float = 0.7) -> tuple[float, float]:
    """(directional accuracy, DC-MAE) on the last rows of a one-feature ridge fitted to the first."""
    cut = int(len(x) * split)
    a, b = x[:cut], y[:cut]
    slope = ((a - a.mean()) @ (b - b.mean())) / (((a - a.mean()) ** 2).sum() + alpha)
    pred, true = b.mean() + slope * (x[cut:] - a.mean()), y[cut:]
    both = (np.sign(pred) != 0) & (np.sign(true) != 0)
    right = np.sign(pred) == np.sign(true)
    da = float(right[both].mean()) if both.any() else 0.5
    return da, float(abs(true - pred)[right].mean()) if right.any() else float("inf")


COLUMNS = ["asset", "feature", "mi", "da", "dc_mae", "above_mi", "above_da", "sum_da", "n", "n_da"]


def permutation_tests(long: DataFrame, permutations: int = 200, block: int = 50, seed: int = 42, per_task: int = 50, ridge: int | None = None) -> DataFrame:
    """(asset, feature, mi, da, dc_mae, p_mi, p_da, da_null) of long(asset, feature, timestamp, x, y); da_null: mean of the null.

    The work is features x permutations: each series is repeated once for each batch of `per_task` permutations and
    the batches run in parallel; batch b's permutation i uses the seed's stream b * per_task + i. The empirical p is
    (nulls at or above + 1) / (permutations + 1). The ridge's null has the first `ridge` permutations only, if given.
    """
    ridge = permutations if ridge is None else min(ridge, permutations)
    batches = -(-permutations // per_task)
    each = long.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("timestamp", kind="stable").dropna()
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        if len(x) < 30:
            return pd.DataFrame(columns=COLUMNS)
        mi, (da, dc) = mutual_information(x, y), ridge_accuracy(x, y)
        first = key[2] * per_task
        count = min(per_task, permutations - first)
        m = d = 0
        null = 0.0
        for i in range(first, first + count):
            z = block_permute(y, block, np.random.default_rng(seed + i + 1))
            m += mutual_information(x, z) >= mi
            if i < ridge:
                other = ridge_accuracy(x, z)[0]
                d += other >= da
                null += other
        return pd.DataFrame([(key[0], key[1], mi, da, dc, m, d, null, count, max(0, min(count, ridge - first)))], columns=COLUMNS)

    got = each.groupBy("asset", "feature", "batch").applyInPandas(one, "asset string, feature string, mi double, da double, dc_mae double, above_mi long, above_da long, sum_da double, n long, n_da long")
    total = [F.sum(c).alias(c) for c in ("above_mi", "above_da", "sum_da", "n", "n_da")]
    s = got.groupBy("asset", "feature").agg(*[F.first(c).alias(c) for c in ("mi", "da", "dc_mae")], *total)
    p = lambda above, n: (F.col(above) + 1) / (F.col(n) + 1)
    null = F.try_divide("sum_da", "n_da")
    return s.select("asset", "feature", "mi", "da", "dc_mae", p("above_mi", "n").alias("p_mi"), p("above_da", "n_da").alias("p_da"), null.alias("da_null"))


def group_of(feature: Column) -> Column:
    """The first group one of whose prefixes the name starts with, else other."""
    out = None
    for group, prefixes in GROUPS.items():
        for p in prefixes:
            hit = F.startswith(feature, F.lit(p))
            out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("other")


def stability(long: DataFrame, windows: list[tuple[str, str]], permutations: int = 500, least: int = 100, alpha: float = 0.05, threshold: float = 0.5, **kw) -> DataFrame:
    """(asset, feature, stable_share, stable) for every asset and feature of long: the share of the time windows [a, b) of
    at least `least` rows in which the feature's mutual information is significant (raw permutation p below alpha).

    All windows' tests run side by side, as assets of their own. With fewer than two windows an asset's features count as
    stable.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("w"), F.lit(a).cast("timestamp_ntz").alias("a"), F.lit(b).cast("timestamp_ntz").alias("b")) for i, (a, b) in enumerate(windows)]))
    when = F.col("timestamp").cast("timestamp_ntz")
    each = long.withColumn("__k", keys).filter((when >= F.col("__k.a")) & (when < F.col("__k.b")))
    rows = each.groupBy("asset", "feature", "__k.w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    kept = each.select("asset", "feature", "timestamp", "x", "y", "__k.w").join(rows.select("asset", "feature", "w"), ["asset", "feature", "w"])
    tests = permutation_tests(kept.withColumn("asset", F.concat_ws("\x01", "asset", "w")), permutations, ridge=0, **kw)
    tests = tests.select(F.element_at(F.split("asset", "\x01"), 1).alias("asset"), "feature", (F.col("p_mi") < alpha).cast("double").alias("hit"))
    share = tests.groupBy("asset", "feature").agg(F.avg("hit").alias("s"), F.count(F.lit(1)).alias("k"))
    out = long.select("asset", "feature").distinct().join(share, ["asset", "feature"], "left")
    own = F.when(F.coalesce("k", F.lit(0)) < 2, 1.0).otherwise(F.col("s"))
    return out.select("asset", "feature", own.alias("stable_share")).withColumn("stable", F.col("stable_share") >= threshold)


def keep(report: DataFrame, alpha: float = 0.05, least: int = 5) -> DataFrame:
    """report(asset, feature, p_mi, p_da, da, da_null, stable_share, stable) with q_mi (p_mi corrected over an asset's features by
    Benjamini and Hochberg) and kept: q_mi at most alpha, p_da below alpha and stable. If fewer than `least` of an asset
    are kept, and it has as many features, its best `least` by (1 - p_mi) + (da - da_null) + stable_share are kept too.

    One row per feature: a window holds an asset's table of tests.
    """
    from pyspark.sql import Window

    from .profiling import benjamini_hochberg

    d = benjamini_hochberg(report, "p_mi", alpha, ["asset"]).withColumnRenamed("p_adj", "q_mi")
    ok = F.col("reject") & (F.col("p_da") < alpha) & F.col("stable")
    w = Window.partitionBy("asset")
    score = (1 - F.col("p_mi")) + (F.col("da") - F.col("da_null")) + F.col("stable_share")
    d = d.withColumns({"__ok": ok, "__nth": F.row_number().over(w.orderBy(F.desc(score), "feature"))})
    short = (F.sum(F.col("__ok").cast("int")).over(w) < least) & (F.count(F.lit(1)).over(w) >= least)
    return d.withColumn("kept", F.col("__ok") | (short & (F.col("__nth") <= least))).drop("__ok", "__nth", "reject")


def interactions(df: DataFrame, names: list[str], y: str, by: str = "asset", alpha: float = 1.0, tolerance: float = 1.1, least: int = 2) -> DataFrame:
    """(by, group, n_features, combined_r2, sum_r2, ratio, has_interaction, is_redundant) of the feature groups with
    `least` names or more: a ridge on all of a group's features against ridges on each.

    All come from cross products, one aggregate over the rows; the small systems are solved one task per asset.
    """
    cols = [*names, y]
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        group = next((g for g, prefixes in GROUPS.items() for p in prefixes if name.startswith(p)), "other")
        groups.setdefault(group, []).append(i)
    groups = {g: idx for g, idx in groups.items() if len(idx) >= least}
    clean = df.select(by, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    cells = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    one = clean.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in cols]).alias("s"), F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in cells]).alias("xx")
    )

    def solve(batches):
        for g in batches:
            rows = []
            for key, n, s, flat in zip(g[by], g["n"], g["s"], g["xx"]):
                m = np.zeros((len(cols), len(cols)))
                for (i, j), v in zip(cells, flat):
                    m[i, j] = m[j, i] = v
                m -= np.outer(s, s) / n

                def r2(idx: list[int]) -> float:
                    a, b = m[np.ix_(idx, idx)], m[idx, -1]
                    w = np.linalg.solve(a + alpha * np.eye(len(idx)), b)
                    return float((2 * w @ b - w @ a @ w) / m[-1, -1]) if m[-1, -1] > 0 else 0.0

                for group, idx in groups.items():
                    single, both = [r2([i]) for i in idx], r2(idx)
                    rows.append((key, group, len(idx), both, sum(single), both / (sum(single) + 1e-12), both > sum(single), both <= max(single) * tolerance))
            yield pd.DataFrame(rows, columns=[by, "group", "n_features", "combined_r2", "sum_r2", "ratio", "has_interaction", "is_redundant"])

    return one.mapInPandas(solve, f"{by} string, group string, n_features int, combined_r2 double, sum_r2 double, ratio double, has_interaction boolean, is_redundant boolean")


def validate(df: DataFrame, names: list[str], y: str, windows: list[tuple[str, str]], permutations: int = 1000, ridge: int = 500, stable: int = 500, least: int = 5, block: int = 50) -> tuple[DataFrame, DataFrame]:
    """(report, interactions) of df(asset, timestamp, names, y): the four batteries and the decision. NaN, null or infinite values
    are an error. `block`: rows that a permutation keeps together; a window needs many such."""
    checks = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(c) == float("inf"))).alias(c) for c in [*names, y]]).first()
    wrong = [c for c in [*names, y] if checks[c]]
    if wrong:
        raise ValueError(f"NaN, null or infinite values in {wrong}")
    long = df.unpivot(["asset", "timestamp", y], names, "feature", "x").withColumnRenamed(y, "y")
    report = permutation_tests(long, permutations, block, ridge=ridge).join(stability(long, windows, stable, block=block), ["asset", "feature"])
    return keep(report, least=least).withColumn("group", group_of(F.col("feature"))), interactions(df, names, y)
