"""Gradient boosting by leaf-wise trees whose gradient histograms are Spark aggregates; several losses are fitted side by side.

Rows stay distributed: a pass over them gives, for each model, open leaf, feature and bin, the sums of gradients and curvatures,
of which the driver sees models x leaves x features x bins rows at most, whatever the number of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matrices import finite
from ..sources.shared import discard, materialize


@dataclass(frozen=True)
class Loss:
    """squared, logistic (y is 0 or 1; the prediction is a log odds) or pinball at quantile q."""

    kind: str = "squared"
    q: float = 0.5

    def start(self, y: Column) -> Column:
        if self.kind == "pinball":
            return F.percentile_approx(y, self.q, 10_000)
        mean = F.avg(y)
        if self.kind == "squared":
            return mean
        inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), mean))
        return F.log(inside / (1 - inside))

    def gradient(self, y: Column, score: Column) -> tuple[Column, Column]:
        """The slope down which a row's score should go, and the curvature."""
        if self.kind == "squared":
            return y - score, F.lit(1.0)
        if self.kind == "logistic":
            p = 1 / (1 + F.exp(-score))
            return y - p, p * (1 - p)
        return F.when(y > score, self.q).otherwise(self.q - 1.0), F.lit(1.0)


@dataclass
class Tree:
    """Splits (feature, last bin to the left, left and right node) in the order of their making; node 0 is the root."""

    splits: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def place(self, bins: Column, only: set[int] | None = None) -> Column:
        """The leaf of a row of bins."""

        def at(node: int) -> Column:
            if node not in self.splits:
                return F.lit(node)
            j, cut, left, right = self.splits[node]
            return F.when(bins[j] <= cut, at(left)).otherwise(at(right))

        return at(0)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for nr, (j, cut, left, right) in self.splits.items():  # parents come first
            here = node == nr
            node[here] = np.where(bins[here, j] <= cut, left, right)
        size = max([0, *self.values]) + 1
        value = np.zeros(size)
        for nr, v in self.values.items():
            value[nr] = v
        return value[node]


@dataclass
class Model:
    names: list[str]
    edges: list[np.ndarray]
    losses: list[Loss]
    starts: list[float]
    trees: list[list[Tree]]

    def scores(self, df: DataFrame, to: Sequence[str]) -> DataFrame:
        """df's rows that are finite in all names, with each loss's score in the columns `to`."""
        own = df.filter(finite(self.names)).withColumns({f"__x{i}": F.col(c).cast("double") for i, c in enumerate(self.names)})
        # what the tasks need, without df, whose session stays here
        k, edges, starts, trees, columns = len(self.names), self.edges, self.starts, self.trees, [*df.columns, *to]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = np.column_stack([np.searchsorted(e, b.column(b.num_columns - k + i).to_numpy(zero_copy_only=False), "left") for i, e in enumerate(edges)])
                got = [np.full(b.num_rows, s) + sum((t.predict(bins) for t in ts), np.zeros(b.num_rows)) for s, ts in zip(starts, trees)]
                yield pa.RecordBatch.from_arrays([*b.columns[: b.num_columns - k], *map(pa.array, got)], columns)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{c}` double" for c in to)
        return own.mapInArrow(run, schema)


def fit(train: DataFrame, names: Sequence[str], y: str, losses: Sequence[Loss] = (Loss(),), rounds: int = 100, leaves: int = 31, rate: float = 0.1, bins: int = 32, least: int = 20, ridge: float = 0.0, together: int = 4) -> Model:
    """Trees for each loss on train's rows that are finite in names and y.

    A tree grows best leaf first: a pass gives the histograms of its new leaves (of two siblings the larger one's by subtraction),
    and the `together` best leaves are split before the next pass; with 1 it is strictly leaf by leaf. Each round's
    scores are written once, so a lost executor repeats one round. Pinball leaves take the quantile of their residuals.
    """
    names, losses = list(names), list(losses)
    x = train.filter(finite([*names, y])).select(F.array(*[F.col(c).cast("double") for c in names]).alias("x"), F.col(y).cast("double").alias("y"))
    cuts = [k / bins for k in range(1, bins)]
    first = x.agg(F.count(F.lit(1)), *[s.start(F.col("y")) for s in losses], *[F.percentile_approx(F.col("x")[i], cuts, 10_000) for i in range(len(names))]).first()
    if not first[0]:
        raise ValueError("no rows to fit")
    starts, edges = [float(v) for v in first[1 : 1 + len(losses)]], [np.unique(v) for v in first[1 + len(losses) :]]
    place = lambda v, e: F.size(F.filter(F.array(*[F.lit(float(c)) for c in e]), lambda c: c < v))  # noqa: E731  as searchsorted on the left
    binned = F.array(*[place(F.col("x")[i], e) if len(e) else F.lit(0) for i, e in enumerate(edges)])
    rows = materialize(x.select(binned.alias("bins"), "y", F.array(*[F.lit(s) for s in starts]).alias("score")))
    trees: list[list[Tree]] = [[] for _ in losses]
    for _ in range(rounds):
        grown = grow(rows, losses, len(names), leaves, least, ridge, together)
        if not any(t.splits for t in grown):
            break
        fill(rows, losses, grown, rate, ridge)
        add = lambda t, m: F.col("score")[m] + (value_of(t) if t.splits else F.lit(0.0))
        before, rows = rows, materialize(rows.select("bins", "y", F.array(*[add(t, m) for m, t in enumerate(grown)]).alias("score")))
        discard(before)
        for own, t in zip(trees, grown):
            if t.splits:
                own.append(t)
    discard(rows)
    return Model(names, edges, losses, starts, trees)


def value_of(t: Tree) -> Column:
    at = t.place(F.col("bins"))
    table = F.create_map(*[F.lit(v) for pair in t.values.items() for v in pair])
    return table[at]


def histograms(rows: DataFrame, losses: list[Loss], trees: list[Tree], wanted: list[set[int]]) -> dict[tuple[int, int], np.ndarray]:
    """(model, leaf) -> sums (feature, bin, [gradient, curvature, rows]) of the wanted leaves, from one partial aggregate."""
    own = []
    for m, (loss, t, leaves) in enumerate(zip(losses, trees, wanted)):
        if leaves:
            g, h = loss.gradient(F.col("y"), F.col("score")[m])
            own.append(F.struct(F.lit(m).alias("m"), t.place(F.col("bins")).alias("leaf"), g.alias("g"), h.alias("h")))
    each = rows.select("bins", F.explode(F.array(*own)).alias("z"))
    asked = F.lit(False)
    for m, leaves in enumerate(wanted):
        if leaves:
            asked = asked | ((F.col("z.m") == m) & F.col("z.leaf").isin(*leaves))
    each = each.filter(asked).select("z.m", "z.leaf", "z.g", "z.h", F.posexplode("bins").alias("feature", "bin"))
    sums = each.groupBy("m", "leaf", "feature", "bin").agg(F.sum("g"), F.sum("h"), F.count(F.lit(1))).collect()
    most = max((r[3] for r in sums), default=0) + 1
    features = max((r[2] for r in sums), default=0) + 1
    out: dict[tuple[int, int], np.ndarray] = {}
    for m, leaf, j, b, g, h, n in sums:
        out.setdefault((m, leaf), np.zeros((features, most, 3)))[j, b] = (g, h, n)
    return out


def best_split(hist: np.ndarray, least: int, ridge: float) -> tuple[float, int, int]:
    """(gain, feature, last bin on the left) of the best split of a leaf; gain 0 if there is none."""
    left = hist.cumsum(axis=1)
    total = left[:, -1:, :]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / (left[..., 1] + ridge) + right[..., 0] ** 2 / (right[..., 1] + ridge) - total[..., 0] ** 2 / (total[..., 1] + ridge)
    gain[(left[..., 2] < least) | (right[..., 2] < least) | ~np.isfinite(gain)] = 0.0
    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[j, b]), int(j), int(b)


def wide(h: np.ndarray, like: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(like)
    out[: h.shape[0], : h.shape[1]] = h
    return out


def grow(rows: DataFrame, losses: list[Loss], features: int, leaves: int, least: int, ridge: float, together: int) -> list[Tree]:
    trees = [Tree() for _ in losses]
    known: list[dict[int, np.ndarray]] = [{} for _ in losses]
    open_: list[list[tuple[float, int, int, int]]] = [[] for _ in losses]  # a heap of (-gain, leaf, feature, bin)
    wanted: list[set[int]] = [{0} for _ in losses]
    split: list[list[tuple[int, int, int]]] = [[] for _ in losses]  # (parent, counted child, other child)
    while any(wanted):
        got = histograms(rows, losses, trees, wanted)
        for m, t in enumerate(trees):
            fresh = list(wanted[m] & {0})
            for (mm, leaf), h in got.items():
                if mm == m:
                    known[m][leaf] = h
            for parent, child, other in split[m]:
                whole = known[m].pop(parent)
                known[m][child] = wide(known[m].get(child, np.zeros((1, 1, 3))), whole.shape)
                known[m][other] = whole - known[m][child]
                fresh += [child, other]
            for leaf in fresh:
                if leaf in known[m]:
                    gain, j, b = best_split(known[m][leaf], least, ridge)
                    if gain > 1e-15:
                        heapq.heappush(open_[m], (-gain, leaf, j, b))
            wanted[m], split[m] = set(), []
            while open_[m] and len(split[m]) < together and len(t.splits) + 1 < leaves:
                _, leaf, j, b = heapq.heappop(open_[m])
                left = 2 * len(t.splits) + 1
                t.splits[leaf] = (j, b, left, left + 1)
                rows_left = known[m][leaf][j, : b + 1, 2].sum()
                small, large = (left, left + 1) if 2 * rows_left <= known[m][leaf][j, :, 2].sum() else (left + 1, left)
                split[m].append((leaf, small, large))
                wanted[m].add(small)
            if len(t.splits) + 1 >= leaves:  # no further split, so no further histogram
                wanted[m], split[m] = set(), []
    return trees


def fill(rows: DataFrame, losses: list[Loss], trees: list[Tree], rate: float, ridge: float) -> None:
    """The values of all leaves of the trees, from one aggregate."""
    own = []
    for m, (loss, t) in enumerate(zip(losses, trees)):
        if t.splits:
            g, h = loss.gradient(F.col("y"), F.col("score")[m])
            own.append(F.struct(F.lit(m).alias("m"), t.place(F.col("bins")).alias("leaf"), g.alias("g"), h.alias("h"), (F.col("y") - F.col("score")[m]).alias("r")))
    each = rows.select(F.explode(F.array(*own)).alias("z")).select("z.*")
    quantiles = [F.percentile_approx(F.when(F.col("m") == m, F.col("r")), loss.q, 10_000).alias(f"q{m}") for m, loss in enumerate(losses) if loss.kind == "pinball"]
    for r in each.groupBy("m", "leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), *quantiles).collect():
        pinball = losses[r["m"]].kind == "pinball"
        trees[r["m"]].values[r["leaf"]] = rate * float(r[f"q{r['m']}"] if pinball else r["g"] / (r["h"] + ridge + 1e-12))


def classify(train: DataFrame, test: DataFrame, names: Sequence[str], **kw) -> DataFrame:
    """test with p_up, pred (1, -1) and confidence by a boosted classifier of train's y in {1, -1}."""
    model = fit(train.withColumn("__label", (F.col("y") == 1).cast("double")), names, "__label", [Loss("logistic")], **kw)
    p = 1 / (1 + F.exp(-F.col("__s")))
    return model.scores(test, ["__s"]).withColumns({"p_up": p, "pred": F.when(p >= 0.5, 1).otherwise(-1), "confidence": F.greatest(p, 1 - p)}).drop("__s")


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def quantiles(train: DataFrame, test: DataFrame, names: Sequence[str], y: str = "actual", levels: Sequence[float] = QUANTILES, **kw) -> DataFrame:
    """test with q05, q25, ... of y, sorted within a row, and std: the range between the second and the second last by 1.349."""
    cols = [f"q{round(q * 100):02d}" for q in levels]
    got = fit(train, names, y, [Loss("pinball", q) for q in levels], **kw).scores(test, [f"__{c}" for c in cols])
    order = F.array_sort(F.array(*[F.col(f"__{c}") for c in cols]))
    got = got.withColumns({c: order[k] for k, c in enumerate(cols)}).drop(*[f"__{c}" for c in cols])
    return got.withColumn("std", (F.col(cols[-2]) - F.col(cols[1])) / 1.349)
