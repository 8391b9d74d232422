"""Overlapping labels of any lengths: who is alive when, how unique each label is, and bootstraps that draw by uniqueness.

A label is a row (asset, label, start, end) that spans [start, end) on a number axis: row positions, or times as numbers.
Nothing here holds a matrix of labels x times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cv import effective_n, positioned

#: Length of a stretch of the axis whose events one window task sorts.
SEGMENT = 4096.0


def bar_labels(df: DataFrame, horizon: int) -> DataFrame:
    """A label for each row of df(asset, timestamp): its position and the horizon - 1 after it."""
    p = F.col("pos").cast("long")
    return positioned(df.select("asset", "timestamp")).select("asset", p.alias("label"), p.alias("start"), (p + horizon).alias("end"))


def held_labels(df: DataFrame, side: str, flat: str = "flat", longest: int = 24) -> DataFrame:
    """A label for each row of df(asset, timestamp, side) that is not flat: to the next row with another side, `longest` rows
    at most; the last rows of an asset end with it."""
    over = Window.partitionBy("asset").orderBy("pos")
    x = positioned(df.select("asset", "timestamp", F.col(side).alias("__side"))).withColumn("pos", F.col("pos").cast("long"))
    turned = F.when(F.lag("__side").over(over).eqNullSafe(F.col("__side")), None).otherwise(F.col("pos"))
    x = x.withColumns({"__turn": turned, "__last": F.max("pos").over(Window.partitionBy("asset"))})
    ahead = F.min("__turn").over(over.rowsBetween(1, longest))
    end = F.coalesce(ahead, F.least(F.col("pos") + longest, F.col("__last") + 1))
    return x.withColumn("__end", end).filter(F.col("__side") != flat).select("asset", F.col("pos").alias("label"), F.col("pos").alias("start"), F.col("__end").alias("end"))


def indicator(labels: DataFrame) -> DataFrame:
    """(asset, label, at): the ones of the indicator matrix of labels over whole positions, a row each."""
    return labels.select("asset", "label", F.explode(F.sequence("start", F.col("end") - 1)).alias("at"))


def _events(labels: DataFrame, segment: float) -> DataFrame:
    """(asset, seg, at, label, d, span, alive, piece): both ends of each label with the number of labels alive from there on, and
    the stretch before it divided by the number alive in it.

    Sums along the axis have two levels: within a segment a window, before it one row a segment. Ends that stand at one place
    share their values: frames are by range, and the first of them alone carries the stretch.
    """
    ends = F.explode(F.array(F.struct(F.col("start").cast("double").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").cast("double").alias("at"), F.lit(-1).alias("d"))))
    e = labels.filter(F.col("start") < F.col("end")).select("asset", "label", (F.col("end") - F.col("start")).cast("double").alias("span"), ends.alias("e")).select("asset", "label", "span", "e.at", "e.d")
    e = e.withColumn("seg", F.floor(F.col("at") / segment))
    segs = e.groupBy("asset", "seg").agg(F.sum("d").alias("__sum"), F.max("at").alias("__max"))
    earlier = Window.partitionBy("asset").orderBy("seg")
    before = F.coalesce(F.sum("__sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segs = segs.select("asset", "seg", before.alias("__before"), F.lag("__max").over(earlier).alias("__from"))
    by_at = Window.partitionBy("asset", "seg").orderBy("at")
    upto = by_at.rangeBetween(Window.unboundedPreceding, 0)
    e = e.join(segs, ["asset", "seg"]).withColumn("alive", F.col("__before") + F.sum("d").over(upto))
    # the row before it, or the last place and count of the segments before
    last = F.coalesce(F.lag("at").over(by_at), F.col("__from"))
    count = F.coalesce(F.lag("alive").over(by_at), F.col("__before"))
    piece = F.when((F.col("at") > last) & (count > 0), (F.col("at") - last) / count).otherwise(0.0)
    return e.withColumn("piece", piece).select("asset", "seg", "at", "label", "d", "span", "alive", "piece")


def concurrency(labels: DataFrame, segment: float = SEGMENT) -> DataFrame:
    """(asset, at, until, alive): the number of labels over each stretch between two places where one starts or ends."""
    e = _events(labels, segment)
    steps = e.groupBy("asset", "at").agg(F.first("alive").alias("alive"), F.first("seg").alias("seg"))
    inside = F.lead("at").over(Window.partitionBy("asset", "seg").orderBy("at"))
    firsts = steps.groupBy("asset", "seg").agg(F.min("at").alias("__first"))
    firsts = firsts.select("asset", "seg", F.lead("__first").over(Window.partitionBy("asset").orderBy("seg")).alias("__next"))
    x = steps.withColumn("__in", inside).join(firsts, ["asset", "seg"]).withColumn("until", F.coalesce("__in", "__next"))
    return x.filter("until IS NOT NULL").select("asset", "at", "until", "alive")


def uniqueness(labels: DataFrame, segment: float = SEGMENT) -> DataFrame:
    """(asset, label, uniqueness): the mean over a label's span of one by the number of labels alive.

    With S(x), the integral of 1 / alive up to x, it is (S(end) - S(start)) / (end - start). S comes in two parts, within the
    segment and before it, which are subtracted apart, so a long axis costs no digits. Labels without a span have none.
    """
    e = _events(labels, segment)
    upto = Window.partitionBy("asset", "seg").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("asset").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = e.groupBy("asset", "seg").agg(F.sum("piece").alias("__sum"))
    segs = segs.select("asset", "seg", F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__before"))
    e = e.withColumn("__in", F.sum("piece").over(upto)).join(segs, ["asset", "seg"])
    part = lambda c: F.sum(-F.col("d") * F.col(c))  # noqa: E731  end less start
    return e.groupBy("asset", "label").agg(((part("__before") + part("__in")) / F.first("span")).alias("uniqueness"))


def weights(df: DataFrame, horizon: int, method: str = "sequential_bootstrap") -> tuple[DataFrame, DataFrame]:
    """((asset, pos, weight), (asset, n_raw, n_eff)) of forward labels of one horizon: their uniqueness, or for `subsample` 1 at every
    horizon-th row and 0 elsewhere, which does not count for n_eff."""
    if method == "sequential_bootstrap":
        w = uniqueness(bar_labels(df, horizon)).select("asset", F.col("label").alias("pos"), F.col("uniqueness").alias("weight"))
    elif method == "subsample":
        w = positioned(df.select("asset", "timestamp")).select("asset", F.col("pos").cast("long").alias("pos"), (F.col("pos") % horizon == 0).cast("double").alias("weight"))
    else:
        raise ValueError(method)
    n = w.groupBy("asset").agg(F.count(F.lit(1)).alias("n_raw"))
    return w, n.join(effective_n(w.filter("weight > 0"), "weight"), "asset")


class SumTree:
    """Weights with their sum: a stretch of them is replaced in a pass a level, a place is found by its share of the sum."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(0, int(len(values) - 1).bit_length())
        self.levels = [np.concatenate([values, np.zeros(size - len(values))])]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1][::2] + self.levels[-1][1::2])

    def replace(self, low: int, values: np.ndarray) -> None:
        high = low + len(values)
        self.levels[0][low:high] = values
        for under, over in zip(self.levels, self.levels[1:]):
            low, high = low // 2, (high + 1) // 2
            over[low:high] = under[2 * low : 2 * high : 2] + under[2 * low + 1 : 2 * high : 2]

    def find(self, share: float) -> int:
        """The first place whose weights up to it exceed share x sum."""
        left, at = share * float(self.levels[-1][0]), 0
        for level in reversed(self.levels[:-1]):
            at *= 2
            # a side without weight is never taken, whatever the rounding
            if (left >= level[at] and level[at + 1] > 0) or level[at] <= 0:
                left -= level[at]
                at += 1
        return at


def drawn(start: np.ndarray, end: np.ndarray, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(places, uniqueness): labels drawn in turn, each with a chance in proportion to its uniqueness given those drawn before.

    start ascends. A draw changes only labels that overlap the drawn one; with the axis cut where labels start or end, a draw
    costs the overlapping labels and a tree's depth, not all labels.
    """
    cuts = np.unique(np.concatenate([start, end]))
    length = np.diff(cuts).astype(float)
    a, b = np.searchsorted(cuts, start), np.searchsorted(cuts, end)
    reach = np.maximum.accumulate(b)
    span = (end - start).astype(float)
    alive = np.zeros(len(length))

    def given(low: int, high: int) -> np.ndarray:
        first, last = a[low], reach[high - 1]
        upto = np.concatenate([[0.0], np.cumsum(length[first:last] / (alive[first:last] + 1.0))])
        return (upto[b[low:high] - first] - upto[a[low:high] - first]) / span[low:high]

    tree = SumTree(given(0, len(start)))
    out, unique = np.empty(draws, np.int64), np.empty(draws)
    for k in range(draws):
        i = tree.find(rng.random())
        out[k], unique[k] = i, tree.levels[0][i]
        alive[a[i] : b[i]] += 1
        low, high = int(np.searchsorted(reach, a[i], "right")), int(np.searchsorted(a, b[i], "left"))
        tree.replace(low, given(low, high))
    return out, unique


def sequential_bootstrap(labels: DataFrame, replicates: int, draws: int | None = None, seed: int = 42) -> DataFrame:
    """(asset, replicate, draw, label, start, end, given): `replicates` samples of each asset's labels, each of `draws` (as many as
    labels) drawn in turn by their uniqueness `given` those drawn before.

    A replicate's draws depend on each other, so it is one task's fold over its asset's spans (about 100 bytes a label);
    replicates and assets run side by side, each from its own seed, and come out the same on every run.
    """
    copies = labels.filter(F.col("start") < F.col("end")).select("asset", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), "label", F.col("start").cast("double"), F.col("end").cast("double"))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start", "label"], kind="stable").reset_index(drop=True)
        n = draws or len(g)
        places, given = drawn(g["start"].to_numpy(), g["end"].to_numpy(), n, np.random.default_rng([seed, int(key[1])]))
        return g.loc[places, ["asset", "replicate", "label", "start", "end"]].assign(draw=np.arange(n), given=given)[["asset", "replicate", "draw", "label", "start", "end", "given"]]

    return copies.groupBy("asset", "replicate").applyInPandas(one, "asset string, replicate int, draw long, label long, start double, end double, given double")


def sample_uniqueness(sample: DataFrame, segment: float = SEGMENT) -> DataFrame:
    """(asset, replicate, n, n_distinct, uniqueness) of sample(asset, replicate, draw, label, start, end): the mean uniqueness of the drawn
    labels among themselves."""
    name = F.concat_ws("\x01", "asset", F.col("replicate").cast("string"))
    u = uniqueness(sample.select(name.alias("asset"), F.col("draw").alias("label"), "start", "end"), segment)
    u = u.groupBy("asset").agg(F.avg("uniqueness").alias("uniqueness"))
    parts = F.split("asset", "\x01")
    u = u.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "\x01").alias("asset"), F.element_at(parts, -1).cast("int").alias("replicate"), "uniqueness")
    n = sample.groupBy("asset", "replicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_distinct"))
    return n.join(u, ["asset", "replicate"])
