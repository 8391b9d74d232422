"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, numbered, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes(source, source_size) with `target`: the words that each source should give.

    All targets sum to all sizes. A target stops at max_repeat times the source's size and its excess is shared
    among the others by weight, until none is above. The end of that loop is computed at once: in the order of
    cap / weight, a source is capped if the level that the capped ones before it leave is still above its own.
    One row per source passes through the one-partition windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy(F.col("__ratio"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1)
    s = sizes.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * max_repeat)
    s = s.withColumn("__ratio", F.try_divide("__cap", "__w"))
    s = s.withColumns({"__total": F.sum("source_size").over(everything), "__all_w": F.sum("__w").over(everything)})
    left = F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    room = F.col("__all_w") - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    s = s.withColumn("__capped", F.coalesce(F.try_divide(left, room) > F.col("__ratio"), F.lit(False)))
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("__capped"), F.col(c))).over(everything), F.lit(0))
    level = F.try_divide(F.col("__total") - capped("__cap"), F.col("__all_w") - capped("__w"))
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(level * F.col("__w"))
    return s.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document).

    Systematic sampling: within a source each document expects target / source_size copies; these are summed up
    in the order of (size, doc_id) and a random offset of the source is added; a document is taken once for
    each whole number that its step crosses. In that order documents of like size lie together, so the words
    taken differ from the target by about one longest document at most. The order is a global one over
    (source, size, doc_id): a hot source is spread over many tasks.

    Null text has size 0; sources of size 0 have target 0 and give no copies; null is a source of its own, the
    last. Equal rows count as documents of their own. An empty table gives an empty result. Columns of docs
    named as those that are added are replaced.
    """
    base = docs.drop("size", "source_size", "target", "copies").withColumn("size", n_words(text_of(docs)))
    return sampled(base, weights, max_repeat, seed)


def sampled(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """mix() for rows that have their size already: needs doc_id, source, size; keeps all columns."""
    rn = numbered(sized, [F.col("source"), F.col("size"), F.col("doc_id")], "__rn")
    per = rn.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("__rn").alias("__first")
    )
    targets = source_targets(per.select("source", "source_size"), weights, max_repeat)
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("\0")))), 1, 5)
    info = (
        targets.withColumnRenamed("source", "__s")
        .join(per.select("source", "__first"), F.col("__s").eqNullSafe(F.col("source")))
        .select(
            "__s", "source_size", "target", "__first",
            F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("__rate"),
            (F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 20))).alias("__u"),
        )
    )
    at = F.col("__rn") - F.col("__first")
    crossed = F.floor(F.col("__u") + (at + 1) * F.col("__rate")) - F.floor(F.col("__u") + at * F.col("__rate"))
    return (
        rn.join(info, F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("copies", F.least(crossed, F.lit(max_repeat)).cast("long"))
        .drop("__s", "__first", "__rate", "__u", "__rn")
    )


def emit(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """A row of docs for each copy that mix() takes, with the columns of docs as they are, whatever their names.

    Nulls, repeats and ties as in mix(); a text of any length is one document; an empty table gives an empty result.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    size = n_words(text_of(docs)).alias("size")
    sized = docs.select(*[docs[c].alias(new) for c, new in own.items()], docs["doc_id"], docs["source"], size)
    taken = sampled(sized, weights, max_repeat, seed).filter("copies > 0")
    many = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return many.select(*[F.col(new).alias(c) for c, new in own.items()])
