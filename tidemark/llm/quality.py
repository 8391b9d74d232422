"""Quality rules with risk-controlled thresholds. Column expressions only."""

from __future__ import annotations

from math import log, log1p, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, text_of, word_array

#: Characters that count as symbols, and the measures a rule may cut on (column: True if high values are bad).
SYMBOLS = r"[#*$%&|<>]"
RULES = {"symbol_ratio": True, "dup_line_ratio": True, "repeat_ratio": True, "bang_ratio": True, "upper_ratio": True, "mean_word": True, "short_word": False}
#: Candidate cutoffs of each rule, from lenient to strict.
GRID = {
    "symbol_ratio": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.1, 0.08],
    "bang_ratio": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05],
    "upper_ratio": [0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25],
    "mean_word": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0],
    "short_word": [1.0, 1.2, 1.5, 1.8, 2.0, 2.3, 2.6, 3.0],
}
#: Tails of at most this many terms are summed from the first term on.
SHORT_TAIL = 1_000


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words that lie in a window of `width` words which is found twice or more in the text.

    Windows are compared by a 64-bit hash of the 64-bit hashes of their words. Texts without a repeated window
    end after one pass over a hash set; the others sort (hash, place) pairs and sum the union of the windows.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def places(s: Column) -> Column:
            twice = F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            # each place adds the words up to the next place, `width` at most
            return let(
                F.sort_array(twice),
                lambda p: F.aggregate(
                    F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(width)), F.lit(width))),
                    F.lit(0).cast("long"),
                    lambda acc, d: acc + d,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(pairs), places)
        )

    def windows(h: Column) -> Column:
        last = F.size(h) - width
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    per_word = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(per_word, lambda h: let(windows(h), covered)))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the counts of each text. Null text: no words."""
    text = text_of(docs)
    has_word = lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0
    lines = F.filter(F.split(text, "\n"), has_word)
    one = docs.select(*[docs[c] for c in keep], text.alias("__text"))
    t = F.col("__text")
    counts = let(
        word_array(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(t, "\n"), has_word)
    out = one.select(
        *[F.col(c) for c in keep],
        counts.alias("__c"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("[!?]")).cast("long").alias("__bangs"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("__upper"),
        F.regexp_count(t, F.lit(r"\p{L}")).cast("long").alias("__letters"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("__l"),
    )
    return out.select(
        *[F.col(c) for c in keep],
        F.col("__c.n_words").alias("n_words"),
        F.col("__c.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("__l.d").cast("long").alias("n_dup_lines"),
        F.col("__c.n_repeat_words").alias("n_repeat_words"),
        F.col("__l.n").cast("long").alias("n_lines"),
        F.col("__bangs").alias("n_bangs"),
        F.col("__upper").alias("n_upper"),
        F.col("__letters").alias("n_letters"),
    )


def ratios(m: DataFrame) -> DataFrame:
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return m.withColumns(
        {
            "symbol_ratio": part("n_symbols", "word_chars"),
            "dup_line_ratio": part("n_dup_lines", "n_lines"),
            "repeat_ratio": part("n_repeat_words", "n_words"),
            "bang_ratio": part("n_bangs", "word_chars"),
            "upper_ratio": part("n_upper", "n_letters"),
            "mean_word": part("word_chars", "n_words"),
            "short_word": part("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )


def beyond(rule: str, cut: Column) -> Column:
    return (F.col(rule) > cut) if RULES[rule] else (F.col(rule) < cut)


def log_tail(k: Column, n: Column, risk: float) -> Column:
    """ln P(Binomial(n, risk) <= k): the exact sum of its terms, each got from the one before, in logarithms.

    Above SHORT_TAIL the sum starts at its last term (log_term) and goes down until what is left is below a double's
    last place, which takes a multiple of sqrt(n * risk) terms.
    """
    odds = log(risk) - log1p(-risk)
    k, n = k.cast("long"), n.cast("long")
    zero = F.struct((n * F.lit(log1p(-risk))).alias("term"), (n * F.lit(log1p(-risk))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i) + F.lit(odds)
        top = F.greatest(term, acc["sum"])
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(term, acc["sum"]) - top))).alias("sum"))

    def down(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((k - i + 1).cast("double") / (n - k + i)) - F.lit(odds)
        top = F.greatest(term, acc["sum"])
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(term, acc["sum"]) - top))).alias("sum"))

    one, none = F.lit(1).cast("long"), F.array().cast("array<long>")
    end = lambda acc: F.least(acc["sum"], F.lit(0.0))
    steps = F.when((k >= 1) & (k <= SHORT_TAIL), F.sequence(one, k)).otherwise(none)
    mean = n * F.lit(risk)
    many = (F.greatest(k - mean, F.lit(0.0)) + 10 * F.sqrt(mean) + 100).cast("long")
    last = F.struct(log_term(k, n, risk).alias("term"), log_term(k, n, risk).alias("sum"))
    long = F.aggregate(F.when(k > SHORT_TAIL, F.sequence(one, F.least(k, many))).otherwise(none), last, down, end)
    return F.when(k >= n, F.lit(0.0)).when(k <= SHORT_TAIL, F.aggregate(steps, zero, step, end)).otherwise(long)


def log_term(k: Column, n: Column, risk: float) -> Column:
    """ln P(Binomial(n, risk) = k) for large k and n - k: Stirling's series and deviances (Loader's form)."""
    stirling = lambda x: (1 / 12.0 - (1 / 360.0 - 1 / (1260.0 * x * x)) / (x * x)) / x
    off = lambda x, mean: x * F.log1p((x - mean) / mean) - (x - mean)
    a, b, m = k.cast("double"), (n - k).cast("double"), n.cast("double")
    front = 0.5 * F.log(m / (2 * pi * a * b))
    return front + stirling(m) - stirling(a) - stirling(b) - off(a, m * risk) - off(b, m * (1 - risk))


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, grid=GRID) -> DataFrame:
    """One row for each stratum (lang) in which a cutoff can be certified, with its cutoffs.

    A cutoff is certified if, of all the stratum's good labelled documents (quality 1), those that it would reject are so
    few that a true false-rejection rate above risk / rules is refuted by the exact binomial tail at level
    delta / (strata * rules): Bonferroni over strata and rules, and a fixed sequence within a rule, from lenient to strict
    up to the first cutoff that fails, which needs no further correction. A rule without a certified cutoff is off
    (null). With all rules on, a stratum loses at most `risk` of its good documents, for all strata at once with
    probability 1 - delta. A stratum so small that no cutoff could be certified there even without a false rejection
    (its size alone decides that) has no row: all its learned rules are off.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id")).distinct()
    held = measures.join(good, "doc_id", "left_semi").filter(~F.col("base_failed"))
    tried = [(rule, i, cut) for rule, cuts in grid.items() for i, cut in enumerate(cuts)]
    named = [f"{rule}__{i}" for rule, i, _ in tried]
    hits = [F.sum(beyond(rule, F.lit(cut)).cast("long")).alias(c) for c, (rule, _, cut) in zip(named, tried)]
    wide = materialize(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *hits))
    part = risk / len(grid)
    level = lambda strata: F.lit(log(delta / len(grid))) - F.log(strata.cast("double"))
    # no false rejection at all must be enough to certify a cutoff; the largest strata that pass together are tested
    strong = lambda strata: F.col("n") * F.lit(log1p(-part)) <= level(strata)
    nth = F.row_number().over(Window.orderBy(F.desc("n"), "stratum"))
    wide = wide.filter(strong(F.lit(1))).withColumn("__nth", nth).filter(strong(F.col("__nth"))).drop("__nth")
    wide = materialize(wide)
    wide = wide.join(F.broadcast(wide.agg(F.count(F.lit(1)).alias("__strata"))))
    level = level(F.col("__strata"))
    # a row for each stratum and candidate: the tail is one expression, whatever their number
    each = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(float(cut)).alias("cut"), F.col(c).alias("k")) for c, (rule, i, cut) in zip(named, tried)]
    long = wide.select("stratum", "n", level.alias("level"), F.explode(F.array(*each)).alias("t")).select("stratum", "n", "level", "t.*")
    # a count above its expectation is never certified, so its tail need not be summed
    passes = F.when(F.col("k") > F.col("n") * part, F.lit(False)).otherwise(log_tail(F.col("k"), F.col("n"), part) <= F.col("level"))
    failed = long.withColumn("failed", F.when(~F.coalesce(passes, F.lit(False)), F.col("i")))
    first_bad = F.min("failed").over(Window.partitionBy("stratum", "rule"))
    fine = failed.withColumn("bad", first_bad).filter("bad IS NULL OR i < bad")
    of = lambda rule, c: F.when(F.col("rule") == rule, F.col(c))
    return fine.groupBy("stratum").agg(*[F.max_by(of(rule, "cut"), of(rule, "i")).alias(f"cut_{rule}") for rule in grid])


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts of measured(), base_failed, kept, and `carry`.

    kept: not base_failed, and beyond no cutoff of its stratum (lang); in strata with too few labels to certify a cutoff, or
    with none, only the base rules are on. Null text has no words and fails the base rules. A document
    labelled several times counts once. Rows that repeat are judged each. An empty table gives an empty result.
    """
    keep = list(dict.fromkeys(["doc_id", *(["lang"] if "lang" in docs.columns else []), *carry]))
    m = measured(docs, keep)
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    m = materialize(m.withColumn("stratum", lang))
    m = ratios(m)
    cuts = materialize(cutoffs(m, labels, risk, delta).coalesce(1))
    return verdict(m, cuts).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def verdict(m: DataFrame, cuts: DataFrame) -> DataFrame:
    """m with `kept`. cuts has one row for each stratum of about 1,900 good labels or more, so it is broadcast."""
    both = m.join(F.broadcast(cuts), "stratum", "left")
    bad = F.lit(False)
    for rule in RULES:
        bad = bad | F.coalesce(beyond(rule, F.col(f"cut_{rule}")), F.lit(False))
    # one comparison, which cannot be parted: a condition on base_failed alone (or that it is not null) would be moved below the join, and the texts
    # would be measured for it once more
    failed = F.coalesce(F.col("base_failed"), F.lit(True))
    return both.withColumn("kept", failed.cast("int") + bad.cast("int") == 0)


def accepted(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that judge() would keep, all columns as they were; no text is shuffled.

    Nulls, repeats, labels and empty tables as in judge(); texts of any length are measured whole.
    Two passes measure the texts: the first keeps the measures alone, from which the cutoffs come as in judge(); the
    second filters the rows.
    """
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    keep = ["doc_id", *(["lang"] if "lang" in docs.columns else [])]
    m = ratios(materialize(measured(docs, keep).withColumn("stratum", lang)))
    cuts = materialize(cutoffs(m, labels, risk, delta).coalesce(1))
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*[docs[c].alias(new) for c, new in own.items()], docs["text"], lang.alias("__lang"))
    m = ratios(measured(moved, [*own.values(), "__lang"]).withColumnRenamed("__lang", "stratum"))
    kept = verdict(m, cuts).filter("kept")
    return kept.select(*[F.col(new).alias(c) for c, new in own.items()])
