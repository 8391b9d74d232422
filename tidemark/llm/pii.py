"""Personal data: base patterns with exact spans, and bootstrapped contextual extraction. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitMap, hot_join, hot_keys, let, materialize, text_of

KINDS = ("email", "ip", "card", "phone", "found")
#: The base patterns in a form that matches the same stretches without stepping back: runs are possessive, and a
#: match may start inside a run only where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried on it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": "+"}
#: A token that may be an identifier: 5 characters or more between gaps, one digit at least.
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9]*+[0-9])[^\x20\x09-\x0D]{5,}+"
#: Two words and the gap behind them at the end of a line; tried at starts of words only, without stepping back.
AHEAD = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09]++[^\x20\x09-\x0D]++)[\x20\x09]++$"
#: Bootstrapping: least number of distinct known instances of a pattern, least precision of a pattern, least score of an
#: instance.
SUPPORT, PRECISION, ACCEPT = 5, 0.8, 0.75


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>>: the matches of pattern, in code points; before: the stretch ahead of it."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "struct<at:int,out:array<struct<start:int,end:int,value:string,before:string>>>"

    def walk(p: Column, m: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,before:string>>").alias("out")).cast(kind)

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(p, i))
            e = s + F.length(F.get(m, i))
            one = F.struct(s.alias("start"), e.alias("end"), F.get(m, i).alias("value"), F.get(p, i).alias("before"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(pieces, lambda p: walk(p, m))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a Luhn sum that ends in 0."""

    def term(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when(i % 2 == 0, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + term(i))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$")
    if kind == "card":
        n = F.length(digits(value))
        return F.when((n >= 13) & (n <= 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind (its place in KINDS), start, end, value, before>> in the order of kinds, then starts."""
    return F.concat(*[_of_kind(text, nr, kind) for nr, kind in enumerate(KINDS[:4])])


def _of_kind(text: Column, nr: int, kind: str) -> Column:
    maybe = F.contains(text, F.lit(HINTS[kind])) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
    spans = F.transform(
        F.filter(located(text, PATTERNS[kind]), lambda s: valid(kind, s["value"])),
        lambda s: F.struct(F.lit(nr).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "value", "before")]),
    )
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string,before:string>>")
    return F.when(maybe, spans).otherwise(none)


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def context(before: Column) -> Column:
    """The two words ahead of a token on its line, lower case; null if there are fewer."""
    line = F.element_at(F.split(before, "\n"), -1)
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(line, AHEAD, 1)), r"[\x20\x09]++", " "), F.lit(""))


def bigrams(text: Column) -> Column:
    """The pairs of words in a row on one line, in the form of context()."""
    words = lambda line: F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pairs = lambda w: F.when(
        F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.split(F.lower(text), "\n"), lambda line: let(words(line), pairs)))


def promoted(mentions: DataFrame, totals: DataFrame) -> tuple[DataFrame, list]:
    """Instances that trusted patterns discover, and the hot ones of all. mentions: (pattern, instance, seed); totals: (pattern, total)."""
    edges = joined(mentions, totals)
    return scored(edges)[0], hot_instances(edges, "n")


def hot_instances(edges: DataFrame, by: str | None = None) -> list:
    """The instances with a large share of the edges, or of their mentions (by)."""
    counts = edges.groupBy("instance").agg((F.count(F.lit(1)) if by is None else F.sum(by)).alias("count"))
    return hot_keys(counts, "instance", edges.agg(F.count(F.lit(1)) if by is None else F.sum(by)).first()[0] or 0)


def joined(mentions: DataFrame, totals: DataFrame) -> DataFrame:
    edges = materialize(mentions.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    return materialize(hot_join(edges, totals, "pattern", "instance"))


def scored(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(discovered instances, trusted patterns) of edges(pattern, instance, n, seed, total).

    The graph of patterns and instances is scored in turns until no more instances become known. A pattern's precision is
    the share of its places in the corpus that hold a known instance; it is trusted with PRECISION and SUPPORT distinct
    known instances. An instance scores 1 - product of (1 - precision) over its trusted patterns, and is known from
    ACCEPT on. Seeds are known. Known instances only grow, so precisions do too, and the turns end.
    """
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed")).filter("seed").select("instance")
    known = materialize(seeds)
    many, hot = known.count(), hot_instances(edges)
    while True:
        by_pattern = hot_join(edges, known, "instance", "pattern", hot).groupBy("pattern", "total")
        p = by_pattern.agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("support"))
        p = p.withColumn("precision", F.least(F.try_divide("hits", "total"), F.lit(1.0)))
        p = p.filter((F.col("support") >= SUPPORT) & (F.col("precision") >= PRECISION)).select("pattern", "precision")
        trusted = hot_join(edges, p, "pattern", "instance").groupBy("instance")
        score = trusted.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-9)))))).alias("score"))
        fresh = score.filter(F.col("score") >= ACCEPT).select("instance")
        known = materialize(known.unionByName(fresh).distinct())
        before, many = many, known.count()
        if many == before:
            return known.join(seeds, "instance", "left_anti"), p.select("pattern")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, value) of each row.

    base: the four base kinds. spans: base, and with kind `found` the tokens that share no character with a base span
    and that the bootstrapping discovers: base spans are seeds, the two words ahead of them are patterns, and
    promoted() decides which identifier-like tokens are identifiers too; all their places count. A pattern's places are
    counted over the whole corpus: first in the texts that hold a seed or a token at all, which bounds its precision from above;
    those that stay in the running are then counted in every text, where a known instance may be a seed or discovered. Null text is empty. Repeated rows are searched
    each. An empty table gives an empty result.
    """
    t = text_of(docs)
    text = F.col("text")
    has_digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    base = docs.select("doc_id", t.alias("text")).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.transform(
            base_spans(text),
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), context(s["before"]).alias("pattern")),
        ).alias("base"),
        F.transform(
            F.when(has_digit, located(text, TOKEN)).otherwise(none),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), context(s["before"]).alias("pattern")),
        ).alias("tokens"),
    )
    apart = lambda x, b: F.forall(b, lambda s: (s["end"] <= x["start"]) | (s["start"] >= x["end"]))
    base = materialize(base.withColumn("tokens", F.filter("tokens", lambda x: apart(x, F.col("base")))))
    seeds = base.select("rid", F.explode("base").alias("s")).select(
        "rid", F.lower("s.value").alias("instance"), F.col("s.pattern").alias("pattern"), F.lit(True).alias("seed"), F.col("s.start").alias("start"), F.col("s.end").alias("end")
    )
    others = base.select("rid", F.explode("tokens").alias("s")).select(
        "rid", F.lower("s.value").alias("instance"), F.col("s.pattern").alias("pattern"), F.lit(False).alias("seed"), F.col("s.start").alias("start"), F.col("s.end").alias("end")
    )
    mentions = seeds.unionByName(others).filter("pattern IS NOT NULL")
    slim = docs.select(t.alias("text"))
    candidates = materialize(candidate_patterns(mentions, slim))
    result = base.withColumn("found", none_found())
    if candidates.head(1):
        totals = materialize(corpus_totals(candidates, slim))
        fresh, hot = promoted(mentions, totals)
        spans = hot_join(others, fresh, "instance", "rid", hot)
        got = spans.groupBy("rid").agg(
            F.sort_array(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end", F.col("instance").alias("value")))).alias("got")
        )
        result = base.join(got, "rid", "left").withColumn("found", F.coalesce("got", none_found()))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return result.select("doc_id", plain.alias("base"), F.concat(plain, "found").alias("spans"))


def none_found() -> Column:
    return F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")


def candidate_patterns(mentions: DataFrame, slim: DataFrame) -> DataFrame:
    """(pattern) that promoted() may trust: with SUPPORT distinct instances, seeds or not, that PRECISION does not rule out yet.

    A pattern's places in texts with a digit or an @ are some of its places, so hits by their number is an upper bound
    of the precision; known instances can at most grow to all mentions. Scored with these bounds, whatever the true
    totals will let be known or trusted is known or trusted too, so the patterns that no seed leads to fall away.
    """
    per = mentions.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"))
    able = per.groupBy("pattern").agg(F.sum("n").alias("most"), F.count(F.lit(1)).alias("support"))
    able = materialize(able.filter(F.col("support") >= SUPPORT))  # a size that the planner knows
    # texts that can hold a mention
    near = slim.filter(F.col("text").rlike("[0-9@]"))
    bounds = able.join(counted(near, able), "pattern").filter(F.col("most") >= PRECISION * F.col("total")).select("pattern", "total")
    return scored(joined(mentions, bounds))[1]


def corpus_totals(candidates: DataFrame, slim: DataFrame) -> DataFrame:
    """(pattern, total): how often each candidate stands in all texts."""
    return counted(slim, candidates)


def counted(slim: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total) of the materialized patterns in the texts of slim: counted where they are read, then joined."""
    every = slim.select(F.explode(bigrams(F.col("text"))).alias("pattern"))
    some = BitMap(patterns, "pattern").within(every, F.col("pattern"))
    return some.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).join(patterns.select("pattern"), "pattern")
