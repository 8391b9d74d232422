"""The corpus operators against plain Python on small tables, with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import itertools
import math
import random
import re
import sys
import textwrap
import zlib
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import batches, decontam, licenses, line_dedup, mixing, near_dedup, pii, quality, sharding, tokens, toxicity

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(WORD, t or "")


def frame(spark, texts, sources=None, extra=False):
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, COLUMNS)
    if extra:  # columns whose names clash with those of the operators
        df = df.withColumns({c: F.lit("own") for c in ("size", "kept", "n", "stratum", "key", "node", "root", "shard")})
    return df


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [None, "", "   \n\t ", "one", "a b c", "x" * 5000, "é🎉 ß\x85y\x1cz"]
    for _ in range(60):
        out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 80))))
    for t in out[10:40]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += out[12:20] + [None, "", "spam " * 40, "head\n" + "same line here\n" * 5]
    return out


def test_mixing_targets_and_copies(spark, corpus):
    docs = frame(spark, corpus, ["b", None, "a", "c"], extra=True)
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus)
    size, taken, target, longest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["copies"] <= 3
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    want, open_ = {}, set(size)
    while True:
        left = sum(size.values()) - sum(want.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * size[s]
            open_.discard(s)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= longest[s] + 1
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_shards_are_a_reproducible_permutation(spark, corpus):
    docs = frame(spark, corpus)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], COLUMNS))
    rows = sharding.shard(docs, 7).collect()
    per = collections.defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    assert len(rows) == len(corpus) + 4 and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    once = sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in rows)
    assert once == sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(5), 7).collect())
    assert sharding.shard(docs.limit(0)).count() == 0
    for n in (1, 2, 3, 10, 1000, 4097):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
        assert sorted(got) == list(range(n))


def test_quality_counts(spark, corpus):
    texts = corpus + ["a b c d e f a b c d e g", "a a a a a a a", "l1 x\nl1 x\n\n \nl2\nl1 x", "#*$%&|<> !?"]
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, texts, extra=True), labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, t = words(t), t or ""
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.judge(frame(spark, texts), none).collect())
    docs = frame(spark, texts, extra=True)
    kept = quality.accepted(docs, none)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["base_failed"]}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 50), (3, 200), (40, 1000), (0, 1)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", F.exp(quality.log_tail(F.col("k"), F.col("n"), 0.03)).alias("p"))
    for k, n, p in df.collect():
        assert p == pytest.approx(sum(comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_keep_good_documents(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        w = [f"w{rng.randrange(5000)}" + ("###" if bad else "") for _ in range(40)]
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, int(not bad), 0))
    docs, lab = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, lab).collect()}
    assert sum(not got[i] for i in got if i % 10) <= 30 and not any(got[i] for i in got if i % 10 == 0)


def measures(spark, n, **columns):
    rules = {r: F.lit(5.0 if r in ("mean_word", "short_word") else 0.0) for r in quality.RULES}
    own = {"doc_id": F.col("id"), "stratum": F.lit("en"), "base_failed": F.lit(False)} | rules | columns
    return spark.range(n).select(*[c.alias(name) for name, c in own.items()])


def test_strata_without_power_have_their_rules_off(spark):
    sizes = {"en": 6000, "de": 2250, "fr": 2140, "es": 1700}
    ends = list(itertools.accumulate(sizes.values()))
    lang = F.when(F.col("id") < ends[0], "en").when(F.col("id") < ends[1], "de").when(F.col("id") < ends[2], "fr").otherwise("es")
    m = measures(spark, ends[-1], stratum=lang)
    cuts = quality.cutoffs(m, m.select("doc_id", F.lit(1).alias("quality")))
    got = {r["stratum"]: r for r in cuts.collect()}
    assert set(got) == {"en", "de", "fr"}  # 3 strata need 2,112 rows each, 4 need 2,212
    assert all(r["cut_symbol_ratio"] == 0.02 for r in got.values())
    junk = measures(spark, 4, stratum=F.element_at(F.array(*[F.lit(x) for x in sizes]), (F.col("id") + 1).cast("int")), symbol_ratio=F.lit(0.6))
    assert {r["stratum"]: r["kept"] for r in quality.verdict(junk, cuts).collect()} == {"en": False, "de": False, "fr": False, "es": True}


def test_verdicts_against_plain_cutoffs(spark):
    """kept of judge() by exact binomial tails, a fixed sequence and Bonferroni in plain Python."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(7000):
        lang = ["en", "en", "de", None][i % 4]
        bad = i % 9 == 0
        w = [f"w{rng.randrange(5000)}" + ("#" if rng.random() < (0.4 if bad else 0.01) else "") + ("!" if bad and lang == "de" else "") for _ in range(30)]
        rows.append((i, " ".join(w), lang, "a", 0))
        labels += [(i, int(not bad), 0)] * (1 + i % 2)
    docs, lab = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, lab).collect()}
    part, delta = 0.02 / len(quality.RULES), 0.05

    def ratio(rule, r):
        text = rows[r["doc_id"]][1]
        up, letters = sum(c.isupper() for c in text), sum(c.isalpha() for c in text)
        of = lambda a, b: a / b if b else 0.0
        lines = 1
        return {"symbol_ratio": of(r["n_symbols"], r["word_chars"]), "dup_line_ratio": of(r["n_dup_lines"], lines), "repeat_ratio": of(r["n_repeat_words"], r["n_words"]),
                "bang_ratio": of(text.count("!") + text.count("?"), r["word_chars"]), "upper_ratio": of(up, letters), "mean_word": of(r["word_chars"], r["n_words"]), "short_word": of(r["word_chars"], r["n_words"])}[rule]

    strata = collections.defaultdict(list)
    for i, row in enumerate(rows):
        if i % 9:
            strata[row[2] or ""].append(got[i])
    sizes = sorted((len(v) for v in strata.values()), reverse=True)
    able = sum(n * math.log1p(-part) <= math.log(delta / len(quality.RULES) / (k + 1)) for k, n in enumerate(sizes))
    cuts = {}
    for s, good in strata.items():
        n = len(good)
        if n * math.log1p(-part) > math.log(delta / len(quality.RULES) / able):
            continue
        for rule, grid in quality.GRID.items():
            for cut in grid:
                k = sum(ratio(rule, r) > cut if quality.RULES[rule] else ratio(rule, r) < cut for r in good)
                tail = sum(comb(n, j) * part**j * (1 - part) ** (n - j) for j in range(k + 1)) if k <= 200 else 1.0
                if tail > delta / len(quality.RULES) / able:
                    break
                cuts[s, rule] = cut
    assert cuts
    for i, r in got.items():
        s = rows[i][2] or ""
        bad = any(c is not None and (ratio(rule, r) > c if quality.RULES[rule] else ratio(rule, r) < c) for rule in quality.RULES for c in [cuts.get((s, rule))])
        assert r["kept"] == (not r["base_failed"] and not bad)


def test_long_binomial_tails(spark):
    cases = [(1001, 400_000), (1100, 400_000), (2700, 1_000_000), (2857, 1_000_000), (1500, 400_000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.log_tail(F.col("k"), F.col("n"), 0.02 / 7).alias("p"))
    for k, n, p in df.collect():
        term = math.fsum([math.lgamma(n + 1), -math.lgamma(k + 1), -math.lgamma(n - k + 1), k * math.log(0.02 / 7), (n - k) * math.log1p(-0.02 / 7)])
        total = x = 1.0
        for i in range(k, 0, -1):
            x *= i / (n - i + 1) * (1 - 0.02 / 7) / (0.02 / 7)
            total += x
        assert p == pytest.approx(min(0.0, term + math.log(total)), abs=1e-6)


@pytest.mark.parametrize("stage", ["judge", "accepted"])
def test_cutoffs_come_from_all_labels(spark, stage, monkeypatch):
    # 0.24 % of the good documents lie beyond 0.5, which only some 100,000 labels tell from the risk of 0.02 / 7
    if stage == "judge":
        m = measures(spark, 400_000, symbol_ratio=F.when((F.col("id") % 2500).between(100, 105), 0.6).otherwise(0.45))
        cut = quality.cutoffs(m, m.select("doc_id", F.lit(1).alias("quality"))).first()["cut_symbol_ratio"]
    else:
        counts = {"n_words": 20, "word_chars": 100, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 1, "n_bangs": 0, "n_upper": 0, "n_letters": 90}
        one = lambda docs, keep: docs.select(*keep, F.when((F.col("doc_id") % 2500).between(100, 105), 60).otherwise(45).alias("n_symbols"), *[F.lit(v).alias(c) for c, v in counts.items()])
        real, seen, whole = quality.cutoffs, [], quality.measured
        monkeypatch.setattr(quality, "measured", lambda docs, keep: one(docs, keep) if "doc_id" in keep else whole(docs, keep))
        monkeypatch.setattr(quality, "cutoffs", lambda *a: seen.append(real(*a)) or seen[0])
        docs = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
        quality.accepted(docs, docs.select("doc_id", F.lit(1).alias("quality")))
        cut = seen[0].first()["cut_symbol_ratio"]
    assert cut == 0.5


def test_token_counts(spark, corpus, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = corpus + ["a<|endoftext|>b <|endoftext|><|endoftext|>", "don't  we'll\r\n\t x", " \n a  b \n\n  z", "²³ 你好 １２ \x1c", "tok " * 3000]
    lib = Tokenizer.from_file(path)
    for r in tokens.count_tokens(frame(spark, texts), path).collect():
        t = texts[r["doc_id"]] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 512)
    c = tokens.counter(path)
    # texts of any script are counted by the proven set; only the other pieces are merged
    other = ["Привет, мир! Это the end", "日本語のテキスト and 漢字", "🎉🎉 party 👩‍👩‍👧 ok", "مرحبا بالعالم 123", "naïve ─ box “quoted” text", "x" + "Ж" * 5000]
    merged, tokenize = [], c.model.tokenize

    class Model:
        def tokenize(self, piece):
            merged.append(piece)
            return tokenize(piece)

    monkeypatch.setattr(c, "model", Model())
    for t in other:
        merged.clear()
        assert c.strange(t) and c(t) == len(lib.encode(t, add_special_tokens=False).ids)
        pieces = [p for p, _ in c.lib.pre_tokenizer.pre_tokenize_str(t)]
        assert merged == [p for p in pieces if len(tokenize(p)) != 1] and len(merged) < max(2, len(pieces))
    assert all(len(lib.encode(x, add_special_tokens=False).ids) == 1 for x in itertools.islice(c.whole, 0, None, 97))


def multiset(t):
    w = words(t)
    if len(w) < 5:
        return collections.Counter([tuple(w)] if w else [])
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


@pytest.mark.parametrize("tile,first", [(1 << 13, 4), (6, 4), (11, 1)])
def test_near_duplicates(spark, corpus, monkeypatch, tile, first):
    """As whole buckets, and dealt into tiles whose lists are short at first."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "FIRST", first)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = list(corpus)
    for i in range(40):  # a group of like texts whose members are not all alike
        w = list(base)
        for k in rng.sample(range(120), 2):
            w[k] = f"n{i}{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base), "a b c", "a b  c"]
    docs = frame(spark, texts, extra=True)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    m = [multiset(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        same = (texts[i] or "") == (texts[j] or "")
        if same or (m[i] and m[j] and sum((m[i] & m[j]).values()) >= 0.8 * sum((m[i] | m[j]).values())):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {find(i) for i in range(len(texts))}
    if tile < 1000:
        return
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs)
    assert near_dedup.deduplicated(twice).count() == kept.count()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = {int(k): int(v) for k, v in zip(rng.integers(0, 1 << 60, 200), rng.integers(1, 40, 200))}
    b = {k: int(rng.integers(1, 40)) if rng.random() < 0.3 else v for k, v in a.items()}
    want = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in a)
    row = np.repeat([0, 1], len(a))
    item = np.array([*a, *b], np.uint64)
    sig = near_dedup.signatures(row, item, np.array([*a.values(), *b.values()]), 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)
    assert not np.isinf(sig).any()


def test_long_words_and_chunks(monkeypatch):
    text = "a" * 3_000_000 + " b  c"
    h = [batches.words(d, o)[0] for _, _, d, o in batches.chunks(pa.array([text, None, "b"]))]
    flat = np.concatenate(h)
    assert len(flat) == 4 and flat[1] == flat[3] and len(set(flat.tolist())) == 3


def test_line_dedup(spark):
    rng = random.Random(3)
    v = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n \n", "a b c d e\n\na b c d\na b c d e f"]
    for _ in range(120):
        texts.append("\n".join(" ".join(rng.choice(v[: rng.choice([8, 60])]) for _ in range(rng.choice([1, 3, 5, 8, 30]))) for _ in range(rng.randint(0, 5))))
    base = [rng.choice(v) for _ in range(40)]
    for i in range(60):
        w = list(base)
        w[rng.randrange(40)] = f"u{i}"
        texts.append(" ".join(w) + "\n")
    got = {r["doc_id"]: r for r in line_dedup.line_counts(frame(spark, texts)).collect()}
    seen = []
    for i, t in enumerate(texts):
        out, n = [], 0
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if not s:
                continue
            n += 1
            if any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                out.append(k)
            seen.append(s)
        assert (got[i]["n_lines"], got[i]["removed"]) == (n, out)
    clean = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(frame(spark, texts)).collect()}
    assert clean[3] == "a b c d e\n" and clean[1] == ""


def test_line_dedup_packs_entries_and_reads_texts_once_a_round(spark, monkeypatch):
    rng = random.Random(8)
    v = [f"w{i}" for i in range(40)]
    texts = ["\n".join(" ".join(rng.choice(v[: rng.choice([9, 40])]) for _ in range(rng.choice([2, 6, 12]))) for _ in range(40)) for _ in range(12)]
    slim = line_dedup.identified(frame(spark, texts))
    lines, ranks = line_dedup.surveyed(slim)
    want = {i: [k for k, line in enumerate(t.split("\n")) if words(line)] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["lines"] for r in lines.collect()} == want
    sets = line_dedup.prefixed(slim, spark.sparkContext.broadcast(ranks), 0.8).withColumn("id", F.monotonically_increasing_id())
    sets = line_dedup.materialize(sets.coalesce(1))
    monkeypatch.setattr(line_dedup, "PARTS", 8)
    rows = line_dedup.spread(sets).collect()
    entries = [(r["part"], *e) for r in rows for e in np.frombuffer(r["block"], np.int64).reshape(-1, line_dedup.ENTRY).tolist()]
    # one row a task and part, however many entries there are; a token is in one part
    assert len(rows) <= max(8, 16 * 4) < len(entries) == sets.agg(F.sum(F.length("prefix"))).first()[0] // line_dedup.TOKEN_BYTES
    assert len({(e[0], e[1] >> 24) for e in entries}) == len({e[1] >> 24 for e in entries})
    # lists of several turns: their texts are read once a round
    calls = []
    for name in ("set_texts", "candidates"):
        monkeypatch.setattr(line_dedup, name, lambda *a, name=name, f=getattr(line_dedup, name): calls.append(name) or f(*a))
    for name, value in (("FIRST", 8), ("LONGER", 4), ("TAKEN", 1)):
        monkeypatch.setattr(line_dedup, name, value)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_counts(frame(spark, texts)).collect()}
    assert calls.count("set_texts") <= calls.count("candidates")
    seen = []
    for i, t in enumerate(texts):
        out = []
        for k, line in enumerate(t.split("\n")):
            s = frozenset(words(line))
            if s and any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                out.append(k)
            seen.append(s)
        assert got[i] == out


def test_line_dedup_meets_sets_whose_parity_differs_in_the_sign(spark):
    a, b = np.array([-1, 1, -(1 << 63), 0], np.int64), np.array([0, 0, 0, -2], np.int64)
    assert line_dedup.slots_apart(a, b).tolist() == [64, 1, 1, 63]
    # one text and copies with one word of 20 changed, by 120 different words: all but the first go, whichever slots differ
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(base)] + [" ".join(base[: i % 20] + [f"u{i}"] + base[i % 20 + 1 :]) for i in range(120)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_counts(frame(spark, texts)).collect()}
    assert got == {i: int(i > 0) for i in range(121)}


def test_line_dedup_lists_no_sets_that_are_out_of_reach(spark):
    schema = "id long, n int, b0 long, b1 long, prefix binary"

    def listed(sets, most):
        """(x, y, more) of sets [(size, tokens)] in the order of their ids."""
        rows = [(i, n, 0, 0, b"".join(t.to_bytes(line_dedup.TOKEN_BYTES, "big") for t in tokens)) for i, (n, tokens) in enumerate(sets)]
        return sorted(tuple(r) for r in line_dedup.candidates(line_dedup.spread(spark.createDataFrame(rows, schema)), 0.8, most).collect())

    # sets of 10 tokens share 9 at least if similar, but with the token in place 3 there are 8 at most: the list of set 2 ends at 0
    sets = [(10, [7, 11, 12, 13]), (10, [21, 22, 23, 7]), (10, [7, 31, 32, 33])]
    assert listed(sets, 1) == [(2, 0, False)]
    rng = random.Random(6)
    sizes = [1, 2, 3, 5, 9, 10, 12, 40, 47, line_dedup.MOST - 400, line_dedup.MOST - 1, line_dedup.MOST, line_dedup.MOST + 500]
    sets = []
    for _ in range(300):
        n = rng.choice(sizes)
        sets.append((n, rng.sample(range(25), min(n, 6))))
    want = []
    for x, (a, s) in enumerate(sets):
        for y, (b, t) in enumerate(sets[:x]):
            a, b = min(a, line_dedup.MOST), min(b, line_dedup.MOST)
            need, vague = math.ceil(0.8 / 1.8 * (a + b) - 1e-9), line_dedup.MOST in (a, b)
            for token in set(s) & set(t):
                i, j = s.index(token), t.index(token)
                if min(a, b) >= 0.8 * max(a, b) - 1e-9 and (vague or min(a - i, b - j) + (min(i, j) > 0) >= need):
                    want += [(x, y, False)] * (1 + (need < 2))
    got = listed(sets, len(sets))
    # of a set of MOST tokens or more some that were listed for their unknown size are left out, and nothing else
    extra = collections.Counter(want) - collections.Counter(got)
    assert not collections.Counter(got) - collections.Counter(want)
    assert all(line_dedup.MOST in (min(sets[x][0], line_dedup.MOST), min(sets[y][0], line_dedup.MOST)) for x, y, _ in extra)
    for x, y, _ in extra:
        known = min(sets[x][0], sets[y][0])
        assert known < line_dedup.MOST and known - 5 < math.ceil(0.8 / 1.8 * (known + line_dedup.MOST) - 1e-9)


def test_words_are_hashed_in_windows_as_at_once(monkeypatch):
    texts = [None, "", "a", " \n\t", "\nb c\n", "é🎉 ß\x85y\x1cz", "q " * 9 + "y" * 300 + " z\n", "x y " * 200, "", "a b\n"]
    column = pa.array(texts, pa.string())
    (_, _, data, offsets), *_ = batches.chunks(column)
    whole = batches.words(data, offsets)
    monkeypatch.setattr(batches, "_WINDOW", 64)
    assert all((x == y).all() for x, y in zip(whole, batches.words(data, offsets), strict=True))
    at = [(row, int(offsets[row]) + m.start()) for row, t in enumerate(texts) for m in re.finditer(WORD.encode(), (t or "").encode())]
    assert list(zip(whole[1].tolist(), whole[2].tolist())) == at
    assert max(len(d) for *_, d, _ in batches.chunks(column, 100)) < len(data)


def test_line_dedup_verifies_by_bytes(spark):
    # only the six gap characters part words: \x85, \x1c and no-break spaces do not
    texts = [(0, "a b c d e"), (1, "a\tb c\x0b d e\r"), (2, "a b\x85c d e"), (3, "a b\x1cc d e"), (4, "a b\xa0c d e"), (5, "e d c b a é"), (6, "é")]
    pairs = spark.createDataFrame([(x, 0) for x in range(1, 7)], "x long, y long")
    got = line_dedup.similar(pairs, spark.createDataFrame(texts, "id long, text string"), 0.8).collect()
    assert sorted(r["x"] for r in got) == [1, 5]


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for kind, p in BASE:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            luhn = sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))) or (kind == "card" and not (13 <= len(d) <= 19 and luhn)) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    sys.set_int_max_str_digits(0)
    rng = random.Random(5)
    texts = [None, "", "a@b.c_x@y.z a@b.cd@e.f é🎉 me@x.org.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.0004", "4111 1111-1111 1111 4111111111111112 +1 (415) 555-2671. +12 3", "x" * 20000 + "@" + "a." * 9000 + "b", "1" * 30000 + ".2.3.4 " + "12 " * 9000, "+1" * 500]
    texts += ["".join(rng.choice("ab@.1+ -(7é\n_%") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [f"hi there please contact me user{i}@mail.example.org now" for i in range(60)] + [f"so please contact me @bob_{i}x soon" for i in range(10)]
    found = pii.find(frame(spark, texts)).select("doc_id", pii.told(F.col("base")).alias("b"), pii.told(F.col("spans")).alias("s")).collect()
    assert len(found) == len(texts)
    for r in found:
        want = ",".join(base_spans(texts[r["doc_id"]] or ""))
        assert r["b"] == want and r["s"].startswith(want)
    assert sum("found" in r["s"] for r in found) == 10
    assert hashlib.sha256(b"").hexdigest()  # of no spans


def test_personal_data_by_discovered_instances(spark):
    # a seed leads to the handles of step 0, these to the pattern of step 1, and so on; no later pattern has a seed
    texts = [f"hi there please contact me user{i}@mail.example.org now" for i in range(60)] + [f"so please contact me @s0_{i}x soon" for i in range(10)]
    for step in range(1, 6):
        texts += [f"and word{chr(96 + step)} handle @s{step - 1}_{i}x again" for i in range(10)]
        texts += [f"and word{chr(96 + step)} handle @s{step}_{i}x again" for i in range(2 if step < 5 else 1)]
        if step < 5:  # enough others that only this step's pattern introduces
            texts += [f"and word{chr(96 + step)} handle @s{step}_{i}x again" for i in range(2, 10)] + [f"and word{chr(96 + step)} handle @s{step - 1}_{i}x again" for i in range(10)] * 4
    texts += [f"near other thing @n{i}x there" for i in range(10)] + ["of word here"] * 5  # no seed leads there
    rows = pii.find(frame(spark, texts)).select("doc_id", pii.told(F.col("spans")).alias("s")).collect()
    got = {re.search("@[sn][0-9_]+x", texts[r["doc_id"]])[0] for r in rows if "found" in r["s"]}
    assert got == {f"@s{s}_{i}x" for s in range(5) for i in range(10)} | {"@s5_0x"}


def test_benchmark_leaks(spark):
    rng = random.Random(8)
    letters = "abcdefghij "
    item = "".join(rng.choice(letters) for _ in range(200)).strip()
    edited = list(item)
    for k in range(5, 200, 20):
        edited[k if k < len(edited) else -1] = "z"
    texts = ["junk " + item.upper() + "!! tail", "x " + "".join(edited) + " y", item[:90], None, "", "the", "other text", "say the  words"]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "?!"), (1, item), (4, "The words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.leaks(frame(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (7, 4)} and got[0, 1] == 0
    assert {r["doc_id"] for r in decontam.leaks(frame(spark, texts), bench, block=50).collect()} == {0, 1, 7}
    kept = decontam.decontaminated(frame(spark, texts, extra=True), bench)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 5, 6}
    assert decontam.leaks(frame(spark, texts), bench.limit(0)).count() == 0

    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            prev, row[0] = row[0], i
            for j, b in enumerate(t, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
        return min(row)

    for _ in range(100):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(2))
        hit = decontam.best_end(p, t, len(p))
        assert (hit[0] if hit else len(p)) == slow(p, t)


def test_units_of_a_bucket_hold_two_tiles(spark, monkeypatch):
    """One bucket of 2,000 rows, a third in its largest component: every x meets every y once, in units of bounded size."""
    monkeypatch.setattr(near_dedup, "TILE", 100)
    rows = [(7, i, i if i % 3 else 0, 0) for i in range(2000)] + [(8, 5000, 5000, 5001), (8, 5001, 5001, 5001)]
    left = spark.createDataFrame(rows, "key long, id long, root long, main long")
    units, tiled = near_dedup.dealt(left, [], len(rows))
    units = units.collect()
    assert tiled
    by_unit = collections.defaultdict(list)
    for r in units:
        by_unit[r["unit"]].append(r)
    assert max(map(len, by_unit.values())) <= 2 * 100 * 1.6 and len(by_unit) == 401
    met = collections.Counter((x["key"], x["id"], y["id"]) for u in by_unit.values() for x in u if x["asks"] and not x["in_main"] for y in u if y["met"])
    assert set(met.values()) == {1}
    assert set(met) == {(7, x[1], y[1]) for x in rows[:2000] if x[2] for y in rows[:2000]} | {(8, 5000, 5000), (8, 5000, 5001)}


def test_leaks_in_several_blocks_are_the_same(spark, monkeypatch):
    rng = random.Random(6)
    v = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    items = [" ".join(rng.choice(v) for _ in range(rng.randint(12, 30))) for _ in range(25)]
    texts = [" ".join(rng.choice(v) for _ in range(30)) + " " + rng.choice(items) + " end" for _ in range(20)] + [" ".join(rng.choice(v) for _ in range(40)) for _ in range(10)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, texts)
    key = lambda: sorted(map(str, decontam.leaks(docs, bench).collect()))
    one = key()
    monkeypatch.setattr(decontam, "BLOCK", 700)
    assert key() == one and len(one) >= 20


def test_leaks_use_the_whole_edit_budget(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    items, texts, want = [], [], set()
    for length in (9, 10, 19, 23, 24, 81, 144, 254):
        for kind in ("change", "drop", "add", "any", "spread"):
            core = (" ".join(word() for _ in range(length)))[: length - 2].replace(" ", "q" if length < 30 else " ").strip().ljust(length - 2, "q")
            item, k = f" {core} ", length // 10
            for extra in (0, 1):
                cut = list(core)
                places = [int((j + 0.5) * len(core) / (k + extra)) for j in range(k + extra)] if kind == "spread" else rng.sample(range(len(core)), k + extra)
                for at in sorted(places, reverse=True):
                    how = rng.choice(["change", "drop", "add"]) if kind == "any" else "change" if kind == "spread" else kind
                    cut[at : at + 1] = {"change": ["7"], "drop": [], "add": ["7", cut[at]]}[how]
                texts.append(f"{word()} {word()} {''.join(cut)} {word()} {word()}")
            items.append((len(items), item))
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    tidy = lambda t: f" {' '.join(re.findall('[a-z0-9]+', t))} "
    for i, t in enumerate(texts):
        for nr, item in items:
            item, t = tidy(item), tidy(t)
            k = len(item) // 10
            hit = decontam.best_end(item, t, k)
            want |= {(i, nr, hit[0])} if hit else set()
    assert sum(d == len(items[nr][1]) // 10 for _, nr, d in want) >= 30
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.leaks(docs, bench).collect()} == want
    kept = {r["doc_id"] for r in decontam.decontaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _, _ in want}


def test_licences(spark):
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.OTHER + [None, "", "prose\nReleased under the MIT License.\nmore"]
    texts += ["x y z " * 200 + "\n" + "MIT licensed. " + "k l m " * 300 + "All rights reserved.", "in the software " * 5000, "Licensed under the Foo Public License 1.1."]
    docs = frame(spark, texts, extra=True)
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    n = len(families)
    assert [got[i]["families"] for i in range(n)] == families
    assert all(got[i]["n_paragraphs"] == 0 for i in range(n, n + len(licenses.OTHER) + 2))
    assert [got[i]["families"] for i in range(len(texts) - 4, len(texts))] == ["mit", "mit,reserved", "", "unknown"]
    assert all(0.5 <= r["score"] <= 1 for r in got.values() if r["families"])
    twice = licenses.scan(docs.unionByName(docs)).groupBy("doc_id", "families").count().collect()
    assert len(twice) == len(texts) and all(r["count"] == 2 for r in twice)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_of_variants_of_a_family():
    judge = licenses.Classifier([])

    def told(text):
        raw = text.encode()
        return {f for _, _, f, _ in judge(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))}

    assert told("Licensed under CC BY-ND 4.0") == {"cc_nd"} and told("Licensed under CC BY 4.0") == {"cc_by"}
    assert told("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License") == {"cc_nd"}
    assert told("released under the GPLv3") == {"gpl"} and told("Licensed under the Mozilla Public License 2.0") == {"mpl"}


def test_licence_scores_against_a_plain_scan():
    """Every paragraph is scored: stretches, sums of weights and template shares against dictionaries and loops."""
    rng = random.Random(6)
    judge = licenses.Classifier([])
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.STRANGE + licenses.OTHER
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            lines.append("" if kind < 0.3 else " ".join(f"v{rng.randrange(99)}" for _ in range(rng.choice([2, 40, 500]))) if kind < 0.7 else rng.choice(notices))
        texts.append("\n".join(lines))
    token = lambda x: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
    names: dict = {}
    for x in notices + texts:
        w = token(x)
        h = licenses.tokens_of([" ".join(w)]).h.tolist()
        names |= dict(zip(w, h))
    code = lambda a, b: (names[a] * 3 + names[b]) % 2**64
    place = {int(v): i for i, v in enumerate(judge.vocabulary)}
    half, want = licenses.STRETCH // 2, set()
    for row, text in enumerate(texts):
        block: list[str] = []
        nr = -1
        for line in [*text.split("\n"), ""]:
            if token(line):
                block += token(line)
            elif block:
                nr += 1
                for k in range(max(1, -(-len(block) // half) - 1)):
                    # a pair counts in the stretches of its first word
                    at = range(k * half, min(len(block), (k + 2) * half))
                    seen = {place.get(names[block[i]]) for i in at} | {place.get(code(block[i], block[i + 1])) for i in at if i + 1 < len(block)}
                    seen = sorted(x for x in seen if x is not None)
                    if seen:
                        p = judge.probability((judge.w[seen].sum(0) + judge.b)[None])[0]
                        want.add((row, nr, k, tuple(np.round(p, 9))))
                block = []
    got = set()
    for row, text in enumerate(texts):
        t = licenses.tokens_of([text])
        which, p = judge.score(t)
        for s, q in zip(which, p):
            par = int(np.searchsorted(t.base, s, "right")) - 1
            got.add((row, par, int(s - t.base[par]), tuple(np.round(q, 9))))
    assert got == want
    for family, ts in licenses.TEMPLATES.items():
        for x in ts:
            shares = licenses.confirmed(licenses.tokens_of(["some words " + x + " and others"]).h)
            assert shares[family] == 1.0


def test_wrapped_licences(spark):
    blocks = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 100]
    texts = []
    for i, (_, t) in enumerate(blocks):
        mark = ["", " * ", "# ", "// "][i % 4]
        texts.append("import this\n\n" + "\n".join(mark + x for x in textwrap.wrap(t, 72)) + "\n\nand some more prose\n")
    texts += ["\n\n".join(x.split()) for _, x in blocks]  # words of their own paragraphs are no licence
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert [got[i]["families"] for i in range(len(blocks))] == [f for f, _ in blocks]
    assert all(got[i]["n_paragraphs"] == 1 for i in range(len(blocks)))
    assert all(got[i]["n_paragraphs"] == 0 for i in range(len(blocks), len(texts)))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    v, bad = [f"w{i}" for i in range(500)], ["idiot", "scum", "trash"]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(v) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for b in rng.sample(bad, 2):
                w[rng.randrange(60)] = b
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (None, "you idiot", "en", "a", 0)]
    docs, lab = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.97
    flipped = lab.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(r["score"] for r in toxicity.score(docs, flipped).collect()) == sorted(r["score"] for r in got)
    assert {r["score"] for r in toxicity.score(docs, lab.limit(0)).collect()} == {0.0}
