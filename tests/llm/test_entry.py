"""The registered queries and the pipeline on tables with nulls, repeats, ties, long texts, clashing columns and no rows."""

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidemark.llm import decontam, pii, sharding

from .test_brute_force import COLUMNS, base_spans, multiset, words

LABELS = "doc_id long, quality int, toxic int"
CLASH = ("size", "target", "source_size", "copies", "kept", "n", "key", "id", "node", "root", "stratum", "line", "th", "shard0", "score", "label", "bands", "rid", "row")


def write(folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    spark = docs.sparkSession
    near = [(i if i % 9 else None, i % 3 if i % 8 else None, [float(i % 5), None if i % 11 == 3 else 1.0, 0.5][: i % 4]) for i in range(220)] if docs.head(1) else []
    vectors = spark.createDataFrame(near + near[:3], "vec_id long, label int, embedding array<float>")
    vectors.withColumns({c: F.lit("own") for c in CLASH if c != "label"}).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    v = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [None, "", " \n\t", "one", "x" * 30_000, "b c " * 9_000, "\n".join(["same old line here"] * 30)]
    for _ in range(60):
        texts.append("\n".join(" ".join(rng.choice(v) for _ in range(rng.randint(4, 40))) for _ in range(rng.randint(1, 5))))
    for t in texts[10:40]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[12:20] + ["mail me@x.org or 1.2.3.4 at +1 (415) 555-2671", "Released under the MIT License."]
    items = [" ".join(rng.choice(v) for _ in range(20)) for _ in range(4)]
    texts += [f"{' '.join(rng.choice(v) for _ in range(20))} {items[0]} {' '.join(rng.choice(v) for _ in range(15))}", items[1].upper() + " and " + " ".join(rng.choice(v) for _ in range(12))]
    rows = [(i if i % 13 else i // 2, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += rows[30:33] + [(None, texts[50], "en", "a", 1), (None, None, None, None, None)]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    docs, items = rows
    df = spark.createDataFrame(docs, COLUMNS).withColumns({c: F.lit("own") for c in CLASH})
    labels = spark.createDataFrame([(r[0], i % 2, int(i % 7 == 0)) for i, r in enumerate(docs) if r[0] is not None] + [(None, 1, 1), (5, None, None)], LABELS)
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, None), (0, items[0])], "item_id long, text string")
    return write(tmp_path_factory.mktemp("tables"), df, labels, bench)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    none = lambda schema: spark.createDataFrame([], schema)
    return write(tmp_path_factory.mktemp("none"), none(COLUMNS), none(LABELS), none("item_id long, text string"))


QUERIES = {k: q for k, q in __spark_entry__.queries().items() if k.startswith("op")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_awkward_tables(spark, folder, rows, name):
    docs, _ = rows
    got = QUERIES[name](spark, folder).collect()
    ids = collections.Counter(r[0] for r in docs)
    if name.startswith(("op6_", "op13_")):
        return
    if name.startswith("op11_"):
        assert {(r["lang"], r["source"]) for r in got if r["part"] == "pair"} == {(d[2] or "", d[3] or "") for d in docs}
        return
    assert collections.Counter(r["doc_id"] for r in got) == ids
    by_text = collections.defaultdict(list)
    for r in docs:
        by_text[r[0]].append(r[1] or "")
    if name.startswith("op1_"):
        assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d[0]), len(words(d[1]))) for d in docs)
        assert all(r["taken"] <= 3 * r["size"] for r in got)
    if name.startswith("op3_"):
        for r in got:
            told = r["spans"].split(",") if r["spans"] else []
            base = [s for s in told if not s.startswith("found")]
            assert base in [base_spans(t) for t in by_text[r["doc_id"]]]
            assert r["n_email"] == sum(s.startswith("email") for s in base)
    if name.startswith("op9_"):
        sizes = collections.Counter(r["shard"] for r in got)
        assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes[k] for k in range(24)) <= 1
        assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k])) for k in sizes)
        want = sorted((str(d[0]), len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    if name.startswith("op4_"):
        for r in got:
            assert r["n_removed"] == len(r["removed"]) <= r["n_lines"] and r["removed"] == sorted(r["removed"])
        assert {(str(r["doc_id"]), r["n_lines"]) for r in got} == {(str(d[0]), sum(bool(words(x)) for x in (d[1] or "").split("\n"))) for d in docs}
    if name.startswith("op5_"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    if name.startswith("op7_"):
        for a, b in itertools.combinations([r for r in docs if r[0] is not None], 2):
            if (a[1] or "") == (b[1] or "") and by_text[a[0]] == [a[1] or ""] and by_text[b[0]] == [b[1] or ""]:
                c = {r["doc_id"]: r["class_id"] for r in got}
                assert c[a[0]] == c[b[0]]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_empty_tables(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.columns and df.count() == 0


def test_repeated_rows_count_each(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*[c.split(" ")[0] for c in COLUMNS.split(", ")])
    rows = docs.filter("doc_id BETWEEN 7 AND 20")
    twice = write(tmp_path, rows.unionByName(rows), spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    n = 2 * rows.count()
    for name in ("op2_license_scan", "op6_benchmark_leaks", "op8_quality_rules", "op10_token_counts"):
        got = QUERIES[name](spark, twice)
        if name != "op6_benchmark_leaks":
            assert got.count() == n
        pairs = got.groupBy(*[c for c in got.columns]).count().collect()
        assert all(r["count"] % 2 == 0 for r in pairs)


def expected(rows, items):
    """The documents that the five stages leave, with their number of copies, in plain Python; no cutoff is certified."""
    kept = []
    for r in rows:
        w = words(r[1])
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        if len(w) >= 10 and 100 * len(hit) <= 20 * len(w):
            kept.append(r)
    parent = list(range(len(kept)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    m = [multiset(r[1]) for r in kept]
    for i, j in itertools.combinations(range(len(kept)), 2):
        if kept[i][1] == kept[j][1] or sum((m[i] & m[j]).values()) >= 0.8 * sum((m[i] | m[j]).values()):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(kept)):
        groups[find(i)].append(kept[i])
    from hashlib import md5

    one = [min(g, key=lambda r: (r[0] is None, r[0] or 0, md5(r[1].encode()).digest())) for g in groups.values()]
    plain = lambda t: " " + re.sub(r"[\W_]+", " ", t.lower()).strip() + " "
    clean = [r for r in one if not any(decontam.best_end(plain(x), plain(r[1]), decontam.budget(len(plain(x)))) for x in items)]
    return kept, one, clean


def test_pipeline_against_plain_python(spark, folder, rows):
    docs, items = rows
    kept, one, clean = expected(docs, items)
    source = spark.read.parquet(f"{folder}/documents.parquet")
    at, seen = source, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = corpus_pipeline.materialize(stage(spark, at, folder))
        assert at.columns == source.columns
        seen.append(sorted((str(r["doc_id"]), r["text"]) for r in at.collect()))
    assert seen[0] == sorted((str(r[0]), r[1]) for r in kept)
    assert seen[1] == sorted((str(r[0]), r[1]) for r in one)
    assert seen[2] == sorted((str(r[0]), r[1]) for r in clean) and len(clean) < len(one) < len(kept)
    got = corpus_pipeline.run(spark, folder).collect()
    assert all(r["size"] == "own" and r["target"] == "own" for r in got)
    # the mix: systematic sampling within a source in the order of size, then doc_id
    sizes = collections.defaultdict(list)
    for r in clean:
        sizes[r[3]].append((len(words(r[1])), r[0] is None, r[0] or 0, r))
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(x[0] for x in sizes[s]) for s in names}
    target, open_ = {}, set(names)
    while open_:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            open_.discard(s)
    from hashlib import md5
    from math import floor

    want = collections.Counter()
    for s in names:
        u = int(md5(("mix|" + (s if s is not None else "\0")).encode()).hexdigest()[:5], 16) / 2**20
        rate = target[s] / total[s]
        for k, x in enumerate(sorted(sizes[s], key=lambda x: x[:3])):
            n = min(3, floor(u + (k + 1) * rate) - floor(u + k * rate))
            if n:
                want[str(x[3][0]), x[3][1]] += n
    assert collections.Counter((str(r["doc_id"]), r["text"]) for r in got) == want
    # the shards: at most one row apart, slots without gaps
    held = collections.Counter(r["shard"] for r in got)
    assert max(held.values()) - min(held[k] for k in range(sharding.SHARDS)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(held[k])) for k in held)


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_personal_data_extra_spans_by_the_stated_scores(spark):
    """Candidates, patterns and instances of a small corpus, scored in plain Python from the definition."""
    rng = random.Random(8)
    texts = [f"please write to user{i}@mail.example.org now" for i in range(70)]
    texts += [f"please write to @x{i}handle soon" for i in range(6)] + [f"you may find @x{i}handle there" for i in range(6)] + ["you may find @y0handle there"]
    # identifiers, words ahead of them and lines of any length
    texts += [f"please write to @{'z' * 200}{i} soon" for i in range(3)] + ["word " * 400 + "please write to @far1away now", f"{'y' * 90} {'q' * 70} @long1context"]
    texts += ["please write to nobody 7 times"] * 2 + [f"room number {rng.randrange(10**6)}" for _ in range(20)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    got = pii.find(spark.createDataFrame(rows, COLUMNS)).select("doc_id", pii.told(F.col("spans")).alias("s")).collect()
    mentions, pairs = [], collections.Counter()
    for t in texts:
        w = t.lower().split()
        pairs.update(zip(w, w[1:]))
        for k, x in enumerate(w):
            if k > 1 and len(x) >= 5 and any(c.isdigit() for c in x):
                mentions.append(((w[k - 2], w[k - 1]), x, "@mail" in x))
    known = {x for _, x, seed in mentions if seed}
    while True:
        trusted = {}
        for p in {p for p, _, _ in mentions}:
            here = [x for q, x, _ in mentions if q == p and x in known]
            precision = min(1.0, len(here) / pairs[p])
            if len(set(here)) >= pii.SUPPORT and precision >= pii.PRECISION:
                trusted[p] = precision
        fresh = set(known)
        for x in {x for _, x, _ in mentions}:
            miss = 1.0
            for p in {p for p, y, _ in mentions if y == x and p in trusted}:
                miss *= max(1 - trusted[p], 1e-9)
            if 1 - miss >= pii.ACCEPT:
                fresh.add(x)
        if fresh == known:
            break
        known = fresh
    found = {r["doc_id"] for r in got if "found" in r["s"]}
    assert found == {i for i, t in enumerate(texts) if any(x in known and "@mail" not in x for x in t.lower().split())} and found
