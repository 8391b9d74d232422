"""The source audit against a plain computation from its definition, and its pieces."""

import collections
import random
import re

import numpy as np
import pytest

from tidemark.llm import divergence as dv
from tidemark.llm import queries

from .test_brute_force import COLUMNS


def expected(rows, least=30, top=50):
    """(lang, source, part, item, value, rank) of rows (text, lang, source) in plain Python."""
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (g, s), c in count.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        share, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(share[s][t] - q[t], t) for t in kept if own[s][t] > 0 and share[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return collections.Counter(out)


def corpus(n=400):
    rng = random.Random(9)
    v = ["".join(rng.choice("abcXYZéß漢🎉") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    rows = [(None, "en", "a"), ("", None, None), ("...123", "xx", "only"), ("x" * 50_000, "en", None), ("a\x00b\x7fc@d[e`f{g", "en", "b")]
    for i in range(n):
        k = i % 7
        words = [rng.choice(v[k * 8 : 60 + k * 9]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([" ", "-", "_", "1"]).join(words), ["en", "de", None][i % 3], ["a", "b", None, "c", "ç", "Z"][rng.randrange(6) if i % 2 else 0]))
    return rows + rows[40:60]


def frame(spark, rows):
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], COLUMNS)
    return docs.withColumns({c: docs["doc_id"] for c in ("term", "n", "docs", "item", "value", "rank", "part", "bucket", "block", "v")})


def told(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bucket,block,cells", [(1 << 16, 256, 1 << 21), (40, 2, 50)])
def test_audit_equals_the_definition(spark, monkeypatch, bucket, block, cells):
    monkeypatch.setattr(dv, "BUCKET", bucket)
    monkeypatch.setattr(dv, "BLOCK", block)
    monkeypatch.setattr(dv, "CELLS", cells)
    rows = corpus()
    got = told(dv.audit(frame(spark, rows).repartition(3)))
    want = expected(rows)
    assert got == want and {w[2] for w in want} == {"pair", "term"}


def test_few_documents_and_none(spark):
    rows = corpus(20)
    got = told(dv.audit(frame(spark, rows)))
    assert got == expected(rows) and {g[4] for g in got if g[2] == "pair"} >= {0}
    assert dv.audit(frame(spark, rows).limit(0)).count() == 0


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    rows = [t or "" for t, _, _ in corpus()]
    data = np.frombuffer(" ".join(rows).encode(), np.uint8)
    starts, ends = dv.spans(dv._TERM[data], np.array([0, len(data)]))
    monkeypatch.setattr(dv, "hashes", lambda d, a, b: ((b - a) % 3).astype(np.uint64))
    first, of = dv.grouped(data, starts, ends)
    runs = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert [runs[first[k]] for k in of] == runs and len(first) == len(set(runs))


def test_shares_are_exact():
    rng = random.Random(1)
    total = [rng.randrange(1, 9 * 10**15) for _ in range(500)] + [1, 5, 9 * 10**15 - 1]
    count = [rng.randrange(0, t + 1) for t in total]
    got = dv.shares(np.array(count), np.array(total))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in zip(count, total)]


def test_only_the_first_terms_are_returned(spark, monkeypatch):
    monkeypatch.setattr(dv, "TOP", 3)
    rows = corpus()
    assert told(dv.audit(frame(spark, rows))) == expected(rows, top=3)


def test_query_on_the_given_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()
    assert told(queries.op11_source_divergence(spark, sf)) == expected([tuple(r) for r in rows])
