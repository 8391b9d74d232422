"""SimHash against a plain computation: fingerprints from the definition, links from all pairs."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import queries, simhash, xxh

from .test_brute_force import COLUMNS


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """doc_id lists to their expected (doc_id, fingerprint, component)."""
    prints = [(d, fingerprint(t)) for d, t in rows]
    all_ = sorted({f for _, f in prints})
    root = {f: f for f in all_}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(all_):
        for b in all_[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        r = find(f)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return collections.Counter((d, f"{f:016x}", least.get(find(f))) for d, f in prints)


def corpus():
    rng = random.Random(3)
    v = ["".join(rng.choice("abcdefXYZéß漢") for _ in range(rng.randint(1, 11))) for _ in range(150)]
    texts = [None, "", " \t\n", "One", "two words", "Same Same", "x" * 3000, "a b\x0bc\x0c\rd", "\x85 \xa0 nbsp wide", "word " * 2000]
    texts += [" ".join(rng.choice(v) for _ in range(rng.randint(3, 200))) for _ in range(80)]
    for t in texts[20:60]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append("  ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    return rows + rows[30:35] + [(None, texts[40]), (None, "alone is this text with a null id here"), (None, None)]


def test_hashes_equal_the_library():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 9000, dtype=np.uint8)
    length = np.concatenate([np.arange(300), [1023, 1024, 1025, 4000], rng.integers(0, 40, 300)])
    start = rng.integers(0, 5000, len(length))
    for seed in (0, 42):
        got = xxh.hashes(data, start, start + length, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed) for s, n in zip(start.tolist(), length.tolist())]
    assert len(xxh.hashes(data, start[:0], start[:0])) == 0


@pytest.mark.parametrize("piece", [7, 1 << 17])
def test_fingerprints_by_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    from pyarrow import array

    rows = [t for _, t in corpus()][: 40 if piece == 7 else None]
    got = np.concatenate([simhash.fingerprints_of(d, o) for _, _, d, o in simhash.chunks(array(rows))])
    assert got.tolist() == [fingerprint(t) for t in rows]


@pytest.mark.parametrize("partitions", [1, 5])
def test_components_of_a_corpus(spark, partitions):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], COLUMNS).withColumns({c: simhash.F.lit("own") for c in ("fp", "own", "key", "root", "n", "component_id")})
    got = simhash.near_duplicates(docs.repartition(partitions)).collect()
    want = components(rows)
    assert collections.Counter(map(tuple, got)) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [8, 50, 4096])
def test_links_lose_no_component(spark, monkeypatch, tile):
    """Random fingerprints, chains of small steps, and one dense group that shares a block of bits and fills several trees."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:60]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.append(f)
    base = rng.getrandbits(64)
    fps += [base ^ sum(1 << b for b in rng.sample(range(48), rng.randint(1, 5))) for _ in range(200)]
    fps = sorted(set(fps) | {0, 1, (1 << 64) - 1, 1 << 63})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r[0] % (1 << 64), r[1] % (1 << 64)) for r in simhash.links(df, len(fps)).collect()]
    assert all((a in set(fps)) and (b in set(fps)) for a, b in edges)

    def classes(pairs):
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {f: find(f) for f in fps}

    assert classes(edges) == classes([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])


def test_a_search_follows_only_edges_within_the_radius(monkeypatch):
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    root, child = simhash.grown(fp, np.zeros(len(fp), np.int64), np.ones(len(fp), bool))
    parents, steps = np.nonzero(child >= 0)
    assert len(parents) == len(fp) - 1 and len(set(child[parents, steps])) == len(fp) - 1
    assert (np.bitwise_count(fp[parents] ^ fp[child[parents, steps]]) == steps - simhash.RADIUS).all()
    seen = [0]
    count = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: seen.__setitem__(0, seen[0] + len(x)) or count(x))
    everyone = np.ones(len(fp), bool)
    simhash.linked(fp, np.zeros(len(fp), np.int64), everyone, everyone)
    assert seen[0] < 0.6 * len(fp) ** 2


def test_query_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, queries.op12_simhash(spark, sf).collect())) == components([tuple(r) for r in docs])
