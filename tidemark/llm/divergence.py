"""How the sources of a language differ: term counts by a byte-level tokenizer, sparse matrices, exact divergences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import chunks, spans
from .common import discard, materialize, text_of
from .xxh import hashes

#: A term needs so many documents of its language; the prior count of a term; the scale of shares; terms reported a group.
LEAST, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: A task's counts are sent on when it holds so many cells, terms or bytes of terms.
CELLS, TERMS, BYTES = 1 << 21, 1 << 20, 1 << 26
#: Cells of a bucket of terms, about, and sources whose rows of the divergence matrix one task holds.
BUCKET, BLOCK = 1 << 16, 256

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def same_bytes(data: np.ndarray, starts: np.ndarray, others: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[start : start + length] equals the bytes from `other` on, for each slice."""
    at = np.repeat(starts, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    apart = data[at] != data[at + np.repeat(others - starts, length)]
    wrong = np.zeros(len(starts), bool)
    wrong[np.repeat(np.arange(len(starts)), length)[apart]] = True
    return ~wrong


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): a slice for each distinct run of bytes, and the number of its run for every slice.

    Slices are grouped by XXH64; every one is compared with its group's first one byte by byte, and those that only share the
    hash are grouped among themselves by their bytes.
    """
    _, first, of = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    length = ends - starts
    rep = first[of]
    equal = length == length[rep]
    some = np.flatnonzero(equal)
    equal[some] = same_bytes(data, starts[some], starts[rep[some]], length[some])
    own: dict[bytes, int] = {}
    firsts = list(first)
    for i in np.flatnonzero(~equal):
        run = data[starts[i] : ends[i]].tobytes()
        if run not in own:
            own[run] = len(firsts)
            firsts.append(i)
        of[i] = own[run]
    return np.array(firsts, np.int64), of


class Counts:
    """A task's counts by (group, term), with the terms and groups it has met."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> None:
        starts, ends = spans(_TERM[data], offsets)
        if not len(starts):
            return
        low = _LOWER[data]
        first, of = grouped(low, starts, ends)
        before = len(self.terms)
        known = np.array([self.terms.setdefault(low[a:b].tobytes(), len(self.terms)) for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        self.size += int((ends - starts)[first[known >= before]].sum())
        row = np.searchsorted(offsets, starts, "right") - 1
        cells, n = np.unique(row * len(first) + of, return_counts=True)
        row, of = np.divmod(cells, len(first))
        self.sum(group[row] << 32 | known[of], n, np.ones(len(n), np.int64))

    def sum(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        """One row a key joins the counts."""
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.parts.append((key[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)))
        self.held += len(at)

    def full(self) -> bool:
        if self.held > CELLS and len(self.parts) > 1:
            parts, self.parts, self.held = self.parts, [], 0
            self.sum(*(np.concatenate(x) for x in zip(*parts)))
        return self.held > CELLS // 2 or len(self.terms) > TERMS or self.size > BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        self.sum(*(np.concatenate(x) for x in zip(*parts)))
        key, n, docs = self.parts[0]
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for at in range(0, len(key), 1 << 16):
            some = slice(at, at + (1 << 16))
            group, term = pa.array(key[some] >> 32), pa.array(key[some] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), pa.array(n[some]), pa.array(docs[some])], ["lang", "source", "term", "n", "docs"])
        self.__init__()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text), summed within each task as far as its memory goes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            group = np.array([counts.groups.setdefault(k, len(counts.groups)) for k in keys], np.int64)
            for first, end, data, offsets in chunks(batch.column(2)):
                counts.add(data, offsets, group[first:end])
            if counts.full():
                yield from counts.flush()
        yield from counts.flush()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact for totals below 9 * 10**15: long division by three digits at a time."""
    whole, rest = np.divmod(count, total)
    digits = SCALE
    while digits > 1:
        step = min(digits, 1000)
        more, rest = np.divmod(rest * step, total)
        whole, digits = whole * step + more, digits // step
    return whole + 1


def divergences(cells: pd.DataFrame, groups: pd.DataFrame, block: int) -> pd.DataFrame:
    """(lang, source, part, item, value) that one bucket of a language's terms gives to its sources of one block.

    cells(source, term, n, n_lang): the bucket's counts; groups(lang, source, n_group, n_all, v): all sources of the
    language. The sources' shares are a CSR matrix whose blank cells hold the share of no occurrence; a source's row
    is spread out once, and one reduceat over all stored cells then gives its distance to every other source.
    """
    groups = groups.sort_values("source").reset_index(drop=True)
    names, lang, v = groups["source"].to_numpy(), groups["lang"][0], int(groups["v"][0])
    own = range(block * BLOCK, min((block + 1) * BLOCK, len(names)))
    pairs, tops = np.zeros((len(own), len(names)), np.int64), []
    if len(cells):
        of = pd.Series(np.arange(len(names)), names)[cells["source"]].to_numpy()
        term, words = pd.factorize(cells["term"])
        order = np.lexsort((term, of))
        of, term = of[order], term[order]
        n, n_lang = cells["n"].to_numpy()[order], cells["n_lang"].to_numpy()[order]
        total = groups["n_group"].to_numpy() + PRIOR * v
        p, blank = shares(n + PRIOR, total[of]), shares(np.full(len(names), PRIOR), total)
        above = p - shares(n_lang + PRIOR, int(groups["n_all"][0]) + PRIOR * v)
        edge = np.searchsorted(of, np.arange(len(names) + 1))
        stored = np.flatnonzero(np.diff(edge))
        for i, s in enumerate(own):
            mine = slice(edge[s], edge[s + 1])
            row = np.full(len(words), blank[s])
            row[term[mine]] = p[mine]
            # as if all other sources had no occurrences, then their stored cells
            level, times = np.unique(row, return_counts=True)
            pairs[i] = np.abs(level[:, None] - blank[None, :]).T @ times
            there = row[term]
            pairs[i, stored] += np.add.reduceat(np.abs(there - p) - np.abs(there - blank[of]), edge[stored])
            best = np.flatnonzero(above[mine] > 0) + edge[s]
            best = sorted(best, key=lambda k: (-above[k], words[term[k]]))[:TOP] if len(best) <= 4 * TOP else best_of(best, above, words, term)
            tops += [(lang, names[s], "term", words[term[k]], int(above[k])) for k in best]
    out = [(lang, names[s], "pair", names[t], int(pairs[i, t])) for i, s in enumerate(own) for t in range(len(names)) if s != t]
    return pd.DataFrame(out + tops, columns=["lang", "source", "part", "item", "value"])


def best_of(places: np.ndarray, value: np.ndarray, words: np.ndarray, term: np.ndarray) -> list[int]:
    """The first TOP places by value, ties by term: only those that tie with the last one or are above it are sorted."""
    last = np.partition(value[places], len(places) - TOP)[len(places) - TOP]
    return sorted(places[value[places] >= last], key=lambda k: (-value[k], words[term[k]]))[:TOP]


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: distances of a source to the others of its language, and its most typical terms.

    A term is a run of ASCII letters and of characters beyond ASCII, with A-Z in lower case; a language keeps the terms of at
    least LEAST of its rows. Share p of a term in a group: 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), N the group's
    occurrences of the V kept terms; all is whole numbers. Part `pair`: sum over the kept terms of |p - q| with each
    other source (0 if no term is kept). Part `term`: the first TOP terms by p minus the whole language's share. Null text, lang
    and source are ''; a repeated row counts again; an empty table gives an empty result; other columns are ignored.
    Python compares text by code point, which is the order of the UTF-8 bytes.
    """
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    slim = docs.select(text("lang"), text("source"), text_of(docs).alias("text"))
    counted = term_counts(slim).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    cells = counted.withColumns({"docs": F.sum("docs").over(w), "n_lang": F.sum("n").over(w), "head": F.col("source") == F.min("source").over(w)})
    cells = materialize(cells.filter(F.col("docs") >= LEAST).drop("docs"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count_if("head").alias("v"))
    groups = slim.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    by = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), F.coalesce(F.sum("n_group").over(by), F.lit(0)).alias("n_all"),
        F.coalesce(F.sum("v").over(by), F.lit(0)).alias("v"), F.count(F.lit(1)).over(by).alias("sources"),
    )
    groups = materialize(groups)
    buckets = max(1, -(-cells.count() // BUCKET))
    most = groups.agg(F.max("sources")).first()[0] or 0
    each = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-most // BLOCK) - 1)))).alias("block")
    left = cells.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "source", "term", "n", "n_lang", each)
    right = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).select("*", each)
    key = ["lang", "bucket", "block"]

    def one(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        return divergences(cells, groups, key[2])

    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(one, "lang string, source string, part string, item string, value long")
    parts = materialize(parts)
    discard(cells, groups)
    pair = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    first = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(first)
    term = parts.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= TOP)
    return pair.withColumn("rank", rank).unionByName(term).select("lang", "source", "part", "item", "value", "rank")
