"""Line dedup by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import GAP_BYTES, chunks, mix, owners, whole_groups, words
from .common import BitMap, discard, materialize, ranked, text_of

SIMILARITY = 0.8
#: Slots of the table of token counts by hash that orders tokens by rarity. Tokens of one slot share a count: that
#: costs candidates, never results.
SLOTS = 1 << 16
#: Bytes of text whose words are handled at a time; their numbers stay in the cache.
PIECE = 1 << 19
#: Bytes of a token in a prefix, and the largest size and place that an index entry tells; larger ones pass the filters.
TOKEN_BYTES, MOST = 5, (1 << 12) - 1
TOKEN_MASK = (1 << 8 * TOKEN_BYTES) - 1
#: Numbers of an entry; least parts that the tokens are dealt over, and entries that a task packs at a time.
ENTRY, PARTS, BLOCK = 4, 1 << 12, 1 << 19
#: Candidates that a bucket gives a set in the first round, how much longer each further round's lists are, and how many of
#: a set's list are verified first.
FIRST, LONGER, TAKEN = 16, 64, 4

_NEWLINE = 10


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and number of each line of a chunk."""
    breaks = np.flatnonzero(data == _NEWLINE)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets[:-1])
    return starts, row, np.arange(len(starts)) - first[row]


class LineSets:
    """The sets of distinct tokens of a chunk's lines.

    h, line: the tokens, by line, rarest first; size, key, b0, b1: of each line the number of its tokens, a hash of the set
    that does not depend on their order, and their parity in 128 slots. Lines that agree in all four count as equal.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rank: np.ndarray):
        starts, self.row, self.number = lines_of(data, offsets)
        h, _, at, _ = words(data, offsets, GAP_BYTES)
        line = owners(starts, at)
        slot = rank[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
        order = None
        if len(starts) < 1 << 20:
            # one number sorts by line, rarity and most of the hash
            one = (line.astype(np.uint64) << np.uint64(44)) | (slot << np.uint64(28)) | (h >> np.uint64(36))
            order = np.argsort(one)
            one, two = one[order], h[order]
            if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():
                order = None
        if order is None:
            order = np.lexsort((h, slot, line))
        h, line = h[order], line[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.h, self.line = h[new], line[new]
        n = len(starts)
        self.size = np.bincount(self.line, minlength=n)
        self.first = np.cumsum(self.size) - self.size
        self.real = np.flatnonzero(self.size > 0)
        at = self.first[self.real]
        own = mix(self.h)
        bit = own >> np.uint64(57)
        flag = np.uint64(1) << (bit & np.uint64(63))
        high = bit >> np.uint64(6) == 1
        a, self.b0, self.b1 = (np.zeros(n, np.uint64) for _ in range(3))
        if len(at):
            a[self.real] = np.add.reduceat(own, at)
            self.b0[self.real] = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), flag), at)
            self.b1[self.real] = np.bitwise_xor.reduceat(np.where(high, flag, np.uint64(0)), at)
        self.key = mix(a)

    def identity(self, lines: np.ndarray) -> list[pa.Array]:
        return [pa.array(x[lines].view(np.int64)) for x in (self.key, self.b0, self.b1)] + [pa.array(self.size[lines].astype(np.int32))]


IDENTITY = ["h", "b0", "b1", "n"]


def surveyed(slim: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """From one pass over slim(doc_id, th, text): (doc_id, th, lines), the numbers of each row's lines that have a word, from 0;
    and the rank of each slot by how often its tokens occur, over all documents. SLOTS numbers reach the driver."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "lines", "slots", "counts"]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        total, kind = np.zeros(SLOTS, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for start, end, data, offsets in chunks(batch.column(2), PIECE):
                h, _, at, _ = words(data, offsets, GAP_BYTES)
                total += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                starts, row, number = lines_of(data, offsets)
                line = owners(starts, at)
                line = line[np.flatnonzero(np.diff(line, prepend=-1))]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[line], minlength=end - start))]).astype(np.int32)
                lines = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[line].astype(np.int32)))
                none = [pa.nulls(end - start, t) for t in (ints, longs)]
                own = [batch.column(k).slice(start, end - start) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, lines, *none], names)
        some = np.flatnonzero(total)
        if len(some):
            told = [pa.array([some.astype(np.int32)], ints), pa.array([total[some]], longs)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, ints), *told], names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    both = materialize(slim.mapInArrow(survey, f"doc_id {kind}, th long, lines array<int>, slots array<int>, counts array<long>"))
    told = both.filter("slots IS NOT NULL").select(F.explode(F.arrays_zip("slots", "counts")).alias("z"))
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in told.groupBy("z.slots").agg(F.sum("z.counts")).collect():
        counts[slot] = n
    rank = np.empty(SLOTS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(SLOTS, dtype=np.uint64)
    return both.filter("slots IS NULL").select("doc_id", "th", "lines"), rank


def prefixed(slim: DataFrame, rank, similarity: float) -> DataFrame:
    """(doc_id, th, line, h, b0, b1, n, prefix) of each line with words of slim(doc_id, th, text).

    prefix: TOKEN_BYTES of each of the set's rarest tokens, in order. Sets of sizes n and m that are similar, and so share
    two tokens, have the first two that they share among their first n - ceil(t n) + 2 and m - ceil(t m) + 2.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, offsets in chunks(batch.column(2), PIECE):
                s = LineSets(data, offsets, rank.value)
                keep = np.minimum(s.size, s.size - np.ceil(similarity * s.size - 1e-9).astype(np.int64) + 2)
                short = np.arange(len(s.h)) - s.first[s.line] < keep[s.line]
                tokens = s.h[short].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
                ends = np.concatenate([[0], np.cumsum(keep[s.real]) * TOKEN_BYTES]).astype(np.int32)
                raw = np.ascontiguousarray(tokens)
                prefix = pa.Array.from_buffers(pa.binary(), len(s.real), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                at = pa.array(start + s.row[s.real])
                number = pa.array(s.number[s.real].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), number, *s.identity(s.real), prefix],
                    ["doc_id", "th", "line", *IDENTITY, "prefix"],
                )

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(cut, f"doc_id {kind}, th long, line int, h long, b0 long, b1 long, n int, prefix binary")


def prefix_tokens(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, owner, place): the tokens of the prefixes in column k, the row that each is of and its place there."""
    prefix = batch.column(k).cast(pa.large_binary())
    if not len(prefix):
        return (np.zeros(0, np.int64),) * 3
    _, offs, data = prefix.buffers()
    ends = np.frombuffer(offs, np.int64)[prefix.offset : prefix.offset + len(prefix) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, TOKEN_BYTES)
    token = np.zeros(len(raw), np.int64)
    for k in range(TOKEN_BYTES):
        token = (token << 8) | raw[:, k]
    many = np.diff(ends) // TOKEN_BYTES
    owner = np.repeat(np.arange(len(many)), many)
    return token, owner, np.arange(len(token)) - (np.cumsum(many) - many)[owner]


def tokens_of(sets: DataFrame) -> DataFrame:
    """(token) of all prefixes of sets(prefix)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(prefix_tokens(batch, 0)[0])], ["token"])

    return sets.select("prefix").mapInArrow(tokens, "token long")


def spread(sets: DataFrame, tokens=None, open_sets=None) -> DataFrame:
    """(part, block): an entry for each prefix token of sets(id, n, b0, b1, prefix), packed by parts of the tokens.

    A block holds the entries that a task has of a part: ENTRY numbers each, p (token, size and place), 2 id + open, b0 and b1.
    All entries of a token are of one part. With the maps `tokens` and `open_sets` only entries of such tokens, and `open` for
    such sets only.
    """
    parts = max(PARTS, 16 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packed(entries: list[np.ndarray]) -> pa.RecordBatch:
        m = np.concatenate(entries)
        part = (m[:, 0] >> 24 & TOKEN_MASK) % parts
        order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
        m, part = m[order], part[order]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        ends = (np.append(at, len(m)) * ENTRY * 8).astype(np.int32)
        block = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(m)])
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), block], ["part", "block"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, rows = [], 0
        for batch in batches:
            ids, n, b0, b1 = (batch.column(k).to_numpy() for k in range(4))
            token, owner, place = prefix_tokens(batch, 4)
            if tokens is not None:
                some = held(tokens.value, token)
                token, owner, place = token[some], owner[some], place[some]
            wanted = np.ones(len(ids), bool) if open_sets is None else held(open_sets.value, ids)
            m = np.empty((len(token), ENTRY), np.int64)
            m[:, 0] = (token << 24) | (np.minimum(n[owner], MOST).astype(np.int64) << 12) | np.minimum(place, MOST)
            m[:, 1] = (2 * ids + wanted)[owner]
            m[:, 2], m[:, 3] = b0[owner], b1[owner]
            for k in range(0, len(m), BLOCK):
                ready.append(m[k : k + BLOCK])
                rows += len(ready[-1])
                if rows >= BLOCK:
                    yield packed(ready)
                    ready, rows = [], 0
        if rows:
            yield packed(ready)

    return sets.select("id", "n", "b0", "b1", "prefix").mapInArrow(entries, "part int, block binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, p, id and open, b0, b1) of the entries of batches(part, block), in their order."""
    for batch in batches:
        block = batch.column(1).cast(pa.large_binary())
        if not len(block):
            continue
        _, offs, data = block.buffers()
        ends = np.frombuffer(offs, np.int64)[block.offset : block.offset + len(block) + 1]
        m = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int64).reshape(-1, ENTRY)
        part = np.repeat(batch.column(0).to_numpy(), np.diff(ends) // (8 * ENTRY))
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(m[:, k]) for k in range(ENTRY))], ["part", "p", "id", "b0", "b1"])


def slots_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the numbers differ; of a negative number bitwise_count would tell the bits of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def candidates(entries: DataFrame, similarity: float, most: int) -> DataFrame:
    """(x, y, more) from buckets of equal tokens: earlier sets y that the filters leave for x, earliest first.

    Only entries with `open` are asked for. The filters are exact: sizes within the ratio; the overlap that can still be
    reached if the token is one of the first two that the sets share; and the parity of the tokens in 128 slots, which
    differs in no more slots than the sets differ in tokens. So a similar pair is listed in two buckets at least (one of sets
    that may share a single token is listed twice). A set gets `most` candidates of a bucket at most, and more = true if it may have
    further ones. Entries of a bucket are in classes of size, so that a set meets three of them only; a part's entries
    are fixed-width numbers, 32 bytes a set and token.
    """
    rows = entries.repartition("part").sortWithinPartitions("part")
    size_class = np.floor(np.log(np.maximum(np.arange(MOST + 1), 1)) / -np.log(similarity) + 1e-9).astype(np.int64) if similarity < 1 else np.arange(MOST + 1)
    size_class = np.minimum(size_class, (1 << 22) - 2)
    #: overlap that sets with so many tokens in sum must have
    needed = np.ceil(similarity / (1 + similarity) * np.arange(2 * MOST + 1) - 1e-9).astype(np.int16)

    def closed(columns: list[np.ndarray]) -> pa.RecordBatch:
        """The candidates of whole buckets: in each step every open entry meets the next set of its list, all buckets at once."""
        _, p, ids, b0, b1 = columns
        # by token and class, then by id within them
        bucket = (p >> 24 & TOKEN_MASK) << 22 | size_class[(p >> 12) & MOST]
        order = np.argsort(bucket)
        bucket = bucket[order]
        head = np.diff(bucket, prepend=-1) != 0
        group, start = np.cumsum(head) - 1, np.flatnonzero(head)
        rank = ids[order] >> 1
        if rank.max() >> 40 or len(start) >> 22:
            rank = np.unique(rank, return_inverse=True)[1]
        key = (group << 40) + rank
        inner = np.argsort(key)
        key, order = key[inner], order[inner]
        p, ids, b0, b1 = p[order], ids[order] >> 1, b0[order], b1[order]
        wanted = (columns[2][order] & 1) == 1
        n, i = ((p >> 12) & MOST).astype(np.int16), (p & MOST).astype(np.int16)
        # what an entry can reach at most with any other; of a set of MOST tokens or more its size does not tell
        bound = np.where(n == MOST, 2 * MOST, n - i + (i > 0)).astype(np.int16)
        low = np.minimum.reduceat(n, start)
        of = bucket[start]
        have, more, got = np.zeros(len(p), np.int64), np.zeros(len(p), bool), []
        for side in (0, -1, 1):
            # entries that cannot reach even the smallest set of the other class are left out, on both sides
            near = np.zeros(len(start), bool)
            if side:
                near[max(0, -side) : len(start) - max(0, side)] = of[max(0, side) : len(start) + min(0, side)] == of[max(0, -side) : len(start) - max(0, side)] + side
            else:
                near[:] = True
            back = np.roll(near, side)
            asks = wanted & near[group] & (bound >= needed[n + np.roll(low, -side)[group]])
            gives = back[group] & (bound >= needed[n + np.roll(low, side)[group]])
            x, given = np.flatnonzero(asks), np.flatnonzero(gives)
            before = np.concatenate([[0], np.cumsum(gives)])
            at = before[start[group[x] + side]]
            end = before[np.searchsorted(key, key[x] + (side << 40)) if side else x]
            their_n, their_bound = n[given], bound[given]
            while True:
                live = at < end
                full = live & (have[x] >= most)
                more[x[full]] = True
                live &= ~full
                if not live.all():
                    x, at, end = x[live], at[live], end[live]
                if not len(x):
                    break
                need = needed[n[x] + their_n[at]]
                ok = np.flatnonzero(np.minimum(bound[x], their_bound[at]) >= need)
                i0, i1, need = x[ok], given[at[ok]], need[ok].astype(np.int64)
                a, b = n[i0].astype(np.int64), n[i1].astype(np.int64)
                vague = (a == MOST) | (b == MOST)
                reach = np.minimum(a - i[i0], b - i[i1]) + (np.minimum(i[i0], i[i1]) > 0)
                fit = (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & ((reach >= need) | vague)
                apart = slots_apart(b0[i0], b0[i1]) + slots_apart(b1[i0], b1[i1])
                fit &= (apart <= a + b - 2 * need) | vague
                i0, i1 = i0[fit], i1[fit]
                have[i0] += 1
                got.append((i0, i1))
                if (lone := need[fit] < 2).any():
                    got.append((i0[lone], i1[lone]))
                at = at + 1
        gx, gy = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(ids[gx]), pa.array(ids[gy]), pa.array(more[gx])], ["x", "y", "more"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(unpacked(batches)):
            yield closed(columns)

    return rows.mapInArrow(pairs, "x long, y long, more boolean")


#: Bits of the maps that tell most sets, lines and tokens apart from those that are wanted, before they are moved.
MAP_BITS = 1 << 24


def bit_map(df: DataFrame, number: str):
    """Broadcast map of which of MAP_BITS slots the numbers take; MAP_BITS / 64 rows at most reach the driver."""
    slot = F.pmod(F.col(number), F.lit(MAP_BITS))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    cells = df.select(F.shiftright(slot, 6).alias("cell"), flag.alias("f")).groupBy("cell").agg(F.bit_or("f").alias("bits"))
    table = np.zeros(MAP_BITS // 64, np.uint64)
    for cell, bits in cells.toLocalIterator():
        table[cell] = bits & 0xFFFFFFFFFFFFFFFF
    return df.sparkSession.sparkContext.broadcast(table)


def held(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each number may be in the map."""
    slot = numbers.astype(np.int64) & (MAP_BITS - 1)
    return (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def set_texts(slim: DataFrame, pairs: DataFrame, sets: DataFrame, rank) -> DataFrame:
    """(id, text): one line of each set that the pairs name, from the documents that may hold its first line."""
    used = materialize(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct())
    n = used.count()
    named = BitMap(used, "id", n).within(sets.select("id", *IDENTITY, F.col("first.doc_id").alias("doc_id")), F.col("id"))
    named = materialize(named.join(used, "id"))
    taken = bit_map(named, "h")
    texts = BitMap(named, "doc_id", n).within(slim.select("doc_id", "text"), F.col("doc_id")).select("text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for start, _, data, offsets in chunks(column, PIECE):
                s = LineSets(data, offsets, rank.value)
                wanted = s.real[held(taken.value, s.key[s.real].view(np.int64))]
                found, at, lines = [], -1, []
                for k in wanted:
                    if s.row[k] != at:
                        at = s.row[k]
                        lines = column[start + int(at)].as_py().split("\n")
                    found.append(lines[s.number[k]])
                yield pa.RecordBatch.from_arrays([*s.identity(wanted), pa.array(found, pa.string())], [*IDENTITY, "text"])

    lines = texts.mapInArrow(pick, "h long, b0 long, b1 long, n int, text string").groupBy(*IDENTITY).agg(F.first("text").alias("text"))
    out = materialize(lines.join(named.drop("doc_id"), IDENTITY).select("id", "text"))
    discard(named, used)
    return out


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The x of pairs(x, y) whose token sets have the similarity. texts: (id, text), one row per set."""
    both = pairs.select("x", "y").join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x")
    both = both.join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y").select("x", "tx", "ty")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(*(batch.column(k).cast(pa.binary()).to_pylist() for k in (1, 2))):
                # bytes split at the six gap characters and at no others
                s, t = set(a.split()), set(b.split())
                n = len(s & t)
                ok.append(n >= similarity * (len(s) + len(t) - n) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], ["x"])

    return both.mapInArrow(check, "x long").distinct()


def verified_in_turn(listed: DataFrame, gone: DataFrame | None, slim: DataFrame, sets: DataFrame, rank, similarity: float) -> DataFrame:
    """gone (x) and the x of listed(x, ys) that are similar to one of their ys, materialized; a few of a list are verified at a
    time, and only while nothing is found. The texts of all that the lists name are read once: one for each set at most."""
    pairs = listed.select("x", F.explode("ys").alias("y"))
    if not pairs.head(1):
        return gone if gone is not None else pairs.select("x")
    texts = set_texts(slim, pairs, sets, rank)
    at, width, left = 0, TAKEN, listed
    while True:
        now = similar(left.select("x", F.explode(F.slice("ys", at + 1, width)).alias("y")), texts, similarity)
        gone = materialize(now if gone is None else gone.unionByName(now).distinct())
        at, width = at + width, width * LONGER
        left = listed.filter(F.size("ys") > at).join(gone, "x", "left_anti")
        if not left.head(1):
            discard(texts)
            return gone


def kept_lines(slim: DataFrame, ranks: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, line) of the lines of slim(doc_id, th, text) that stay; th is a hash of the text, ranks are of surveyed().

    A line is a piece between line feeds with a word; its set is that of its distinct words. Lines are ordered by
    (doc_id, nulls last, th, line number). A line goes if an earlier line's set is equal or has the similarity
    (Jaccard). Equal sets are one class from the start, represented by its first line. Classes meet in the buckets
    of their prefix tokens, which list the earliest of them; a pair is a candidate if two buckets list it. Candidates are
    verified a few at a time. Further rounds, with longer lists each, are for those that are not settled and whose lists
    were cut: so a group of like lines does not emit all its pairs.
    """
    rank = slim.sparkSession.sparkContext.broadcast(ranks)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "line"))
    every = prefixed(slim, rank, similarity).groupBy(*IDENTITY).agg(first.alias("first"), F.first("prefix").alias("prefix"))
    # the parts of `first` are sorted faster than the whole
    by = [F.col("first.doc_id").asc_nulls_last(), F.col("first.th").asc(), F.col("first.line").asc()]
    sets = ranked(every, "first", "id", by=by, distinct=True)
    done, gone, most = None, None, FIRST
    entries = spread(sets)
    while True:
        found = candidates(entries, similarity, most).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more"))
        # of each set those that two buckets list, the earliest first
        each = found.groupBy("x").agg(F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.col("y")))).alias("ys"), F.max("more").alias("more"))
        if done is not None:
            each = each.join(done.select("x", F.col("ys").alias("old")), "x", "left")
            each = each.withColumn("ys", F.array_except("ys", F.coalesce("old", F.array().cast("array<bigint>")))).drop("old")
        listed = materialize(each.filter(F.col("more") | (F.size("ys") > 0)))
        gone = verified_in_turn(listed, gone, slim, sets, rank, similarity)
        left = materialize(listed.filter("more").select("x").join(gone, "x", "left_anti"))
        if not left.head(1):
            break
        most *= LONGER
        done = listed if done is None else materialize(done.unionByName(listed).groupBy("x").agg(F.flatten(F.collect_list("ys")).alias("ys")))
        asked = BitMap(left, "x").within(sets, F.col("id")).join(left, F.col("id") == F.col("x")).select("prefix")
        entries = spread(sets, bit_map(tokens_of(asked), "token"), bit_map(left, "x"))
        discard(left)
    out = sets.join(gone, F.col("id") == F.col("x"), "left_anti")
    return out.select("first.doc_id", "first.th", "first.line")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): doc_id and a hash of the text tell rows apart, but for repeated rows."""
    text = text_of(docs)
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def judged(slim: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, th, copies, lines, stay): of each distinct row its lines with words and those of its first copy that stay."""
    lines, ranks = surveyed(slim)
    own = lines.withColumn("line", F.lit(None).cast("int"))
    kept = kept_lines(slim, ranks, similarity).select("doc_id", "th", F.lit(None).cast("array<int>").alias("lines"), "line")
    return own.unionByName(kept).groupBy("doc_id", "th").agg(
        F.count("lines").alias("copies"), F.first("lines", True).alias("lines"), F.collect_list("line").alias("stay")
    )


def line_counts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines (with words), n_removed, removed (their numbers from 0, in order) of each row.

    Null text is empty; texts without words have no lines; a very long line is one set like any other; an empty
    table gives an empty result; of repeated rows all but one lose their lines.
    """
    each = judged(identified(docs), similarity).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    removed = F.when(F.col("nth") == 1, F.array_except("lines", "stay")).otherwise(F.col("lines"))
    out = each.select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.alias("removed"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and the text without its removed lines (lines without words stay); other columns are left out, doc_id joins them.

    Null text stays null, as it has no lines; of rows that repeat in doc_id and text, the later ones lose all their lines; lines of
    any length are compared whole; an empty table gives an empty result.
    """
    rows = identified(docs)
    stay = judged(rows, similarity).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "stay", "lines")
    nth = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("th"))
    out = rows.withColumn("nth", nth).join(stay, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    cut = F.when(F.col("nth") == 1, F.array_except("lines", "stay")).otherwise(F.col("lines"))
    out = out.select("doc_id", "text", cut.alias("cut"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("cut", i))
    return out.select("doc_id", F.when(F.size("cut") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
