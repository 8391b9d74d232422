"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, materialize, text_of

#: Edits allowed as a share of an item's characters.
ERROR_RATE = 0.1
#: Characters of items that one pass over the documents looks for (about 190 bytes of tables each in every worker); more items make more
#: passes.
BLOCK = 500_000


def plain(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank, one blank at either end; "" stays empty."""
    core = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(core == "", F.lit("")).otherwise(F.concat(F.lit(" "), core, F.lit(" ")))


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item: rate * length in whole edits, fewer than it has characters."""
    return max(0, min(int(rate * length), length - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets; with k edits one of them at least is left whole."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def parents(item: str, k: int) -> list[list[tuple[int, str, int, dict[str, int]]]]:
    """For each piece the larger stretches around it, small to large and without the whole item: (offset, text, edits, bits).

    The pieces are halved again and again. Of p pieces with fewer than p edits, one half of p' pieces has fewer than p',
    so each match of the item has a whole piece all of whose stretches match within their edits.
    """
    own = pieces(item, k)
    out: list[list[tuple[int, str, int, dict[str, int]]]] = [[] for _ in own]

    def halve(a: int, b: int) -> None:
        if b - a < 2:
            return
        if b - a <= k:
            text = "".join(t for _, t in own[a:b])
            node = (own[a][0], text, b - a - 1, bits(text))
            for i in range(a, b):
                out[i].insert(0, node)
        mid = (a + b) // 2
        halve(a, mid)
        halve(mid, b)

    halve(0, k + 1)
    return out


def bits(item: str) -> dict[str, int]:
    """For each character, a whole number with a bit for each of its places."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


def best_end(item: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(least edit distance of item to any stretch of text, end of the first such stretch), None if above k.

    Myers' bit-parallel search: one whole-number word holds a column of the table's vertical differences.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    masks = masks or bits(item)
    plus, minus, score, best = full, 0, n, None
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score <= k and (best is None or score < best[0]):
            best = (score, at)
    return best


class Searcher:
    """Finds the items of one block in plain texts."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items = [(key, text, budget(len(text), rate)) for key, text in items if text]
        self.bits = [bits(text) for _, text, _ in self.items]
        found: dict[str, list[tuple[int, int, list]]] = {}
        for nr, (_, text, k) in enumerate(self.items):
            for (offset, piece), around in zip(pieces(text, k), parents(text, k)):
                found.setdefault(piece, []).append((nr, offset, around))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, distance, end) of each item that the text holds within its budget."""
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for nr, offset, around in uses:
                start = end + 1 - length - offset  # of the item, if nothing before the piece is edited
                for at, part, k, masks in around:
                    a = start + at
                    if best_end(part, text[max(0, a - k) : a + len(part) + k], k, masks) is None:
                        break
                else:
                    starts.setdefault(nr, []).append(start)
        out = []
        for nr, at in starts.items():
            _, item, k = self.items[nr]
            best = None
            low = high = None
            windows = []
            for s in sorted(at):
                a, b = max(0, s - k), s + len(item) + k
                if high is not None and a <= high:
                    high = b
                else:
                    if high is not None:
                        windows.append((low, high))
                    low, high = a, b
            windows.append((low, high))
            for a, b in windows:
                hit = best_end(item, text[a:b], k, self.bits[nr])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
                    if best[0] == 0:
                        break
            if best:
                out.append((nr, *best))
        return out


_searchers: dict[str, Searcher] = {}


def searcher(name: str, load, rate: float) -> Searcher:
    if name not in _searchers:
        _searchers.clear()
        _searchers[name] = Searcher(load(), rate)
    return _searchers[name]


def block_count(items: DataFrame, block: int) -> int:
    """How many passes the items need."""
    return -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block)


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", plain(text_of(benchmark)).alias("text")).filter("text <> ''").distinct()


def one_block(items: DataFrame, i: int, n: int):
    """(name, broadcast list) of block i of n: (item_id, plain text); items are parted by hash."""
    rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(sorted(((r[0], r[1]) for r in rows), key=repr))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, allowed, end: the items that a text holds within their edit budget.

    distance is the least one in the text, end where that stretch ends in the plain text. Texts and items are compared
    in the plain() form, whole words at either end. Null and wordless texts and items match nothing; repeated
    documents are reported each, repeated items once. Documents stay where they are: each block of items, about `block`
    characters, is searched in one pass without a shuffle. The driver holds one block at a time: if there are several, what a
    pass finds is written out before the next block is read.
    """
    slim = docs.select("doc_id", plain(text_of(docs)).alias("text"))
    items = items_of(benchmark)
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, distance int, allowed int, end long"
    n = block_count(items, block)
    out = None
    for i in range(n):
        name, part = one_block(items, i, n)

        def search(batches: Iterator[pa.RecordBatch], part=part, name=name) -> Iterator[pa.RecordBatch]:
            find = searcher(f"{name}|{rate}", lambda: part.value, rate)
            for batch in batches:
                row, found = [], []
                for k, text in enumerate(batch.column(1)):
                    for hit in find(text.as_py()):
                        row.append(k)
                        found.append(hit)
                own = find.items
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array([own[nr][0] for nr, _, _ in found], item_type),
                        pa.array([d for _, d, _ in found], pa.int32()),
                        pa.array([own[nr][2] for nr, _, _ in found], pa.int32()),
                        pa.array([e for _, _, e in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "distance", "allowed", "end"],
                )

        one = slim.mapInArrow(search, schema)
        if n > 1:
            one = materialize(one)
            part.destroy()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose text holds no item within its budget; all columns stay, nothing is shuffled.

    Null and wordless texts and items match nothing, so without items all rows stay; repeated rows stay or go alike, repeated
    items are one; texts are searched whole; an empty table gives an empty result.

    The driver holds one block of items at a time: if there are several, the rows that a pass leaves are written out
    before the next block is read.
    """
    items = items_of(benchmark)
    n = block_count(items, block)
    out = docs
    for i in range(n):
        name, part = one_block(items, i, n)
        left = out.filter(_without(name, part, rate)(plain(text_of(out))))
        if n > 1:
            left = materialize(left)
            part.destroy()
            if out is not docs:
                discard(out)
        out = left
    return out


def _without(name: str, items, rate: float):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        find = searcher(f"{name}|{rate}", lambda: items.value, rate)
        return pa.array([not find(t.as_py()) for t in texts], pa.bool_())

    return clean
