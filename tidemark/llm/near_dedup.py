"""Near-duplicates by BagMinHash signatures, bands and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import CHUNK, chunks, mix, multisets, shingles, whole_groups, words
from .common import HOT, BitMap, discard, hot_join, hot_keys, materialize, text_of
from .components import components

WIDTH = 5
SIMILARITY = 0.8
#: 25 bands of 5 registers find a pair at 0.8 with probability 1 - (1 - 0.8**5)**25 > 0.99995.
BANDS, ROWS = 25, 5

#: A register is left unset by the first limit in about exp(-SLACK) of the rows, which are then drawn again.
SLACK = 4.0

_G = np.uint64(0x9E3779B97F4A7C15)


def signatures(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """BagMinHash: m registers for each row's weighted set of items; inf for a row without items.

    The weights 1, 2, 3, ... are the discretisation. An item's axis of weights is split into dyadic blocks
    (0,1], (1,2], (2,4], (4,8], ...; each block has a Poisson process of points whose random numbers depend on
    (item, block) alone, with rate m times the block's length; a point carries a register and a level in the block,
    and counts for a row if the level is within the item's weight there. A register keeps its first point. Two
    rows then agree in a register with the probability of their weighted Jaccard similarity, exactly. The work
    is bounded, as points are drawn in order of time up to a limit by which a row's registers are very likely all
    set; rows for which one is not are drawn again up to twice the limit.
    """
    sig = np.full(n_rows * m, np.inf)
    # blocks of an item of weight w: 0 .. ceil(log2 w)
    depth = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    each = np.repeat(np.arange(len(item)), depth)
    block = np.arange(len(each)) - np.repeat(np.cumsum(depth) - depth, depth)
    size = np.where(block > 0, np.int64(1) << np.maximum(block - 1, 0), 1)
    low = np.where(block > 0, size, 0)
    owner, w = row[each], weight[each]
    seed = mix(item[each] ^ mix((block + 1).astype(np.uint64) * _G))
    total = np.bincount(row, weights=weight, minlength=n_rows)
    with np.errstate(divide="ignore"):
        limit = (np.log(m) + SLACK) / total
    todo = np.ones(len(each), bool)
    while todo.any():
        at = np.flatnonzero(todo)
        time = np.zeros(len(at))
        draw = 0
        while len(at):
            draw += 1
            bits = mix(seed[at] + np.uint64(draw * int(_G) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * size[at])
            alive = time <= limit[owner[at]]
            at, time, bits = at[alive], time[alive], bits[alive]
            more = mix(bits + _G)
            register = ((more >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            level = low[at] + 1 + ((more & np.uint64(0xFFFFFFFF)).astype(np.int64) * size[at] >> 32)
            ok = level <= w[at]
            np.minimum.at(sig, owner[at][ok] * m + register[ok].astype(np.int64), time[ok])
        unset = np.isinf(sig.reshape(n_rows, m)).any(axis=1) & (total > 0)
        limit[unset] *= 2
        todo = unset[owner]
    return sig.reshape(n_rows, m)


#: Slots of the parity maps: SLOTS / 64 numbers a text.
SLOTS = 1024


def parities(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row SLOTS bits: whether an odd number of its items, each copy counting apart, falls into the slot."""
    each = np.repeat(np.arange(len(item)), weight)
    copy = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
    slot = mix(item[each] + mix((copy + 1).astype(np.uint64) * _G)) & np.uint64(SLOTS - 1)
    odd = np.bincount(row[each] * SLOTS + slot.astype(np.int64), minlength=n_rows * SLOTS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_rows, SLOTS), axis=1).view(np.int64)


def bands_of(data: np.ndarray, offsets: np.ndarray, width: int, bands: int, rows: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Band hashes of each text of a chunk, None for a text without words; number of shingles; parity maps."""
    n = len(offsets) - 1
    h, r, _, _ = words(data, offsets)
    s, r = shingles(h, r, n, width)
    row, item, weight = multisets(s, r)
    sig = signatures(row, item, weight, n, bands * rows).view(np.uint64).reshape(n, bands, rows)
    acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _G), (n, bands))
    for k in range(rows):
        acc = mix(acc ^ sig[:, :, k])
    size = np.bincount(row, weights=weight, minlength=n).astype(np.int64)
    keys = acc.view(np.int64)
    return [keys[i] if size[i] else None for i in range(n)], size, parities(row, item, weight, n)


def may_be_similar(a: str, b: str, similarity: float) -> Column:
    """An exact filter: false only for pairs below the similarity.

    Multisets of sizes n and m at Jaccard s differ in (1 - s) / (1 + s) (n + m) copies at most, and their parity maps
    (columns a0.., b0..; sizes a_n, b_n) differ in no more slots than the multisets differ in copies.
    """
    apart = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(SLOTS // 64)), F.lit(0))
    return apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{a}_n") + F.col(f"{b}_n")) + 1e-6


#: Pairs of texts that are compared at a time at most.
PAIRS = 256


def overlaps(left: pa.Array, right: pa.Array, width: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts, some pairs at a time: PAIRS, or fewer of long texts."""
    out = []
    n, at = len(left), 0
    size = np.cumsum([np.asarray(pc.fill_null(pc.binary_length(c), 0)) for c in (left, right)], axis=1).sum(axis=0)
    while at < n:
        end = max(at + 1, min(at + PAIRS, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right"))))
        a, b = left[at:end], right[at:end]
        at = end
        k = len(a)
        parts = []
        for side, column in enumerate((a, b)):
            for first, end, data, offsets in chunks(column):
                h, r, _, _ = words(data, offsets)
                s, r = shingles(h, r, end - first, width)
                parts.append((s, r + first, np.full(len(s), side)))
        s, r, side = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((side, s, r))
        s, r, side = s[order], r[order], side[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        group = np.cumsum(new) - 1
        groups = int(group[-1]) + 1 if len(group) else 0
        in_b = np.bincount(group, weights=side, minlength=groups)
        in_a = np.bincount(group, minlength=groups) - in_b
        pair = r[new]
        inter = np.bincount(pair, weights=np.minimum(in_a, in_b), minlength=k)
        union = np.bincount(pair, weights=np.maximum(in_a, in_b), minlength=k)
        out.append(np.divide(inter, union, out=np.zeros(k), where=union > 0))
    return np.concatenate(out) if out else np.zeros(0)


def verified(pairs: DataFrame, rows: int, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of the `rows` materialized pairs(a, b) whose texts are similar enough. texts(id, text): one row per node."""
    text = lambda name, to: texts.select(F.col("id").alias(name), F.col("text").alias(to))
    both = hot_join(pairs, text("a", "ta"), "a", "b", rows=rows).join(text("b", "tb"), "b").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(overlaps(batch.column(2), batch.column(3), width) >= similarity)
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:2]], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def contracted(links: DataFrame) -> DataFrame:
    """Edges with the components of links(a, b), fewer: each b keeps its least a, and its other a go to that one.

    b has a few a in each band at most, so its window holds that many rows.
    """
    m = links.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    own = m.select(F.col("m").alias("a"), "b").distinct()
    return own.unionByName(m.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct()).distinct()


class Signed:
    """The distinct texts of slim(node, text) with their signatures: node is the md5 of the text, id a number for it.

    signed: (node, id, bands, s_n, s0, s1, ...); texts without words are not in it.
    """

    bits = [f"s{k}" for k in range(SLOTS // 64)]

    def __init__(self, slim: DataFrame, similarity: float, width: int, bands: int, rows: int):
        self.slim, self.similarity, self.width = slim, similarity, width
        shape = ["s_n", *self.bits]

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys: list = []
                sizes, maps = [np.zeros(0, np.int64)], [np.zeros((0, len(shape) - 1), np.int64)]
                for _, _, data, offsets in chunks(batch.column(1)):
                    k, n, p = bands_of(data, offsets, width, bands, rows)
                    keys += k
                    sizes.append(n)
                    maps.append(p)
                flat = np.concatenate(maps)
                columns = [pa.array(np.concatenate(sizes)), *[pa.array(flat[:, k]) for k in range(len(shape) - 1)]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), *columns], ["node", "bands", *shape])

        schema = "node binary, bands array<bigint>, " + ", ".join(f"{c} long" for c in shape)
        one = slim.mapInArrow(sign, schema).filter("bands IS NOT NULL").dropDuplicates(["node"])
        self.signed = materialize(one.withColumn("id", F.monotonically_increasing_id()))

    def buckets(self) -> DataFrame:
        """(key, id, least) of the nodes that share a band with another one; least: the least id of the bucket."""
        keys = self.signed.select("id", F.explode("bands").alias("key"))
        ends = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("__top"), F.count(F.lit(1)).alias("n")).filter("least <> __top")
        ends = materialize(ends.drop("__top"))
        many, rows = ends.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.hot = hot_keys(ends, "key", rows or 0, "n")
        shared = BitMap(ends, "key", many).within(keys, F.col("key"))
        out = materialize(hot_join(shared, ends.drop("n"), "key", "id", self.hot))
        discard(ends)
        return out

    def shapes(self, ids: DataFrame, n: int, name: str, to: str) -> DataFrame:
        """(name, to_n, to0, ...) of the ids(id), n at most, among others."""
        some = BitMap(ids, "id", n).within(self.signed.select("id", "s_n", *self.bits), F.col("id"))
        return some.select(F.col("id").alias(name), *[F.col(c).alias(to + c[1:]) for c in ["s_n", *self.bits]])

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the materialized pairs(a, b) that the parity maps leave."""
        n = pairs.count()
        left, right = (pairs.select(F.col(c).alias("id")) for c in "ab")
        both = hot_join(pairs, self.shapes(left, n, "a", "p"), "a", "b", rows=n).join(self.shapes(right, n, "b", "q"), "b")
        return materialize(both.filter(may_be_similar("p", "q", self.similarity)).select("a", "b"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the materialized pairs(a, b) whose texts are similar enough, materialized."""
        n = pairs.count()
        if not n:
            return pairs
        used = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        named = materialize(BitMap(used, "id", 2 * n).within(self.signed.select("id", "node"), F.col("id")).join(used, "id"))
        maybe = BitMap(named, "node", 2 * n).within(self.slim, F.col("node"))
        # copies of a text meet before they move; then the exact join
        texts = materialize(maybe.groupBy("node").agg(F.first("text").alias("text")).join(named, "node").select("id", "text"))
        out = materialize(verified(pairs, n, texts, self.similarity, self.width))
        discard(named, texts)
        return out


def classes(slim: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, root): the class of each distinct text of slim(node, text) that is similar to another one, materialized.

    Equal texts are one node from the start. Nodes that share a band meet in a bucket; each bucket's members
    are verified against its least member (a star, not all pairs), and the links make components. Only pairs
    that pass an exact filter on parity maps are verified in full. In buckets that still hold several components, each
    member outside the largest one then meets the nearest members of other components, in lists of growing length, until it
    has a link, and so is in a larger class, or has met them all. So each pair that shares a band is either verified or within
    one class already, and no group emits all its pairs.
    """
    s = Signed(slim, similarity, width, bands, rows)
    members = s.buckets()
    first = materialize(members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    first_near = s.near(first)
    links = materialize(contracted(s.links(first_near)))
    found = materialize(components(links))
    discard(first, links)
    tested, most = first_near, FIRST
    while True:
        left = mixed(s, members, found)
        n = left.count()
        if not n:
            break
        listed = crossed(s, left, n, most)
        pairs = materialize(listed.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        links = s.links(pairs)
        if links is not pairs and links.head(1):
            # the classes so far are stars already
            edges = materialize(links.unionByName(found.select(F.col("root").alias("a"), F.col("node").alias("b"))))
            found = materialize(components(edges))
            discard(edges)
        cut = bool(listed.filter("more").head(1))
        discard(left, listed)
        if not cut:
            break
        tested = materialize(tested.unionByName(pairs))
        most *= LONGER
    return materialize(s.signed.select("id", "node").join(found.select(F.col("node").alias("id"), "root"), "id").select("node", "root"))


def mixed(s: Signed, members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, root, main) of the buckets whose members are in several components; main is the largest one there."""
    placed = members.select("key", "id").join(found.select(F.col("node").alias("id"), "root"), "id", "left")
    placed = placed.withColumn("root", F.coalesce("root", "id"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    live = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("k"))
    live = live.filter("k > 1").select("key", F.col("main.root").alias("main"))
    return materialize(hot_join(placed, live, "key", "id", s.hot))


#: Partners of a list in the first round, and how much longer each further round's lists are.
FIRST, LONGER = 4, 16
EXPANDED = 1 << 17
#: Rows of a tile: a bucket of more is dealt into tiles, each pair of which is a unit of work of its own.
TILE = 1 << 13

LISTED = "key long, x long, y long, ratio double, near long, tiled boolean"


def dealt(left: DataFrame, hot: list, n: int) -> tuple[DataFrame, bool]:
    """left(key, id, root, main), n rows, by units: (unit, key, id, root, in_main, asks, met, tiled); whether a bucket has several tiles.

    A row's tile is a hash of its id. Unit (i, j) of a bucket holds the rows of tile i outside the largest component, which ask,
    and all rows of tile j, which are met. So a unit has two tiles of rows, whatever the size of its bucket. Units
    are told apart by a 64-bit hash; two that share one would only give more pairs to verify.
    """
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    in_main = (F.col("root") == F.col("main")).alias("in_main")
    if (sizes.agg(F.max("c")).first()[0] or 0) <= TILE:
        yes = F.lit(True)
        return left.select(F.col("key").alias("unit"), "key", "id", "root", in_main, yes.alias("asks"), yes.alias("met"), F.lit(False).alias("tiled")), False
    counts = sizes.select("key", F.ceil(F.col("c") / TILE).cast("long").alias("k"))
    rows = hot_join(left, counts, "key", "id", hot, n).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")))
    rows = rows.select("key", "id", "root", in_main, "own", (F.col("k") > 1).alias("tiled"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    same, no, yes = F.col("own") == F.col("other"), F.lit(False), F.lit(True)
    role = lambda i, j, asks, met: F.struct(F.xxhash64("key", i, j).alias("unit"), asks.alias("asks"), met.alias("met"))
    met = role("other", "own", same, yes)
    roles = F.when(same | F.col("in_main"), F.array(met)).otherwise(F.array(met, role("own", "other", yes, no)))
    rows = rows.select("key", "id", "root", "in_main", "tiled", F.explode(roles).alias("r"))
    return rows.select("r.unit", "key", "id", "root", "in_main", "r.asks", "r.met", "tiled"), True


def crossed(s: Signed, left: DataFrame, n: int, most: int) -> DataFrame:
    """(a, b, more): members x of left(key, id, root, main), n rows, outside a bucket's largest component with members of its other
    components that the parity maps leave: of a bucket the `most` nearest ones by the maps for each x, so a text that many
    are copies of comes first; more: x has further ones.

    A unit's rows (dealt()) are fixed-width numbers, about 150 bytes a text; they are compared EXPANDED pairs at a time. The
    lists of a bucket of several tiles are merged by x.
    """
    placed, tiled = dealt(left, s.hot, n)
    shapes = s.shapes(left, n, "id", "m")
    maps = [f"m{k}" for k in range(SLOTS // 64)]
    # a text is in one bucket a band at most, so its rows are BANDS times its tiles
    rows = placed.join(shapes, "id").select("unit", "key", "id", "root", "in_main", "asks", "met", "tiled", "m_n", *maps)
    rows = rows.repartition("unit").sortWithinPartitions("unit", "id")
    share = (1 - s.similarity) / (1 + s.similarity)

    def closed(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The lists of whole units."""
        unit, key, ids, root, in_main, asks, met, in_tile, size, *words = columns
        parity = np.stack(words, axis=1).view(np.uint64)
        head = np.ones(len(unit), bool)
        head[1:] = unit[1:] != unit[:-1]
        of = np.cumsum(head) - 1
        # the rows that are met, unit by unit
        there = np.flatnonzero(met)
        width = np.bincount(of[there], minlength=int(head.sum()))
        start = np.cumsum(width) - width
        few = np.flatnonzero(asks.astype(bool) & ~in_main.astype(bool))
        total = np.cumsum(width[of[few]])
        at = 0
        while at < len(few):
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + EXPANDED, "right")))
            x = few[at:end]
            at = end
            each = width[of[x]]
            p = np.repeat(x, each)
            q = there[np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each) + start[of[p]]]
            other = root[p] != root[q]
            p, q = p[other], q[other]
            apart = np.zeros(len(p), np.int64)
            for k in range(parity.shape[1]):
                apart += np.bitwise_count(parity[p, k] ^ parity[q, k])
            both = size[p] + size[q]
            near = apart <= share * both + 1e-6
            p, q, ratio = p[near], q[near], apart[near] / np.maximum(both[near], 1)
            order = np.lexsort((ids[q], ratio, p))
            p, q, ratio = p[order], q[order], ratio[order]
            first = np.searchsorted(p, p, "left")
            rank = np.arange(len(p)) - first
            # how many there are in all stands in a list's first row
            there_are = np.where(rank == 0, np.searchsorted(p, p, "right") - first, 0)
            some = rank < most
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[p[some]]), pa.array(ids[p[some]]), pa.array(ids[q[some]]), pa.array(ratio[some]), pa.array(there_are[some]), pa.array(in_tile[p[some]].astype(bool))],
                [c.split(" ")[0] for c in LISTED.split(", ")],
            )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            yield from closed(columns)

    a, b = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    lists = rows.mapInArrow(pairs, LISTED)
    if not tiled:
        return materialize(lists.select(a, b, (F.col("near") > most).alias("more")))
    lists = materialize(lists)
    whole = Window.partitionBy("key", "x")
    merged = lists.filter("tiled").withColumns({"all": F.sum("near").over(whole), "rank": F.row_number().over(whole.orderBy("ratio", "y"))})
    merged = merged.filter(F.col("rank") <= most).select(a, b, (F.col("all") > most).alias("more"))
    out = materialize(lists.filter("NOT tiled").select(a, b, (F.col("near") > most).alias("more")).unionByName(merged))
    discard(lists)
    return out


def noded(docs: DataFrame) -> DataFrame:
    return docs.select(F.unhex(F.md5(text_of(docs))).alias("node"), text_of(docs).alias("text"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """doc_id, class_id: the least doc_id of all documents linked to this one by equal or similar texts.

    Texts are compared as multisets of runs of `width` words; a text of fewer words is one shingle of all its
    words, and a text without words only equals its exact copies. Null text is the empty text. Repeated rows
    stay and share a class. A null doc_id gets the class of its text, null if no other doc_id is there. An empty
    table gives an empty result.
    """
    found = classes(noded(docs), similarity, width)
    slim = docs.select("doc_id", F.unhex(F.md5(text_of(docs))).alias("node"))
    own = materialize(slim.groupBy("node").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("n")))
    hot = hot_keys(own, "node", own.agg(F.sum("n")).first()[0] or 0, "n")
    rooted = materialize(own.join(found, "node"))
    least = rooted.groupBy("root").agg(F.min("own").alias("class_id"))
    named = hot_join(rooted.select("node", "root"), least, "root", "node").select("node", "class_id")
    each = own.join(named, "node", "left").select("node", F.coalesce("class_id", "own").alias("class_id"))
    return hot_join(slim, each, "node", "doc_id", hot).select("doc_id", "class_id")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """docs with one row of each class: that of the least (doc_id, text); of rows that repeat, one stays.

    Null text is the empty text; a null doc_id is the largest; texts of any length are compared whole; an empty table gives an
    empty result. A row whose text neither repeats nor is in a class stays where it is. Of the others only those that are kept move,
    to tell repeated rows apart; the rows of a very common text (there are HOT such at most) are dropped where they are.
    """
    found = classes(noded(docs), similarity, width)
    node = F.unhex(F.md5(text_of(docs)))
    # nulls last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id")).alias("k")
    own = materialize(docs.select("doc_id", node.alias("node")).groupBy("node").agg(first, F.count(F.lit(1)).alias("n")))
    some = materialize(own.join(found, "node", "left").filter("n > 1 OR root IS NOT NULL"))
    best = some.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("k.x", "k.doc_id", "node")).alias("b"))
    kept = best.select("b.node", "b.doc_id").unionByName(some.filter("root IS NULL").select("node", "k.doc_id"))
    told = BitMap(some, "node")
    # texts that the map takes for some of these are kept too, each by its own first row
    others = told.within(own, F.col("node")).join(some.select("node"), "node", "left_anti").select("node", "k.doc_id")
    kept = materialize(kept.unionByName(others).select("node", F.col("doc_id").alias("doc"), F.xxhash64("node", "doc_id").alias("hash")))
    many = max((own.agg(F.sum("n")).first()[0] or 0) // HOT, HOT)
    common = own.filter(F.col("n") > many).select("node").join(kept, "node", "left").select("node", F.struct("doc").alias("hot"), F.col("hash").isNotNull().alias("stays"))
    common = materialize(common.select(F.col("node").alias("__node"), "hot", "stays"))
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    doc = F.col(names["doc_id"])
    moved = told.split(docs.select(*[docs[c].alias(new) for c, new in names.items()], node.alias("__node")), F.col("__node"))
    moved = moved.join(F.broadcast(common), "__node", "left").filter(F.col("stays").isNull() | (F.col("stays") & F.col("hot.doc").eqNullSafe(doc)))
    doubted = BitMap(kept, "hash").within(moved.filter("__in").withColumn("__hash", F.xxhash64("__node", names["doc_id"])), F.col("__hash"))
    exact = doubted.join(kept, (doubted["__node"] == kept["node"]) & doc.eqNullSafe(kept["doc"]))
    one = exact.withColumn("__nth", F.row_number().over(Window.partitionBy("__node").orderBy("__hash"))).filter("__nth = 1")
    back = lambda df: df.select(*[F.col(new).alias(c) for c, new in names.items()])
    return back(moved.filter("NOT __in")).unionByName(back(one))
