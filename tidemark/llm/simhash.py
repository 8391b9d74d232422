"""SimHash near-duplicates: fingerprints of whole texts, BK-trees over them, components of the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import GAP_BYTES, chunks, spans, whole_groups
from .common import discard, hot_join, hot_keys, materialize, text_of
from .components import components
from .xxh import hashes

WIDTH, SEED, RADIUS = 3, 42, 3
#: Nodes of a shard tree; a bucket of more is split into several trees.
TILE = 4096
#: Shingles that are hashed at a time, and (fingerprint, node) pairs that a search holds at a time at most.
PIECE, FRONTIER = 1 << 17, 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANES = np.uint64(0x0101010101010101)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's words in lower case, those of a row with one space between; the starts, ends and rows of the words."""
    inside = ~GAP_BYTES[data]
    starts, ends = spans(inside, offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    later = np.ones(len(starts), bool)
    later[:1] = False
    later[1:] = rows[1:] == rows[:-1]
    keep = inside
    keep[starts[later] - 1] = True
    out = data[keep]
    out = _LOWER[np.where(GAP_BYTES[out], np.uint8(32), out)]
    if len(starts):
        upto = np.cumsum(keep)
        starts, ends = upto[starts] - 1, upto[ends - 1]
    return out, starts, ends, rows


def majority(h: np.ndarray, rows: np.ndarray, n_rows: int, bits: np.ndarray) -> None:
    """Add to bits[row, b] how many of the row's hashes have bit b. rows ascend.

    Eight bits at a time are counted in the bytes of one number, over runs of 255 hashes at most.
    """
    if not len(h):
        return
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    width = np.diff(np.append(first, len(h)))
    pieces = -(-width // 255)
    cut = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    owner = rows[cut]
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _LANES, cut)
        counts = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            bits[:, 8 * byte + k] += np.bincount(owner, counts[:, byte], n_rows).astype(np.int64)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each row of a chunk of texts."""
    n = len(offsets) - 1
    text, starts, ends, rows = normalised(data, offsets)
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    shingles = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    total = np.cumsum(shingles)
    bits = np.zeros((n, 64), np.int64)
    for at in range(0, int(total[-1]) if n else 0, PIECE):
        nth = np.arange(at, min(at + PIECE, int(total[-1])))
        row = np.searchsorted(total, nth, "right")
        left = first[row] + nth - (total[row] - shingles[row])
        right = np.minimum(left + width, first[row] + counts[row]) - 1
        majority(hashes(text, starts[left], ends[right], seed), row, n, bits)
    on = (2 * bits > shingles[:, None]).astype(np.uint64)
    return (on << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each row: fp is the fingerprint's 64 bits as a long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0, np.uint64)]
            for _, _, data, offsets in chunks(batch.column(1)):
                parts.append(fingerprints_of(data, offsets, width, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(sign, f"doc_id {kind}, fp long")


def grown(fp: np.ndarray, group: np.ndarray, in_tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A BK-tree over the tree members of each group: (root of each group, child of each node by distance).

    group ascends. A node's child at distance d is the root of the tree of all nodes below it that are d bits from it.
    Trees of all groups grow side by side, a level at a time. Distances are shifted by RADIUS, so that a search may look
    beyond both ends; -1: no child.
    """
    n = len(fp)
    child = np.full((n, 65 + 2 * RADIUS), -1, np.int32)
    root = np.full(int(group[-1]) + 1 if n else 0, -1, np.int64)
    left = np.flatnonzero(in_tree)
    segment = group[left]
    parent = np.full(len(left), -1, np.int64)
    edge = np.zeros(len(left), np.int64)
    while len(left):
        head = np.ones(len(left), bool)
        head[1:] = segment[1:] != segment[:-1]
        nodes = left[head]
        below = parent[head] >= 0
        child[parent[head][below], edge[head][below] + RADIUS] = nodes[below]
        root[segment[head][~below]] = nodes[~below]
        mine = nodes[np.cumsum(head) - 1][~head]
        rest = left[~head]
        far = np.bitwise_count(fp[rest] ^ fp[mine]).astype(np.int64)
        order = np.lexsort((far, mine))
        left, parent, edge = rest[order], mine[order], far[order]
        new = np.ones(len(left), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (edge[1:] != edge[:-1])
        segment = np.cumsum(new) - 1
    return root, child


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the nodes of each component of the links a - b one label, the least; label holds earlier links."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked(fp: np.ndarray, group: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """A label for each fingerprint: that of the least one linked to it, directly or by others, in searches of its group's tree."""
    root, child = grown(fp, group, in_tree)
    label = np.arange(len(fp))
    size = np.bincount(group[in_tree], minlength=len(root))
    who = np.flatnonzero(asks & (root[group] >= 0))
    cost = np.cumsum(size[group[who]])
    at = 0
    while at < len(who):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, "right")))
        q = who[at:end]
        at = end
        node = root[group[q]]
        while len(q):
            far = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            hit = (far <= radius) & (q != node)
            united(label, q[hit], node[hit])
            nexts, asking = [], []
            for step in range(-radius, radius + 1):
                c = child[node, far + step + RADIUS]
                has = c >= 0
                nexts.append(c[has])
                asking.append(q[has])
            q, node = np.concatenate(asking), np.concatenate(nexts).astype(np.int64)
    return label


def links(prints: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that join every two of the n distinct fingerprints of prints(fp) within RADIUS bits, directly or by others.

    Two such agree in one of RADIUS + 1 blocks of bits, so a fingerprint is a node of one tree for each block: that of its
    value there. A bucket of more than TILE nodes is dealt into several trees; each tree is then copied to the tasks that hold
    the fingerprints of the bucket's other trees, so no task holds more than two trees' nodes. A task returns
    a spanning forest of what it links, not all pairs.
    """
    parts = RADIUS + 1
    wide = 64 // parts
    keys = [F.shiftrightunsigned("fp", wide * i).bitwiseAND(F.lit((1 << wide) - 1)).bitwiseOR(F.lit(i << wide)) for i in range(parts)]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    counts = materialize(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = hot_keys(counts, "key", parts * n, "n")
    trees = F.ceil(F.col("n") / TILE).cast("long")
    placed = hot_join(dealt, counts.select("key", trees.alias("k")), "key", "fp", hot, parts * n)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    unit = F.shiftleft(F.col("key"), 44).bitwiseOR(F.shiftleft(low, 22)).bitwiseOR(high)
    # tree: a node of the unit's tree; asks: a fingerprint that goes through it
    tree, asks = F.col("own") == low, F.col("own") == high
    units = copies.select(unit.alias("unit"), "fp", tree.alias("tree"), asks.alias("asks"))
    units = units.repartition("unit").sortWithinPartitions("unit", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, in_tree, asks in whole_groups(batches, least=1 << 15):
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]).astype(np.int64))
            label = linked(fp.view(np.uint64), group, in_tree.astype(bool), asks.astype(bool))
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[label[moved]]), pa.array(fp[moved])], ["a", "b"])

    return materialize(units.mapInArrow(search, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that is reachable over links of RADIUS bits or fewer.

    Null text is the empty text, whose fingerprint is zero and is linked like any other. Repeated rows stay, each with the
    component of its fingerprint. A null doc_id gets its component's least doc_id, null if there is none. An empty table
    gives an empty result. Texts of any length are taken whole; they are hashed PIECE shingles at a time.
    """
    signed = materialize(fingerprints(docs))
    own = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("n")))
    distinct, rows = own.agg(F.count(F.lit(1)), F.sum("n")).first()
    hot = hot_keys(own, "fp", rows or 0, "n")
    edges = links(own.select("fp"), distinct)
    found = materialize(components(edges))
    discard(edges)
    rooted = own.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    named = hot_join(rooted.select("fp", "root"), least, "root", "fp", rows=distinct)
    out = hot_join(signed, named.select("fp", "component_id"), "fp", "doc_id", hot, rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
