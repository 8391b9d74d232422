"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import GAP_BYTES, chunks, span_hashes, words
from .common import materialize, text_of

#: About this many labelled rows, picked by a hash of doc_id, train the model; the first CALIBRATE of 5 parts by
#: another hash calibrate it.
SAMPLE = 20_000
#: A lexicon entry is a whole word or the first STEMS letters of longer ones. Its log-ratio of shares in toxic and other
#: documents, both shrunk by SHRINK documents, must be CERTAIN times its standard deviation and its ratio RATIO at least.
LEXICON, STEMS, SHRINK, CERTAIN, RATIO = 600, (4, 5, 6), 0.5, 3.0, 4.0
NEAR = 5
#: Words of the second person.
SECOND = "you your yours yourself youre ya u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus su sus".split()
#: Signs that stand for letters.
LEET = dict(zip("0134578@$!|+", "oieastbasiit"))

FEATURES = ("log_words", "hits", "hit_rate", "distinct", "hidden", "hidden_rate", "second_rate", "near_hits", "nearness", "upper_rate", "caps_rate", "bang_rate", "question_rate", "mask_rate", "digit_in_word", "single_rate", "stretch_rate", "dense", "stems", "stem_rate", "stem_kinds")

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_leet = _low.copy()
for _k, _v in LEET.items():
    _leet[ord(_k)] = ord(_v)
_letter = np.zeros(256, bool)
_letter[97:123] = True
_letter[128:] = True
_not_letter_low = ~_letter[_low]
#: Tells the hash of a stem from that of a word.
_STAR = np.uint64(0x2A5C6E1B9D3F7081)


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(_low[data], np.array([0]), np.array([len(data)]))[0])


def stem_hits(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Whether the first letters of each word are a stem of the lexicon, whose stems end in a star."""
    hit = np.zeros(len(starts), bool)
    if not len(starts):
        return hit
    # places of the letters: UTF-8 bytes that continue none
    heads = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))
    at = np.searchsorted(heads, starts)
    for k in STEMS:
        stop = heads[np.minimum(at + k, len(heads) - 1)]
        longer = np.flatnonzero(stop < ends)
        if len(longer):
            hit[longer] |= np.isin(span_hashes(low, starts[longer], stop[longer]) ^ _STAR, lexicon)
    return hit


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a chunk; texts without words have zeros."""
    n = len(offsets) - 1
    low = _low[data]
    h, row, starts, ends = words(low, offsets, _not_letter_low)
    total = np.bincount(row, minlength=n).astype(float)
    safe = np.maximum(total, 1)
    count = lambda r: np.bincount(r, minlength=n).astype(float)
    is_hit, is_second = np.isin(h, lexicon), np.isin(h, second)
    hits = count(row[is_hit])
    pairs = np.unique(np.stack([row[is_hit].astype(np.int64), h[is_hit].view(np.int64)]), axis=1)
    distinct = count(pairs[0])
    # distance in words from each hit to the second-person words on either side, in the same text
    at, you = np.flatnonzero(is_hit), np.flatnonzero(is_second)
    gap = np.full(len(at), 1000.0)
    if len(you) and len(at):
        after = np.searchsorted(you, at)
        for k in (after - 1, after):
            ok = (k >= 0) & (k < len(you))
            j = you[np.clip(k, 0, len(you) - 1)]
            ok &= row[j] == row[at]
            gap = np.where(ok, np.minimum(gap, abs(j - at)), gap)
    near = count(row[at[gap <= NEAR]])
    nearness = np.bincount(row[at], weights=1.0 / (1.0 + gap), minlength=n)
    # most hits within 50 words
    dense = np.zeros(n)
    if len(at):
        last = np.searchsorted(at, at + 50)
        stop = np.searchsorted(row[at], row[at], "right")
        np.maximum.at(dense, row[at], np.minimum(last, stop) - np.arange(len(at)))
    stemmed = stem_hits(low, starts, ends, lexicon)
    stem = count(row[stemmed])
    pairs = np.unique(np.stack([row[stemmed].astype(np.int64), h[stemmed].view(np.int64)]), axis=1)
    kinds = count(pairs[0])
    # tokens between gaps, read with signs as letters and other signs left out
    leet = _leet[data]
    gaps = GAP_BYTES[data]
    keep = _letter[leet] | gaps
    moved = np.concatenate([[0], np.cumsum(keep)])
    hh, hr, _, _ = words(leet[keep], moved[offsets], GAP_BYTES)
    hidden = np.maximum(count(hr[np.isin(hh, lexicon)]) - hits, 0)
    per_row = lambda mask: np.add.reduceat(np.append(mask, 0).astype(float), np.minimum(offsets[:-1], len(mask))) * (np.diff(offsets) > 0)
    chars = np.maximum(np.diff(offsets), 1)
    upper = (data >= 65) & (data <= 90)
    up = np.concatenate([[0], np.cumsum(upper)])
    caps = (up[ends] - up[starts] == ends - starts) & (ends - starts > 1)
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = _letter[low[:-2]] & _letter[low[2:]]
    mask = inner & ((data == 42) | (data == 35) | (data == 64) | (data == 36))
    digit = inner & (data >= 48) & (data <= 57)
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        same[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _letter[low[2:]]
    out = np.column_stack(
        [
            np.log1p(total), hits, hits / safe, distinct, hidden, hidden / safe, count(row[is_second]) / safe, near, nearness,
            per_row(upper) / chars, count(row[caps]) / safe, per_row(data == 33) / chars, per_row(data == 63) / chars,
            per_row(mask) / safe, per_row(digit) / safe, count(row[ends - starts == 1]) / safe, per_row(same) / safe, dense,
            stem, stem / safe, kinds,
        ]
    )
    return out * (total > 0)[:, None]


class Trees:
    """Logistic gradient boosting on binned features (second-order gains), and a step function that calibrates it."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 20, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(n, self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, w = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            tree = []
            for level in range(self.depth):
                k = 1 << level
                best = np.full(k, 1e-9)
                split = np.full((k, 2), -1)
                for j in range(d):
                    width = len(self.edges[j]) + 1
                    key = node * width + b[:, j]
                    sg, sw, sn = (np.bincount(key, weights=v, minlength=k * width).reshape(k, width).cumsum(1) for v in (g, w, np.ones(n)))
                    tg, tw, tn = sg[:, -1:], sw[:, -1:], sn[:, -1:]
                    gain = sg**2 / (sw + self.ridge) + (tg - sg) ** 2 / (tw - sw + self.ridge) - tg**2 / (tw + self.ridge)
                    gain[(sn < self.least) | (tn - sn < self.least)] = -1
                    at = gain.argmax(1)
                    top = gain[np.arange(k), at]
                    better = top > best
                    best[better] = top[better]
                    split[better] = np.column_stack([np.full(k, j), at])[better]
                tree.append(split)
                j, cut = split[node, 0], split[node, 1]
                right = (j >= 0) & (b[np.arange(n), np.maximum(j, 0)] > cut)
                node = node * 2 + right
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, w, k) + self.ridge)
            self.trees.append((tree, leaf))
            f = f + leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])
        n = len(x)
        f = np.full(n, self.start)
        for tree, leaf in self.trees:
            node = np.zeros(n, np.int64)
            for split in tree:
                j, cut = split[node, 0], split[node, 1]
                node = node * 2 + ((j >= 0) & (b[np.arange(n), np.maximum(j, 0)] > cut))
            f += leaf[node]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.at, self.value = isotonic(self.raw(x), y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability, linear between the steps of the isotonic fit; within a step the raw score still ranks, by a
        millionth at most."""
        f = self.raw(x)
        step = np.interp(f, self.at, self.value)
        return np.clip(step * (1 - 1e-6) + 1e-6 / (1 + np.exp(-f)), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators, with one good and one bad case added so that no step is 0 or 1: knots for np.interp."""
    order = np.argsort(x, kind="stable")
    means: list[list[float]] = []  # sum, weight, least x, greatest x
    for v, t in zip(x[order], y[order]):
        if means and means[-1][3] == v:
            means[-1][0] += t
            means[-1][1] += 1
        else:
            means.append([float(t), 1.0, float(v), float(v)])
        while len(means) > 1 and means[-2][0] * means[-1][1] >= means[-1][0] * means[-2][1]:
            s, w, _, hi = means.pop()
            means[-1][0] += s
            means[-1][1] += w
            means[-1][3] = hi
    at, value = [], []
    prior = float(y.mean())
    for s, w, lo, hi in means:
        p = (s + prior) / (w + 1)
        at += [lo, hi] if hi > lo else [lo]
        value += [p, p] if hi > lo else [p]
    return np.array(at), np.maximum.accumulate(np.array(value))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, part, text) of about `rows` labelled documents outside the held-out fifth."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(n, 1))))
    some = known.filter(share).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)).cast("int"))
    slim = docs.select("doc_id", text_of(docs).alias("text"))
    return slim.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "part", "text")


def stems(word: Column) -> Column:
    """The entries that a word may hit: itself, and with a star its first letters."""
    cut = [F.when(F.length(word) > k, F.concat(F.substring(word, 1, k), F.lit("*"))) for k in STEMS]
    return F.array_compact(F.array(word, *cut))


def lexicon_of(train: DataFrame) -> list[str]:
    """Words and stems much more usual in toxic documents of the sample, the surest first.

    Inflected languages spread a word over many forms, each too rare to tell; their common stem is not.
    """
    sizes = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return []
    entries = F.flatten(F.transform(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), stems))
    seen = train.select("toxic", F.explode(F.array_distinct(entries)).alias("w")).filter("length(w) > 1")
    c = seen.groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).filter("p > 1")
    p, q = F.col("p") + SHRINK, F.col("q") + SHRINK
    ratio = (p / (pos + 2 * SHRINK)) / (q / (neg + 2 * SHRINK))
    sure = F.log("r") / F.sqrt(1 / p + 1 / q)
    top = c.withColumn("r", ratio).withColumn("z", sure).filter((F.col("r") >= RATIO) & (F.col("z") >= CERTAIN))
    rows = top.orderBy(F.desc("z"), "w").limit(LEXICON).collect()
    return [r["w"] for r in rows]


def with_features(df: DataFrame, keep: list[str], lexicon: list[str], finish, schema: str) -> DataFrame:
    """mapInArrow over df (keep..., text): keep and what finish(features) adds."""
    lex = np.array(sorted({word_hash(w[:-1]) ^ int(_STAR) if w.endswith("*") else word_hash(w) for w in lexicon}), np.uint64)
    second = np.array(sorted({word_hash(w) for w in SECOND}), np.uint64)
    slim = df.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(data, offsets, lex, second) for _, _, data, offsets in chunks(batch.column(len(keep)))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            names, columns = finish(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *names])

    return slim.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[Trees | float, list[str]]:
    """The model (a constant if the sample has one class only) and its lexicon, from the bounded sample."""
    data = materialize(sample(docs, labels, rows))
    lexicon = lexicon_of(data.filter("part > 0"))
    as_list = lambda x: (["x"], [pa.array(list(x), pa.list_(pa.float64()))])
    got = with_features(data, ["doc_id", "toxic", "part"], lexicon, as_list, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, toxic int, part int, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["toxic"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return (float(y.mean()) if len(y) else 0.0), lexicon
    x, held = np.array([r["x"] for r in got]), np.array([r["part"] for r in got]) == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    model = Trees().fit(x[~held], y[~held])
    return model.calibrate(x[held], y[held]) if held.any() else model.calibrate(x, y), lexicon


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    held_out: crc32 of doc_id as text is a multiple of 5 (null doc_id: true); such labels are never learned from.
    Only the text enters a score; null text is empty, texts without words have all features zero. Without labels
    of both classes the score is their mean, 0 if there are none. Repeated rows are scored each.
    """
    model, lexicon = train(docs, labels, rows)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    slim = docs.select("doc_id", held.alias("held_out"), text_of(docs).alias("text"))

    def finish(x: np.ndarray):
        s = np.full(len(x), model) if isinstance(model, float) else (model.score(x) if len(x) else np.zeros(0))
        return ["score", "predicted"], [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

    kind = slim.schema["doc_id"].dataType.simpleString()
    return with_features(slim, ["doc_id", "held_out"], lexicon, finish, f"doc_id {kind}, held_out boolean, score double, predicted int")
