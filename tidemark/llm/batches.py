"""Vectorised words of whole Arrow text columns: no Python object is made per word.

A word's hash is a random-table polynomial over its bytes modulo 2**64, mixed with its length. All of it depends on
fixed seeds only, so every worker gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about this many bytes; a longer single text is a chunk of its own.
CHUNK = 1 << 21
#: Bytes that the power tables reach; bytes whose words are hashed at a time, so that the sums stay in the cache.
_PIECE, _WINDOW = 1 << 20, 1 << 15

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) * 2 + 1
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PIECE, _BASE, np.uint64)]))
_INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PIECE, pow(_BASE, -1, 1 << 64), np.uint64)]))

GAP_BYTES = np.zeros(256, bool)
GAP_BYTES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each chunk, of `size` bytes or CHUNK, of a string column; nulls are empty."""
    size = CHUNK if size is None else size
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which also break at the positions in cuts."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of data[start:end], spans in order and apart."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        end = max(int(np.searchsorted(ends, base + _WINDOW, "right")), at + 1)
        stop = int(ends[end - 1])
        if stop - base > _PIECE:  # one word beyond the tables: its pieces are chained
            h = np.uint64(0)
            for p in range(base, stop, _PIECE):
                q = min(p + _PIECE, stop)
                part = (table[data[p:q]] * _POWERS[: q - p]).sum(dtype=np.uint64)
                h = mix(np.array([h ^ part], np.uint64))[0]
            out[at] = h
        else:
            sums = np.zeros(stop - base + 1, np.uint64)
            part = np.take(table, data[base:stop], mode="clip")
            part *= _POWERS[: stop - base]
            np.cumsum(part, out=sums[1:])
            s, e = starts[at:end] - base, ends[at:end] - base
            out[at:end] = (sums[e] - sums[s]) * _INVERSE[s]
        at = end
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def owners(firsts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each place, in order, the last of the firsts (from the least place or before it on) that is not beyond it."""
    return np.repeat(np.arange(len(firsts)), np.diff(np.searchsorted(places, firsts), append=len(places)))


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = GAP_BYTES, table: np.ndarray = _BYTE):
    """(hash, row, start, end) of each word of the chunk, in order."""
    starts, ends = spans(np.take(~gaps, data, mode="clip"), offsets)
    rows = owners(offsets[:-1], starts)
    return span_hashes(data, starts, ends, table), rows, starts, ends


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of `width` words of a row; a row of fewer words (one at least) is one shingle."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    full = np.zeros(n, bool)
    if n >= width:
        full[: n - width + 1] = rows[: n - width + 1] == rows[width - 1 :]
    places = np.flatnonzero(full)
    acc = np.zeros(len(places), np.uint64)
    for k in range(width):
        acc = mix(acc + hashes[places + k] + np.uint64(k + 1))
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            has = counts[few] > k
            short[has] = mix(short[has] + hashes[first[few[has]] + k] + np.uint64(k + 101))
        acc, at = np.concatenate([acc, short]), np.concatenate([rows[places], few])
        order = np.argsort(at, kind="stable")
        return acc[order], at[order]
    return acc, rows[places]


def multisets(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order, with counts."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(h)))


def whole_groups(batches: Iterator[pa.RecordBatch], group=lambda key: key, least: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by their first one, in pieces of about `least` rows, cut so that no
    group(first column) is parted."""
    ready: list[list[np.ndarray]] = []
    last: list[list[np.ndarray]] = []  # of the group that may go on
    join = lambda parts: [np.concatenate(c) for c in zip(*parts)]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        own = group(columns[0])
        edge = int(np.searchsorted(own, own[-1], "left"))
        if edge or (last and group(last[-1][0][-1:])[0] != own[0]):
            ready += [*last, [c[:edge] for c in columns]]
            last = []
        last.append([c[edge:] for c in columns])
        if sum(len(c[0]) for c in ready) >= least:
            yield join(ready)
            ready = []
    if ready or last:
        yield join([*ready, *last])
