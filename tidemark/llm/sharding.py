"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, text_of

SHARDS = 24
ROUNDS = 4
WALKS = 64


def feistel(number: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """A keyed bijection of 0..a*b-1, a*b >= n, as two digits that take turns in shifting each other."""
    a = max(1, isqrt(max(n - 1, 0)))
    b = -(-n // a) if n else 1
    high, low = F.call_function("div", number, F.lit(b).cast("long")), F.pmod(number, F.lit(b).cast("long"))
    for r in range(rounds):
        if r % 2 == 0:
            high = F.pmod(high + F.pmod(F.xxhash64(low, F.lit(seed), F.lit(r)), F.lit(a).cast("long")), F.lit(a).cast("long"))
        else:
            low = F.pmod(low + F.pmod(F.xxhash64(high, F.lit(seed), F.lit(r)), F.lit(b).cast("long")), F.lit(b).cast("long"))
    return high * F.lit(b).cast("long") + low


def permuted(number: Column, n: int, seed: int) -> Column:
    """Position of row `number` of n in the shuffle: the permutation is walked on while it is beyond n.

    The domain exceeds n by less than a = isqrt(n - 1) numbers, so a walk of more than WALKS steps needs a chain
    of that many rare numbers: impossible for a <= WALKS, below a**-WALKS otherwise; it would raise, not guess.
    """
    once = feistel(number, n, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), once, lambda at, _: F.when(at >= n, feistel(at, n, seed)).otherwise(at)
    )
    settled = F.when(once < n, once).otherwise(walk)
    return F.when(settled < n, settled).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 20240, text: str = "text") -> DataFrame:
    """docs with shard (0..shards-1) and slot (gapless from 0 in each shard); counts differ by one at most.

    Rows are numbered in the order of (doc_id, crc32 of the text, bytes of the text), nulls last; row i goes to
    place p = permuted(i), shard p mod shards, slot p div shards, so both can be computed from i, n and the seed.
    Rows of equal texts are rows of their own, which the shuffle spreads over the shards like any others; those that are
    equal in that order are interchangeable. Null text counts as empty. An empty table gives an
    empty result. Columns named shard or slot are replaced.
    """
    body = text_of(docs) if text == "text" else F.coalesce(docs[text], F.lit(""))
    keyed = docs.drop("shard", "slot")
    return placed(keyed, [docs["doc_id"], F.crc32(body), F.octet_length(body)], shards, seed)


def placed(rows: DataFrame, keys: list[Column], shards: int = SHARDS, seed: int = 20240) -> DataFrame:
    """rows with shard and slot as in shard(), numbered in the order of keys, nulls last; rows that tie in all keys are
    interchangeable. An empty table gives an empty result."""
    rn = numbered(rows, keys, "__row")
    n = rn.count()
    if n == 0:
        return rn.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("__row")
    return (
        rn.withColumn("__p", permuted(F.col("__row"), n, seed))
        .withColumns({"shard": F.pmod("__p", F.lit(shards)).cast("int"), "slot": F.call_function("div", F.col("__p"), F.lit(shards).cast("long"))})
        .drop("__p", "__row")
    )
