"""Exact quantiles of large groups, without a sort or a map of all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch of the first pass: its ranks are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, q_<column>: array of the quantiles at shares): linear between order statistics, nulls left out, as percentile() gives.

    Two passes of partial aggregates. A sketch brackets each quantile within 2 / ACCURACY of the ranks on either side; then the
    values below the bracket are counted, and only those inside it, about 4 in ACCURACY, are gathered and sorted.
    """
    x = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    off = 2.0 / ACCURACY
    ends = [v for s in shares for v in (max(0.0, s - off), min(1.0, s + off))]
    sketch = lambda c: F.percentile_approx(c, ends, ACCURACY)
    first = x.groupBy(*by).agg(*[v for c in columns for v in (F.count(c).alias(f"n_{c}"), sketch(c).alias(f"s_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"z_{c}"))])

    def bracket(c: str, k: int) -> tuple[Column, Column]:
        low = F.col(f"a_{c}") if ends[2 * k] == 0.0 else F.col(f"s_{c}")[2 * k]
        return low, F.col(f"z_{c}") if ends[2 * k + 1] == 1.0 else F.col(f"s_{c}")[2 * k + 1]

    names = [(c, k) for c in columns for k in range(len(shares))]
    bounds = first.select(*by, *[F.col(f"n_{c}") for c in columns], *[v.alias(f"{side}_{k}_{c}") for c, k in names for side, v in zip("lh", bracket(c, k))])
    both = x.join(bounds, list(by))
    low, high = (lambda c, k: F.col(f"l_{k}_{c}")), (lambda c, k: F.col(f"h_{k}_{c}"))
    inside = lambda c, k: F.when((F.col(c) >= low(c, k)) & (F.col(c) <= high(c, k)), F.col(c))
    # the values next to the bracket: a small group's ranks are whole steps apart
    before = lambda c, k: F.max(F.when(F.col(c) < low(c, k), F.col(c)))
    after = lambda c, k: F.min(F.when(F.col(c) > high(c, k), F.col(c)))
    second = both.groupBy(*by).agg(
        *[F.first(f"n_{c}").alias(f"n_{c}") for c in columns],
        *[F.count_if(F.col(c) < low(c, k)).alias(f"b_{k}_{c}") for c, k in names],
        *[F.concat(F.array(before(c, k)), F.sort_array(F.collect_list(inside(c, k))), F.array(after(c, k))).alias(f"v_{k}_{c}") for c, k in names],
    )

    def value(c: str, k: int) -> Column:
        at = F.lit(float(shares[k])) * (F.col(f"n_{c}") - 1)
        whole = F.floor(at).cast("int")
        place = whole - F.col(f"b_{k}_{c}").cast("int") + 1
        v = F.col(f"v_{k}_{c}")
        below, part = F.get(v, place), at - whole
        return F.when(part > 0, below + part * (F.get(v, place + 1) - below)).otherwise(below)

    return second.select(*by, *[F.array(*[value(c, k) for k in range(len(shares))]).alias(f"q_{c}") for c in columns])
