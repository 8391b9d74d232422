"""Small dense matrices as columns (array<array<double>>): moments from one aggregate, and Gauss-Jordan sweeps inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot below this share of its first value is taken for a linear combination of those swept before.
LEAST = 1e-10


def finite(names: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return ok


def moments(df: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, n, means, cross): the rows without a null, NaN or infinite value among names; cross holds the sums of products of
    deviations from the means. One partial aggregate of co-moments, which merge without loss of digits."""
    x = df.filter(finite(names)).select(*by, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(names)])
    p = len(names)
    sums = {(i, j): (F.var_pop(f"__{i}") if i == j else F.covar_pop(f"__{i}", f"__{j}")) * F.count(F.lit(1)) for i in range(p) for j in range(i, p)}
    cells = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"__{i}") for i in range(p)]).alias("means"), *[v.alias(f"__c{i}_{j}") for (i, j), v in sums.items()])
    cross = F.array(*[F.array(*[F.col(f"__c{min(i, j)}_{max(i, j)}") for j in range(p)]) for i in range(p)])
    return cells.select(*by, "n", "means", cross.alias("cross"))


def ridged(cross: Column, features: int, alpha: float) -> Column:
    """cross with alpha added to its first `features` diagonal places."""
    return F.transform(cross, lambda row, i: F.transform(row, lambda v, j: v + F.when((i == j) & (i < features), F.lit(float(alpha))).otherwise(0.0)))


def swept(matrix: Column, pivots: Column | Sequence[int], floor: Column | float, back: bool = False) -> Column:
    """matrix swept at each of the pivots in turn, which are the places of some variables in a symmetric matrix.

    Of cross products, sweeping the regressors leaves minus the inverse of their block, the coefficients of all other
    variables on them, and the residual cross products of those. back: undo sweeps. Pivots of floor or less in size are passed over.
    """
    at = pivots if isinstance(pivots, Column) else F.array(*[F.lit(int(k)) for k in pivots]).cast("array<int>")
    low = floor if isinstance(floor, Column) else F.lit(float(floor))
    sign = F.lit(-1.0 if back else 1.0)

    def step(m: Column, k: Column) -> Column:
        d = m[k][k]

        def cell(v: Column, i: Column, j: Column) -> Column:
            plain = v - m[i][k] * m[k][j] / d
            return F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), sign * v / d).otherwise(plain)

        return F.when(F.abs(d) > low, F.transform(m, lambda row, i: F.transform(row, lambda v, j: cell(v, i, j)))).otherwise(m)

    return F.aggregate(at, matrix, step)


def correlation(cross: Column, p: int, least: float = 1e-30) -> Column:
    """The correlation matrix of cross; a variable whose sum of squares is `least` or less has none with any other."""
    s = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: cross[i][i])

    def cell(v: Column, i: Column, j: Column) -> Column:
        return F.when(i == j, 1.0).when((s[i] > least) & (s[j] > least), v / F.sqrt(s[i] * s[j])).otherwise(0.0)

    return F.transform(cross, lambda row, i: F.transform(row, lambda v, j: cell(v, i, j)))
