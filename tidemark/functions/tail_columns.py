"""Distribution functions as column expressions, inside whole-stage code."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(z: Column) -> Column:
    """The normal distribution function: 1/2 + pdf(z) (z + z^3/3 + z^5/15 + ...) within 7 deviations, 0 or 1 beyond.

    The series is a fold that gets each term from the one before; 120 terms reach a double's last place there.
    """
    kind = "struct<term:double,sum:double>"
    zero = F.struct(z.alias("term"), z.alias("sum")).cast(kind)

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum")).cast(kind)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), zero, step, lambda acc: acc["sum"])
    return F.when(z > 7, 1.0).when(z < -7, 0.0).otherwise(0.5 + series * F.exp(-z * z / 2) / F.lit((2 * pi) ** 0.5))


def chi2_sf(x: Column, k: Column) -> Column:
    """Upper tail of chi-square with k degrees of freedom: a finite sum of (x/2)^i / gamma(i + 1), over whole i for an even k and
    halves for an odd one, which starts at the normal tail."""
    half, odd = F.greatest(x, F.lit(0.0)) / 2, k % 2
    kind = "struct<term:double,sum:double>"
    first = F.when(odd == 0, F.lit(1.0)).otherwise(F.sqrt(half) * F.lit(2 / pi**0.5))
    shift = F.when(odd == 0, F.lit(0.0)).otherwise(F.lit(0.5))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * half / (i + shift)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum")).cast(kind)

    last = F.floor((k - 1) / 2).cast("int") - odd.cast("int")
    terms = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")).cast(kind), step, lambda acc: acc["sum"])
    tail = 2 * (1 - norm_cdf(F.sqrt(2 * half)))
    return F.when(odd == 0, F.exp(-half) * total).when(k == 1, tail).otherwise(tail + F.exp(-half) * total)


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series at x + 8, and the product that leads back."""
    # Bernoulli numbers over 2k (2k - 1)
    terms = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)

    def value(x: Column) -> Column:
        y = x + 8.0

        def series(inverse: Column) -> Column:
            total = F.lit(terms[-1])
            for c in reversed(terms[:-1]):
                total = total * inverse + F.lit(c)
            return total

        back = x
        for k in range(1, 8):
            back = back * (x + float(k))
        return (y - 0.5) * F.log(y) - y + F.lit(0.5 * log(2 * pi)) + once(1 / (y * y), series) / y - F.log(back)

    return once(x, value)


def once(value: Column, body) -> Column:
    """body(value), with value worked out once: inside, it is a variable and not a copy of its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's recurrence, a fold that stands still once it has
    converged. The larger parameter's root tells how many steps it may take. a, b, x: variables."""
    kind = "struct<c:double,d:double,h:double,done:boolean>"
    tiny = 1e-300
    safe = lambda v: once(v, lambda u: F.when(F.abs(u) < tiny, F.lit(tiny)).otherwise(u))
    state = lambda c, d, h, done: F.struct(c.alias("c"), d.alias("d"), h.alias("h"), done.alias("done")).cast(kind)
    start = once(1 / safe(1 - (a + b) * x / (a + 1)), lambda d: state(F.lit(1.0), d, d, F.lit(False)))

    def moved(acc: Column, n: Column) -> Column:
        pair = F.struct((1 / safe(1 + n * acc["d"])).alias("d"), safe(1 + n / acc["c"]).alias("c"))
        return once(pair, lambda s: state(s["c"], s["d"], acc["h"] * s["c"] * s["d"], F.abs(s["c"] * s["d"] - 1) < 1e-16))

    def step(acc: Column, k: Column) -> Column:
        # k = 2, 3, 4, ... takes the even term of m = 1, its odd one, the even one of m = 2, ...
        def term(m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return once(F.when(k % 2 == 0, even).otherwise(odd), lambda n: moved(acc, n))

        return F.when(acc["done"], acc).otherwise(once(F.floor(k / 2).cast("double"), term))

    most = F.least(F.ceil(80 + 6 * F.sqrt(F.greatest(a, b))), F.lit(20_000)).cast("int")
    return F.aggregate(F.sequence(F.lit(2), 1 + 2 * most), start, step, lambda acc: acc["h"])


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), 0 below x = 0 and 1 above x = 1."""

    def value(s: Column) -> Column:
        front = F.exp(log_gamma(s["a"] + s["b"]) - log_gamma(s["a"]) - log_gamma(s["b"]) + s["a"] * F.log(s["x"]) + s["b"] * F.log1p(-s["x"])) / s["a"]
        got = front * _fraction(s["a"], s["b"], s["x"])
        return F.when(s["turned"], 1 - got).otherwise(got)

    def sides(s: Column) -> Column:
        turned = s["x"] > (s["a"] + 1) / (s["a"] + s["b"] + 2)
        pick = lambda yes, no: F.when(turned, yes).otherwise(no)
        arranged = F.struct(pick(s["b"], s["a"]).alias("a"), pick(s["a"], s["b"]).alias("b"), pick(1 - s["x"], s["x"]).alias("x"), turned.alias("turned"))
        return F.when(s["x"] <= 0, 0.0).when(s["x"] >= 1, 1.0).otherwise(once(arranged, value))

    return once(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x")), sides)


def t_sf(t: Column, v: Column) -> Column:
    """Upper tail of Student's t with v degrees of freedom."""

    def value(s: Column) -> Column:
        half = 0.5 * beta_inc(s["v"] / 2, F.lit(0.5), s["v"] / (s["v"] + s["t"] * s["t"]))
        return F.when(s["t"].isNotNull(), once(half, lambda h: F.when(s["t"] >= 0, h).otherwise(1 - h)))

    return once(F.struct(t.cast("double").alias("t"), v.cast("double").alias("v")), value)


def f_sf(f: Column, a: Column, b: Column) -> Column:
    """Upper tail of F with a and b degrees of freedom."""
    value = lambda s: F.when(s["f"] > 0, beta_inc(s["b"] / 2, s["a"] / 2, s["b"] / (s["b"] + s["a"] * s["f"]))).when(s["f"] <= 0, 1.0)
    return once(F.struct(f.cast("double").alias("f"), a.cast("double").alias("a"), b.cast("double").alias("b")), value)


def t_ppf(p: Column, v: Column, steps: int = 40) -> Column:
    """Quantile of Student's t with v degrees of freedom, 0 < p < 1.

    With t = sqrt(v) tan(angle) the quantile is an angle in (-pi/2, pi/2). Newton's steps start at the median and keep a
    bracket around the root; one that would leave it halves the bracket instead, and one that does not move ends the search.
    """
    kind = "struct<low:double,high:double,at:double,done:boolean>"
    state = lambda low, high, at, done: F.struct(low.alias("low"), high.alias("high"), at.alias("at"), done.alias("done")).cast(kind)

    def value(s: Column) -> Column:
        p, v, scale = s["p"], s["v"], s["scale"]

        def step(acc: Column, _: Column) -> Column:
            at = acc["at"]
            tail = 0.5 * beta_inc(v / 2, F.lit(0.5), F.pow(F.cos(at), F.lit(2.0)))
            over = once(tail, lambda h: F.when(at >= 0, 1 - h).otherwise(h) - p)

            def moved(over: Column) -> Column:
                ends = F.struct(
                    F.when(over < 0, at).otherwise(acc["low"]).alias("low"), F.when(over < 0, acc["high"]).otherwise(at).alias("high"),
                    (at - F.try_divide(over, scale * F.pow(F.cos(at), v - 1))).alias("to"),
                )
                inside = lambda e: (e["to"] >= e["low"]) & (e["to"] <= e["high"])
                return once(ends, lambda e: state(e["low"], e["high"], F.when(inside(e), e["to"]).otherwise((e["low"] + e["high"]) / 2), F.coalesce(inside(e) & (F.abs(e["to"] - at) < 1e-16), F.lit(False))))

            return F.when(acc["done"], acc).otherwise(once(over, moved))

        first = state(F.lit(-pi / 2), F.lit(pi / 2), F.lit(0.0), F.lit(False))
        return F.sqrt(v) * F.tan(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step, lambda acc: acc["at"]))

    v = v.cast("double")
    scale = F.exp(log_gamma((v + 1) / 2) - log_gamma(v / 2)) / F.lit(pi**0.5)
    return once(F.struct(p.cast("double").alias("p"), v.alias("v"), scale.alias("scale")), value)
