"""Statistical profiling of a return series per asset."""

from __future__ import annotations

from math import factorial, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.tail_columns import norm_cdf, once, t_ppf
from ..functions.tail_columns import chi2_sf
from ..functions.windows import lag, ordered
from .recommend import pattern


def filter_partition(df: DataFrame, part: str) -> DataFrame:
    """Feature selection 2020-2022, model development 2020-2023, holdout from 2024."""
    low, high = {"feature_selection": ("2020-01-01", "2023-01-01"), "model_dev": ("2020-01-01", "2024-01-01"), "holdout": ("2024-01-01", None)}[part]
    t = F.col("timestamp")
    out = df.filter(t >= F.lit(low).cast("timestamp_ntz"))
    return out if high is None else out.filter(t < F.lit(high).cast("timestamp_ntz"))


def tier(n: Column) -> Column:
    return F.when(n > 2000, "A").when(n >= 500, "B").otherwise("C")


def descriptive(df: DataFrame, c: str = "ret") -> DataFrame:
    """n, mean, sample deviation, population skewness and excess kurtosis, Jarque-Bera and its p, tier."""
    x = df.filter(F.col(c).isNotNull()).groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt")
    )
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0)
    flat = (F.col("n") < 3) | (F.coalesce("std", F.lit(0.0)) == 0)
    return x.withColumns({"jb": F.when(flat, 0.0).otherwise(jb), "jb_p": F.when(flat, 1.0).otherwise(F.exp(-jb / 2)), "tier": tier(F.col("n"))})


def autocorrelations(df: DataFrame, c: str = "ret", lags: int = 40) -> DataFrame:
    """(asset, n, lag, rho): products of lagged deviations by the sum of squares; one window and one aggregate."""
    clean = df.filter(F.col(c).isNotNull())
    d = clean.withColumn("__d", F.col(c) - F.avg(c).over(Window.partitionBy("asset")))
    d = d.withColumns({f"__p{k}": F.col("__d") * F.lag("__d", k).over(ordered()) for k in range(1, lags + 1)})
    a = d.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("v"), *[F.sum(f"__p{k}").alias(f"p{k}") for k in range(1, lags + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(f"p{k}", "v").alias("rho")) for k in range(1, lags + 1)]))
    return a.select("asset", "n", rows.alias("x")).select("asset", "n", "x.lag", "x.rho").filter(F.col("rho").isNotNull())


def ljung_box(acf: DataFrame, at: tuple[int, ...] = (5, 10, 20, 40)) -> DataFrame:
    """(asset, lag, q): n (n + 2) sum of rho^2 / (n - k)."""
    w = Window.partitionBy("asset").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag"))).over(w)
    return acf.withColumn("q", q).filter(F.col("lag").isin(*at)).select("asset", "lag", "q")


def chi2_p(df: DataFrame, x: str, k: str, name: str = "p") -> DataFrame:
    """df with the upper tail of chi-square."""
    return df.withColumn(name, chi2_sf(F.col(x), F.col(k)))


def pacf(rho: list[float]) -> list[float]:
    """Partial autocorrelations by the Levinson-Durbin recursion."""
    out, phi = [], []
    for k in range(1, len(rho) + 1):
        num = rho[k - 1] - sum(p * rho[k - 2 - j] for j, p in enumerate(phi))
        den = 1 - sum(p * rho[j] for j, p in enumerate(phi))
        new = num / den if den else 0.0
        phi = [p - new * q for p, q in zip(phi, reversed(phi))] + [new]
        out.append(new)
    return out


def kish_n_eff(n: int, rho: list[float]) -> float:
    """n / (1 + 2 sum rho), summed up to the first insignificant lag, within [1, n]."""
    total = 0.0
    for r in rho:
        if abs(r) < 1.96 / n**0.5:
            break
        total += r
    den = 1 + 2 * total
    return float(min(n, max(1.0, n / den))) if den > 0 else float(n)


def permutation_entropy(df: DataFrame, c: str = "ret", d: int = 3) -> DataFrame:
    """(asset, entropy, complexity): of the ordinal patterns of length d, counted and set against the uniform."""
    k = factorial(d)
    p = df.filter(F.col(c).isNotNull()).withColumn("__p", pattern(c, d)).filter("__p IS NOT NULL")
    counts = p.groupBy("asset", "__p").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("asset")
    s = counts.withColumn("q", F.col("n") / F.sum("n").over(total))
    mid = (F.col("q") + 1.0 / k) / 2
    a = s.groupBy("asset").agg((-F.sum(F.col("q") * F.log("q"))).alias("h"), (-F.sum(mid * F.log(mid))).alias("hm"), F.count(F.lit(1)).alias("seen"))
    half = 0.5 / k
    hm = F.col("hm") - (F.lit(k) - F.col("seen")) * half * log(half)
    js = F.greatest(hm - (F.col("h") + log(k)) / 2, F.lit(0.0))
    one = (1 + 1.0 / k) / 2
    most = -(one * log(one) + (k - 1) * half * log(half)) - log(k) / 2
    norm = F.least(F.greatest(F.col("h") / log(k), F.lit(0.0)), F.lit(1.0))
    return a.select("asset", norm.alias("entropy"), (js / most * norm).alias("complexity"))


def breakeven(df: DataFrame, c: str = "ret", cost: float = 0.002) -> DataFrame:
    """(asset, mean_abs, breakeven_da, mde_da): 0.5 + cost / (2 mean |r|), and the least detectable accuracy at n."""
    z = tails.norm_ppf(0.95) + tails.norm_ppf(0.80)
    a = df.filter(F.col(c).isNotNull()).groupBy("asset").agg(F.avg(F.abs(c)).alias("mean_abs"), F.count(F.lit(1)).alias("n"))
    box = lambda e: F.least(F.greatest(e, F.lit(0.5)), F.lit(1.0))
    return a.select("asset", "mean_abs", box(0.5 + F.try_divide(F.lit(cost), 2 * F.col("mean_abs"))).alias("breakeven_da"), box(0.5 + z / (2 * F.sqrt(F.col("n").cast("double")))).alias("mde_da"))


def regimes(df: DataFrame, c: str) -> DataFrame:
    """df with regime: LOW below the asset's first quartile of c, HIGH above the third, else NORMAL."""
    q = df.groupBy("asset").agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    x = df.join(q, "asset")
    return x.withColumn("regime", F.when(F.col(c) < F.col("__q")[0], "LOW").when(F.col(c) > F.col("__q")[1], "HIGH").otherwise("NORMAL")).drop("__q")


def benjamini_hochberg(p: DataFrame, value: str = "p", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """p with p_adj and reject; a family (all rows, or each `by`) is a table of tests, so one window may hold it."""
    asc = Window.partitionBy(*(by or [])).orderBy(value)
    desc = Window.partitionBy(*(by or [])).orderBy(F.desc(value), F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    d = p.withColumns({"__r": F.row_number().over(asc), "__m": F.count(F.lit(1)).over(Window.partitionBy(*(by or [])))})
    adj = F.least(F.lit(1.0), F.min(F.col(value) * F.col("__m") / F.col("__r")).over(desc))
    return d.withColumn("p_adj", adj).withColumn("reject", F.col("p_adj") <= alpha).drop("__r", "__m")


def holm(p: DataFrame, value: str = "p", alpha: float = 0.05) -> DataFrame:
    """p with reject by Holm's step-down: strict comparison, stopped at the first failure."""
    w = Window.orderBy(value)
    d = p.withColumns({"__r": F.row_number().over(w), "__m": F.count(F.lit(1)).over(Window.partitionBy())})
    ok = (F.col(value) < F.lit(alpha) / (F.col("__m") - F.col("__r") + 1)).cast("int")
    return d.withColumn("reject", F.min(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__r", "__m")


# -- estimators without a Spark form: NumPy kernels, one asset's series each --------------------------------------


def kernel(df: DataFrame, c: str, fit, schema: str) -> DataFrame:
    """fit(values in time order) -> dict, for each asset."""
    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("timestamp", kind="stable")[c].to_numpy(float)
        return pd.DataFrame([{"asset": key[0], **fit(x[np.isfinite(x)])}])

    return df.groupBy("asset").applyInPandas(one, f"asset string, {schema}")


def variance_ratio(x: np.ndarray, q: int) -> tuple[float, float]:
    """Lo-MacKinlay variance ratio at q and its heteroskedasticity-robust z."""
    n = len(x)
    if n <= q + 1:
        return float("nan"), float("nan")
    d = x - x.mean()
    v1 = (d @ d) / (n - 1)
    s = np.convolve(x, np.ones(q), "valid") - q * x.mean()
    m = q * (n - q + 1) * (1 - q / n)
    vr = (s @ s) / m / v1 if v1 > 0 else float("nan")
    d2 = d**2
    theta = sum((2 * (q - k) / q) ** 2 * (d2[k:] @ d2[:-k]) / d2.sum() ** 2 for k in range(1, q))
    return float(vr), float((vr - 1) / theta**0.5) if theta > 0 else float("nan")


def ols(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, residuals and residual sum of squares of y on the columns of a."""
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    e = y - a @ w
    return w, e, float(e @ e)


def adf_matrix(x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (level, constant, lagged differences) and differences from row `skip` on."""
    d = np.diff(x)
    return np.column_stack([x[skip:-1], np.ones(len(d) - skip), *[d[skip - j : len(d) - j] for j in range(1, lags + 1)]]), d[skip:]


#: MacKinnon's (1994) response surface of the test with a constant: bounds, and the polynomials below and above -1.61.
ADF_BOUNDS, ADF_LOW, ADF_HIGH = (-18.83, -1.61, 2.74), (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
#: Critical values of the KPSS level test and their probabilities.
KPSS_VALUES, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def adf(x: np.ndarray) -> tuple[float, float]:
    """t and p of an augmented Dickey-Fuller test with a constant; the number of lags has the least AIC on one sample."""
    n = len(x)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if most < 0 or np.ptp(x) == 0:
        return float("nan"), float("nan")

    def aic(k: int) -> float:
        a, y = adf_matrix(x, k, most)
        rss = ols(a, y)[2]
        return len(y) * np.log(max(rss, 1e-300) / len(y)) + 2 * a.shape[1]

    k = min(range(most + 1), key=aic)
    a, y = adf_matrix(x, k, k)
    w, _, rss = ols(a, y)
    t = float(w[0] / np.sqrt(rss / (len(y) - a.shape[1]) * np.linalg.pinv(a.T @ a)[0, 0]))
    low, mid, high = ADF_BOUNDS
    if not low < t < high:
        return t, 0.0 if t <= low else 1.0
    return t, tails.norm_cdf(sum(c * t**i for i, c in enumerate(ADF_LOW if t <= mid else ADF_HIGH)))


def kpss(x: np.ndarray) -> tuple[float, float]:
    """KPSS level statistic with a Bartlett window of the width of Hobijn and others (1998); p between the critical values."""
    n = len(x)
    e = x - x.mean()
    if n < 3 or not e.any():
        return float("nan"), float("nan")
    cov = lambda i: float(e[i:] @ e[: n - i])
    s0, s1 = cov(0) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        s0 += 2 * cov(i) / n
        s1 += 2 * i * cov(i) / n
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    s2 = (cov(0) + 2 * sum((1 - k / (lags + 1)) * cov(k) for k in range(1, lags + 1))) / n
    eta = float((np.cumsum(e) ** 2).sum() / n**2 / s2)
    return eta, float(np.interp(eta, KPSS_VALUES, KPSS_P))


def verdict(adf_p: float, kpss_p: float, alpha: float = 0.05) -> str:
    """The joint reading of the two tests: ADF's null is a unit root, KPSS's is stationarity."""
    if not (np.isfinite(adf_p) and np.isfinite(kpss_p)):
        return "inconclusive"
    return {(True, False): "stationary", (True, True): "trend_stationary", (False, True): "unit_root"}.get((adf_p < alpha, kpss_p < alpha), "inconclusive")


def stationarity(x: np.ndarray) -> dict:
    if len(x) and np.ptp(x) == 0:
        return {"adf": 0.0, "adf_p": 1.0, "kpss": 0.0, "kpss_p": 1.0, "verdict": "inconclusive"}
    (a, ap), (k, kp) = adf(x), kpss(x)
    return {"adf": a, "adf_p": ap, "kpss": k, "kpss_p": kp, "verdict": verdict(ap, kp)}


def minimise(f, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Nelder-Mead."""
    n = len(start)
    pts = [np.asarray(start, float)] + [np.asarray(start, float) + (0.1 * max(1.0, abs(start[i]))) * np.eye(n)[i] for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if val[-1] - val[0] < 1e-9:
            break
        mid = np.mean(pts[:-1], axis=0)
        far = mid + (mid - pts[-1])
        v = f(far)
        if v < val[0]:
            further = mid + 2 * (mid - pts[-1])
            w = f(further)
            pts[-1], val[-1] = (further, w) if w < v else (far, v)
        elif v < val[-2]:
            pts[-1], val[-1] = far, v
        else:
            near = mid + 0.5 * ((far if v < val[-1] else pts[-1]) - mid)
            w = f(near)
            if w < min(v, val[-1]):
                pts[-1], val[-1] = near, w
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def log_density(z: np.ndarray, shape: tuple[float, ...]) -> np.ndarray:
    """ln density at z of a law of variance 1: normal (), Student's t (nu), or Hansen's skewed t (nu, skew)."""
    from math import lgamma, pi

    if not shape:
        return -0.5 * (np.log(2 * pi) + z**2)
    nu = shape[0]
    c = lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(pi * (nu - 2))
    if len(shape) == 1:
        return c - (nu + 1) / 2 * np.log1p(z**2 / (nu - 2))
    k = shape[1]
    a = 4 * k * np.exp(c) * (nu - 2) / (nu - 1)
    b = np.sqrt(1 + 3 * k * k - a * a)
    side = np.where(z < -a / b, 1 - k, 1 + k)
    return np.log(b) + c - (nu + 1) / 2 * np.log1p(((b * z + a) / side) ** 2 / (nu - 2))


def variances(r: np.ndarray, w: float, a: float, g: float, b: float, start: float) -> np.ndarray:
    """h[t] = w + (a + g [r < 0]) r^2 + b h, of the row before."""
    news = w + (a + g * (r < 0)) * r * r
    out, h = np.empty(len(r)), start
    for t, x in enumerate(news.tolist()):
        out[t] = h
        h = x + b * h
    return out


LAWS = ("normal", "t", "skewt")


def garch_fit(x: np.ndarray, asymmetric: bool = False, law: str = "normal") -> dict[str, float]:
    """GARCH(1,1), or GJR(1,1,1), with zero mean by maximum likelihood on returns x 100; omega in the units of x."""
    r = np.asarray(x, float) * 100
    v0 = float(r.var()) or 1.0
    extra = LAWS.index(law)

    def unpack(p):
        share = 1 / (1 + np.exp(-p[1]))
        a = share / (1 + np.exp(-p[2]))
        g = 2 * (share - a) / (1 + np.exp(-p[3])) if asymmetric else 0.0
        q = p[4 if asymmetric else 3 :]
        shape = (2.05 + np.exp(min(q[0], 5.0)), *([np.tanh(q[1]) * 0.99] if extra == 2 else [])) if extra else ()
        return np.exp(p[0]), a, g, share - a - g / 2, shape

    def loss(p):
        w, a, g, b, shape = unpack(p)
        h = variances(r, w, a, g, b, v0)
        total = float((np.log(h) - 2 * log_density(r / np.sqrt(h), shape)).sum())
        return total if np.isfinite(total) else 1e300

    start = [np.log(v0 * 0.05), 3.0, -2.0, *([-2.0] if asymmetric else []), *([1.5, 0.0][:extra])]
    best = minimise(loss, np.array(start), 200)
    w, a, g, b, shape = unpack(best)
    nu, skew = (*shape, float("nan"), float("nan"))[:2]
    least = loss(best)
    return {"omega": float(w / 1e4), "alpha": float(a), "gamma": float(g), "beta": float(b), "nu": float(nu), "skew": float(skew), "aic": least + 2 * (len(start)), "bic": least + len(start) * log(max(len(r), 1))}


def garch_best(x: np.ndarray) -> tuple[str, dict[str, float]]:
    """The law of least AIC and its fit."""
    return min(((law, garch_fit(x, law=law)) for law in LAWS), key=lambda f: f[1]["aic"])


def std_residuals(x: np.ndarray, fit: dict[str, float]) -> np.ndarray:
    return x / np.sqrt(variances(x, fit["omega"], fit["alpha"], fit["gamma"], fit["beta"], float(x.var()) or 1.0))


def sign_bias(z: np.ndarray) -> dict[str, float]:
    """Engle and Ng: z^2 on 1, S, S z, (1 - S) z of the row before, S = [z < 0]; t, two-sided p, and the joint F."""
    y, before = z[1:] ** 2, z[:-1]
    s = (before < 0).astype(float)
    a = np.column_stack([np.ones(len(y)), s, s * before, (1 - s) * before])
    w, _, rss = ols(a, y)
    dof = max(len(y) - 4, 1)
    t = w / np.maximum(np.sqrt(np.diag(rss / dof * np.linalg.pinv(a.T @ a))), 1e-15)
    f = ((((y - y.mean()) ** 2).sum() - rss) / 3) / (rss / dof)
    out = {}
    for i, name in enumerate(("sign", "negative", "positive"), 1):
        out |= {f"{name}_t": float(t[i]), f"{name}_p": 2 * tails.t_sf(abs(float(t[i])), dof)}
    return out | {"joint_f": float(f), "joint_p": tails.f_sf(float(f), 3, dof)}


def arch_lm(e: np.ndarray, lags: int = 10) -> tuple[float, float]:
    """n R^2 of e^2 on its own lags, and its chi-square p."""
    q = e**2
    y = q[lags:]
    if len(y) <= lags + 1 or not y.var():
        return float("nan"), float("nan")
    a = np.column_stack([np.ones(len(y)), *[q[lags - j : len(q) - j] for j in range(1, lags + 1)]])
    lm = len(y) * (1 - ols(a, y)[2] / float(((y - y.mean()) ** 2).sum()))
    return float(lm), tails.chi2_sf(max(lm, 0.0), lags)


def student_fit(x: np.ndarray) -> dict[str, float]:
    """Student t by maximum likelihood: nu, loc, scale, AIC, BIC; and the normal's."""
    from math import lgamma, pi

    n, s = len(x), float(x.std()) or 1.0

    def loss(p):
        nu, sc = 2.01 + np.exp(p[0]), np.exp(p[2])
        z = ((x - p[1]) / sc) ** 2
        return -(n * (lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(nu * pi) - np.log(sc)) - (nu + 1) / 2 * np.log1p(z / nu).sum())

    p = minimise(loss, np.array([1.0, float(np.median(x)), np.log(s)]))
    return {"nu": float(2.01 + np.exp(p[0])), "loc": float(p[1]), "scale": float(np.exp(p[2])), "aic_t": float(2 * loss(p) + 6), "aic_normal": float(n * (np.log(2 * pi * s * s) + 1) + 4), "bic_t": float(2 * loss(p) + 3 * np.log(max(n, 1))), "bic_normal": float(n * (np.log(2 * pi * s * s) + 1) + 2 * np.log(max(n, 1)))}


def ks_normal(x: np.ndarray) -> tuple[float, float]:
    """Distance of the sample from the normal of its mean and deviation, and Kolmogorov's limiting p."""
    n = len(x)
    if n < 2 or x.std() == 0:
        return float("nan"), float("nan")
    cdf = np.array([tails.norm_cdf(v) for v in (np.sort(x) - x.mean()) / x.std()])
    d = float(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()))
    t = n**0.5 * d
    return d, 1.0 if t < 0.2 else float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * t * t) for k in range(1, 101)))))


def ks_test(df: DataFrame, c: str = "ret", by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """(by, ks, p) of ks_normal(), from ranks in a window and the normal distribution as a column."""
    x = df.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))).select(*by, F.col(c).alias("__x"))
    whole = Window.partitionBy(*by)
    z = F.try_divide(F.col("__x") - F.avg("__x").over(whole), F.stddev_pop("__x").over(whole))
    x = x.select(*by, z.alias("__z"), F.row_number().over(whole.orderBy("__x")).alias("__i"), F.count(F.lit(1)).over(whole).alias("__n"))
    cdf = norm_cdf(F.col("__z"))
    x = x.select(*by, "__n", once(cdf, lambda f: F.greatest(F.col("__i") / F.col("__n") - f, f - (F.col("__i") - 1) / F.col("__n"))).alias("__d"))
    s = x.groupBy(*by).agg(F.max("__d").alias("ks"), F.first("__n").alias("__n"))
    t = F.sqrt("__n") * F.col("ks")
    term = lambda k, t: F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * t * t)
    tail = once(t, lambda t: F.when(t < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + term(k.cast("double"), t))))))
    return s.select(*by, "ks", F.when(F.col("ks").isNotNull(), tail).alias("p"))


def bds(x: np.ndarray, most: int = 5, distance: float = 1.5, block: int = 256) -> list[tuple[int, float, float]]:
    """(dimension, statistic, two-sided p) of the BDS test for dimensions 2 to `most`; near: within `distance` deviations.

    Pairs are counted in blocks of rows, so memory grows with the length of the series only.
    """
    n = len(x)
    if n < 20 or x.std() == 0:
        return []
    eps = distance * x.std(ddof=1)
    degree = np.zeros(n)
    joint, single = np.zeros(most), np.zeros(most)  # pairs i < j near in m dimensions; those with both at m - 1 or later
    for at in range(0, n, block):
        end = min(at + block, n)
        rows = abs(x[at : min(end + most - 1, n), None] - x[None, :]) < eps
        degree[at:end] = rows[: end - at].sum(1)
        later = np.arange(n)[None, :] > np.arange(at, end)[:, None]
        for m in range(1, most + 1):
            k = min(end, n - m + 1) - at
            if k <= 0:
                continue
            both = later[:k, : n - m + 1].copy()
            for j in range(m):
                both &= rows[j : j + k, j : n - m + 1 + j]
            joint[m - 1] += both.sum()
            skip = max(0, m - 1 - at)
            single[m - 1] += (rows[: end - at] & later)[skip:, m - 1 :].sum()
    pairs = lambda k: k * (k - 1) / 2
    c = joint[0] / pairs(n)
    k = ((degree**2).sum() - 3 * degree.sum() + 2 * n) / (n * (n - 1) * (n - 2))
    out = []
    for m in range(2, most + 1):
        nm = n - m + 1
        var = 4 * (k**m + 2 * sum(k ** (m - j) * c ** (2 * j) for j in range(1, m)) + (m - 1) ** 2 * c ** (2 * m) - m * m * k * c ** (2 * m - 2))
        stat = nm**0.5 * (joint[m - 1] / pairs(nm) - (single[m - 1] / pairs(nm)) ** m) / var**0.5 if var > 0 else float("nan")
        out.append((m, float(stat), float(2 * (1 - tails.norm_cdf(abs(stat))))))
    return out


HORIZONS = (1.0, 3.0, 7.0, 14.0)


def variance_ratios(x: np.ndarray, per_day: float, horizons=HORIZONS, short: bool = False) -> tuple[list[tuple[float, int, float, float, float]], float, float]:
    """(days, q, ratio, z, p) at each horizon, q = max(2, round(days * per_day)) once each; Chow and Denning's max |z| and
    its p by Sidak. short: horizons of a week at most."""
    out, seen = [], set()
    for h in horizons:
        q = max(2, round(h * per_day))
        if q in seen or (short and h > 7):
            continue
        seen.add(q)
        # the first return is the first level of the cumulated series
        vr, z = variance_ratio(x[1:], q)
        if np.isfinite(z):
            out.append((h, q, vr, z, 2 * (1 - tails.norm_cdf(abs(z)))))
    if not out:
        return [], float("nan"), float("nan")
    top = max(abs(r[3]) for r in out)
    return out, top, 1 - (1 - 2 * (1 - tails.norm_cdf(top))) ** len(out)


def ridge_adj_r2(x: np.ndarray, y: np.ndarray, z: np.ndarray, t: np.ndarray, alpha: float = 1.0) -> float:
    """Adjusted R2 on (z, t) of a ridge fitted to (x, y), within [-1, 1]; 0 if t does not vary."""
    m = x.mean(0)
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))
    total = float(((t - t.mean()) ** 2).sum())
    if total == 0:
        return 0.0
    r2 = 1 - float(((t - y.mean() - (z - m) @ w) ** 2).sum()) / total
    left = len(t) - x.shape[1] - 1
    return r2 if left <= 0 else float(min(1.0, max(-1.0, 1 - (1 - r2) * (len(t) - 1) / left)))


def snr_r2(x: np.ndarray, y: np.ndarray, holdout: float = 0.3, alpha: float = 1.0, baselines: int = 10, seed: int = 42) -> tuple[float, float]:
    """Adjusted R2 of a ridge on the last `holdout` of the rows, and the mean one of as many columns of noise."""
    n, cut = len(y), int(len(y) * (1 - holdout))
    if cut < 10 or n - cut < 10 or x.shape[1] < 1:
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    noise = [ridge_adj_r2(rng.normal(size=(cut, x.shape[1])), y[:cut], rng.normal(size=(n - cut, x.shape[1])), y[cut:], alpha) for _ in range(baselines)]
    return ridge_adj_r2(x[:cut], y[:cut], x[cut:], y[cut:], alpha), float(np.mean(noise))


def qq(df: DataFrame, c: str = "ret", by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """(by, p, theoretical, ordered): normal quantile data at Filliben's medians of the order statistics, standard units."""
    x = df.filter(F.col(c).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*by)).cast("double")
    i = F.row_number().over(Window.partitionBy(*by).orderBy(c)).cast("double")
    last = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    return x.select(*by, p.alias("p"), probit(p).alias("theoretical"), F.col(c).alias("ordered"))


def probit(p: Column) -> Column:
    """The normal quantile as a column: Acklam's rational approximation, within 1.2e-9 relative."""
    #: The coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def horner(coefficients, x):
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + F.lit(k)
        return out

    q = p - 0.5
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    mid = horner(a, q * q) * q / horner(b, q * q)
    return F.when(p < 0.02425, horner(c, low) / horner(d, low)).when(p > 1 - 0.02425, -horner(c, high) / horner(d, high)).otherwise(mid)


def qq_student(df: DataFrame, fits: DataFrame, c: str = "ret", by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """(by, p, theoretical, ordered): quantile data of the t with fits(by, nu, loc, scale) at Blom's positions (i - 0.375) / (n + 0.25)."""
    x = df.filter(F.col(c).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    p = (F.row_number().over(Window.partitionBy(*by).orderBy(c)) - 0.375) / (n + 0.25)
    x = x.select(*by, p.alias("p"), F.col(c).alias("ordered")).join(fits.select(*by, "nu", "loc", "scale"), list(by))
    return x.select(*by, "p", (F.col("loc") + F.col("scale") * t_ppf(F.col("p"), F.col("nu"))).alias("theoretical"), "ordered")


def bars_per_day(df: DataFrame) -> DataFrame:
    days = (F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / 86400e6
    return df.groupBy("asset").agg(F.greatest(F.lit(1.0), F.try_divide(F.count(F.lit(1)).cast("double"), days)).alias("bars_per_day"))


#: What is done to a feature without a stationary level, by the start of its name.
SUGGESTED = {
    "atr_": "pct_atr", "amihud_": "rolling_zscore", "hurst_": "first_difference", "bbwidth_": "first_difference", "gk_vol_": "rolling_zscore",
    "park_vol_": "first_difference", "rv_": "first_difference",
}


def suggested(feature: Column) -> Column:
    """The transform of a feature's family, null if none is known."""
    out = F.lit(None).cast("string")
    for start, name in reversed(SUGGESTED.items()):
        out = F.when(F.startswith(feature, F.lit(start)), name).otherwise(out)
    return out


def transforms(df: DataFrame, c: str, atr: str, n: int = 24) -> DataFrame:
    """The stationarity transforms: by close (zero close: null), rolling z-score without eps, first difference."""
    from ..functions.windows import zscore

    return df.withColumns({"pct_atr": F.try_divide(atr, "close"), "rolling_zscore": zscore(c, n, 0.0), "first_difference": F.col(c) - lag(c)})


