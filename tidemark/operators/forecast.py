"""Forecast evaluation and small forecasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tail_columns import norm_cdf
from ..functions.windows import lag, ordered

D = "double"


def _flag(c: Column) -> Column:
    return c.cast("int").cast(D)


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and per-class precision, recall, F1 of y and pred in {1, -1}; 0 where undefined."""
    cell = lambda y, p: F.sum(((F.col("y") == y) & (F.col("pred") == p)).cast("long"))
    a = df.groupBy(*by).agg(cell(1, 1).alias("uu"), cell(1, -1).alias("ud"), cell(-1, 1).alias("du"), cell(-1, -1).alias("dd"))
    z = lambda e: F.coalesce(e, F.lit(0.0))
    prf = lambda tp, fp, fn: (z(F.try_divide(F.col(tp), F.col(tp) + F.col(fp))), z(F.try_divide(F.col(tp), F.col(tp) + F.col(fn))), z(F.try_divide(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))))
    pu, ru, fu = prf("uu", "du", "ud")
    pd, rd, fd = prf("dd", "ud", "du")
    total = F.col("uu") + F.col("ud") + F.col("du") + F.col("dd")
    return a.select(*by, total.alias("n"), F.try_divide(F.col("uu") + F.col("dd"), total).alias("accuracy"), pu.alias("precision_up"), ru.alias("recall_up"), fu.alias("f1_up"), pd.alias("precision_down"), rd.alias("recall_down"), fd.alias("f1_down"), (F.col("uu") + F.col("ud")).alias("n_up"), (F.col("du") + F.col("dd")).alias("n_down"))


def asymmetric(c: DataFrame, crash: float = 1.5, rally: float = 1.0) -> DataFrame:
    """Support-weighted precision, recall, F1 of confusion(), falls weighing `crash`."""
    w = rally * F.col("n_up") + crash * F.col("n_down")
    mix = lambda m: F.coalesce(F.try_divide(rally * F.col(f"{m}_up") * F.col("n_up") + crash * F.col(f"{m}_down") * F.col("n_down"), w), F.lit(0.0))
    return c.withColumns({f"weighted_{m}": mix(m) for m in ("precision", "recall", "f1")})


def auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Area under the ROC curve from rank sums; equal scores share their mean rank."""
    counts = df.groupBy(*by, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    r = counts.withColumn("__r", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2.0)
    a = r.groupBy(*by).agg(F.sum(F.col("p") * F.col("__r")).alias("s"), F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nn"))
    return a.select(*by, F.try_divide(F.col("s") - F.col("np") * (F.col("np") + 1) / 2.0, F.col("np") * F.col("nn")).alias("auc"))


def abstention(df: DataFrame, by: list[str], cuts=(0.5, 0.55, 0.6, 0.65, 0.7)) -> DataFrame:
    """Coverage and accuracy of the rows whose confidence reaches each cut; one pass, the cuts are columns."""
    x = df.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts])))
    hit = F.col("confidence") >= F.col("cut")
    return x.groupBy(*by, "cut").agg(F.avg(_flag(hit)).alias("coverage"), F.avg(F.when(hit, _flag(F.col("y") == F.col("pred")))).alias("accuracy"))


def calibration_error(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(.., ece): mean gap of confidence and accuracy over equal bins of [0, 1], weighted by rows."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    x = df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(_flag(F.col("y") == F.col("pred"))).alias("a"))
    return x.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def economic_accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    w = F.abs("ret")
    return df.groupBy(*by).agg(F.try_divide(F.sum(w * _flag(F.col("y") == F.col("pred"))), F.sum(w)).alias("economic_accuracy"))


def regression(df: DataFrame, by: list[str], a: str = "actual", p: str = "pred") -> DataFrame:
    """MAE, RMSE, R2 and the share of equal signs."""
    e = F.col(a) - F.col(p)
    x = df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"), (F.var_pop(a) * F.count(a)).alias("__sst"), F.avg(_flag(F.signum(a) == F.signum(p))).alias("directional"))
    return x.withColumn("r2", 1 - F.try_divide("__sse", "__sst")).drop("__sse", "__sst")


def direction_correct(df: DataFrame, by: list[str], a: str = "actual", p: str = "pred") -> DataFrame:
    """MAE and RMSE over the rows whose signs agree; null if there are none."""
    ok = F.signum(a) == F.signum(p)
    e = F.when(ok, F.col(a) - F.col(p))
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("dc_mae"), F.sqrt(F.avg(e * e)).alias("dc_rmse"))


def profitable(df: DataFrame, by: list[str], a: str = "actual", p: str = "pred", big: float = 0.01, real: float = 0.005) -> DataFrame:
    """(.., pdr): of right-signed forecasts beyond `big` the share whose outcome is beyond `real`; 0 if there are none."""
    ok = (F.signum(a) == F.signum(p)) & (F.abs(p) > big)
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(ok, _flag(F.abs(a) > real))), F.lit(0.0)).alias("pdr"))


def volatility(df: DataFrame, by: list[str], a: str = "actual", p: str = "pred") -> DataFrame:
    """QLIKE on variances, Mincer-Zarnowitz slope, intercept and R2, MAE of logs; both columns positive."""
    q = F.pow(F.col(a) / F.col(p), F.lit(2.0))
    x = df.filter((F.col(a) > 0) & (F.col(p) > 0))
    return x.groupBy(*by).agg(F.avg(q - F.log(q) - 1.0).alias("qlike"), F.regr_slope(a, p).alias("mz_slope"), F.regr_intercept(a, p).alias("mz_intercept"), F.regr_r2(a, p).alias("mz_r2"), F.avg(F.abs(F.log(a) - F.log(p))).alias("log_mae"))


def economic_sharpe(df: DataFrame, cost: float = 0.001) -> DataFrame:
    """Per asset: mean over sample deviation of sign(pred) x actual less cost x |change of position|, first from 0."""
    pos = F.signum("pred")
    x = df.withColumn("__pos", pos).withColumn("__net", F.col("__pos") * F.col("actual") - cost * F.abs(F.col("__pos") - F.lag("__pos", 1, 0.0).over(ordered())))
    return x.groupBy("asset").agg(F.try_divide(F.avg("__net"), F.stddev_samp("__net")).alias("economic_sharpe"))


def regime_coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows inside [lower, upper], above and at or below the median of vol."""
    m = df.groupBy(*by).agg(F.percentile("vol", F.lit(0.5)).alias("__m"))
    inside = _flag((F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper")))
    x = df.join(m, by)
    return x.groupBy(*by).agg(F.avg(F.when(F.col("vol") > F.col("__m"), inside)).alias("high"), F.avg(F.when(F.col("vol") <= F.col("__m"), inside)).alias("low"))


def quantile_reliability(df: DataFrame, by: list[str], columns: dict[float, str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(c).alias("x")) for q, c in columns.items()]))
    x = df.select(*by, "actual", rows.alias("z"))
    return x.groupBy(*by, F.col("z.quantile").alias("quantile")).agg(F.avg(_flag(F.col("actual") <= F.col("z.x"))).alias("observed"))


def adaptive_conformal(scores: DataFrame, df: DataFrame, target: float = 0.1, gamma: float = 0.01, low: float = 0.001, high: float = 0.5) -> DataFrame:
    """(asset, timestamp, alpha, lower, upper, covered): adaptive intervals around df(asset, timestamp, pred, actual).

    The width is the (1 - alpha) quantile of the calibrated scores(asset, residual), absolute and sorted once. alpha starts at
    `target`; a row outside its interval moves it by gamma (1 - target), one inside by -gamma target, within [low, high].
    A fold over an asset's rows that looks up one quantile a row.
    """
    kind = df.schema["timestamp"].dataType.simpleString()
    sorted_scores = scores.filter(F.col("residual").isNotNull()).groupBy("asset").agg(F.sort_array(F.collect_list(F.abs("residual"))).alias("__scores"))

    def one(key: tuple, rows: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        names = ["asset", "timestamp", "alpha", "lower", "upper", "covered"]
        if not len(rows) or not len(s):
            return pd.DataFrame(columns=names)
        v = np.asarray(s["__scores"].iloc[0], float)
        rows = rows.sort_values("timestamp", kind="stable")
        alpha, out = target, []
        for t, p, y in zip(rows["timestamp"], rows["pred"], rows["actual"]):
            at = (1 - alpha) * (len(v) - 1)
            i = int(at)
            width = v[i] + (at - i) * (v[min(i + 1, len(v) - 1)] - v[i])
            inside = p - width <= y <= p + width
            out.append((key[0], t, alpha, p - width, p + width, inside))
            alpha = min(high, max(low, alpha + gamma * ((not inside) - target)))
        return pd.DataFrame(out, columns=names)

    got = df.groupBy("asset").cogroup(sorted_scores.groupBy("asset"))
    return got.applyInPandas(one, f"asset string, timestamp {kind}, alpha double, lower double, upper double, covered boolean")


def ridge_single(df: DataFrame, by: list[str], x: str = "x", y: str = "y", alpha: float = 1.0) -> DataFrame:
    """One-feature ridge with a free intercept from sums: slope = Sxy / (Sxx + alpha)."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    s = F.try_divide(F.covar_pop(x, y) * n, F.regr_sxx(y, x) + alpha)
    return df.groupBy(*by).agg(s.alias("slope"), (F.regr_avgy(y, x) - s * F.regr_avgx(y, x)).alias("intercept"))


def har_features(df: DataFrame, rv: str = "rv") -> DataFrame:
    """Means of the last 1, 5 and 22 values before the row."""
    mean = lambda n: F.when(F.count(rv).over(ordered().rowsBetween(-n, -1)) >= n, F.avg(rv).over(ordered().rowsBetween(-n, -1)))
    return df.withColumns({"har_1": lag(rv), "har_5": mean(5), "har_22": mean(22)})


def crps_gaussian(df: DataFrame, a: str, mu: str, sigma: str, name: str = "crps") -> DataFrame:
    """df with the CRPS of a normal forecast; the absolute error where sigma is below 1e-12."""
    z = F.try_divide(F.col(a) - F.col(mu), F.col(sigma))
    pdf = F.exp(-z * z / 2) / F.lit((2 * np.pi) ** 0.5)
    crps = F.col(sigma) * (z * (2 * norm_cdf(z) - 1) + 2 * pdf - F.lit(1 / np.pi**0.5))
    return df.withColumn(name, F.when(F.col(sigma) < 1e-12, F.abs(F.col(a) - F.col(mu))).otherwise(crps))


def breusch_pagan(df: DataFrame, by: list[str], residual: str, pred: str) -> DataFrame:
    """(by, mean, std, bp, bp_p, homoscedastic): n R^2 of the squared residuals on the predictions, chi-square with one degree."""
    e2 = F.pow(F.col(residual), F.lit(2.0))
    a = df.withColumn("__e2", e2).groupBy(*by).agg(F.avg(residual).alias("mean"), F.stddev_samp(residual).alias("std"), (F.count(F.lit(1)) * F.coalesce(F.regr_r2("__e2", pred), F.lit(0.0))).alias("bp"))
    p = 2 * (1 - norm_cdf(F.sqrt(F.greatest(F.col("bp"), F.lit(0.0)))))
    return a.withColumn("bp_p", p).withColumn("homoscedastic", F.col("bp_p") >= 0.05)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's (1995) approximation, for 4 values or more."""
    from ..functions.tails import norm_ppf

    n = len(x)
    if n < 4 or np.ptp(x) == 0:
        return 1.0, 1.0
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / n**0.5, float(m @ m)
    # fixed values: Royston's polynomials
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / mm**0.5], u)
    a = np.empty(n)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / mm**0.5], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[:] = m / phi**0.5
        a[[1, -2]] = -second, second
    else:
        a[:] = m / ((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)) ** 0.5
    a[[0, -1]] = -last, last
    s = np.sort(x)
    w = min(1.0, float((a @ s) ** 2 / ((s - s.mean()) ** 2).sum()))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        y = -np.log(max(gamma - np.log1p(-w), 1e-300))
        mean, dev = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, k = np.log1p(-w), np.log(n)
        mean, dev = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), np.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    from ..functions.tails import norm_cdf as cdf

    return w, 1 - cdf(float((y - mean) / dev))


def residual_diagnostics(df: DataFrame, residual: str, pred: str, most: int = 5000) -> DataFrame:
    """breusch_pagan() by asset with shapiro, shapiro_p and normal. Shapiro and Wilk's test reads `most` residuals of an asset at
    most, picked by a hash, as it is not defined beyond."""
    picked = df.filter(F.col(residual).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy("asset").orderBy(F.xxhash64("timestamp", F.lit(42)), "timestamp")))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(g["v"].to_numpy(float))
        return pd.DataFrame([(key[0], w, p, p >= 0.05)], columns=["asset", "shapiro", "shapiro_p", "normal"])

    few = picked.filter(F.col("__n") <= most).select("asset", F.col(residual).cast("double").alias("v"))
    normal = few.groupBy("asset").applyInPandas(one, "asset string, shapiro double, shapiro_p double, normal boolean")
    return breusch_pagan(df, ["asset"], residual, pred).join(normal, "asset")


def shuffled_labels(train: DataFrame, test: DataFrame, names: list[str], fit, permutations: int = 5, seed: int = 42) -> DataFrame:
    """(permutation, da, mean_da, passed): a learner's directional accuracy when the training labels y are shuffled.

    fit(train, test, names) gives test with pred. The labels are dealt anew by joining the ranks of two random orders; a
    sound learner stays within [0.48, 0.52] on average.
    """
    spark = train.sparkSession
    rows = []
    for k in range(permutations):
        nth = lambda order: F.row_number().over(Window.partitionBy("asset").orderBy(order, "timestamp"))
        x = train.drop("y").withColumn("__n", nth(F.col("timestamp")))
        y = train.select("asset", "timestamp", "y").withColumn("__n", nth(F.xxhash64("timestamp", F.lit(seed + k)))).select("asset", "__n", "y")
        got = fit(x.join(y, ["asset", "__n"]).drop("__n"), test, names)
        rows.append((k, float(got.agg(F.avg(_flag(F.col("y") == F.col("pred")))).first()[0] or 0.5)))
    mean = sum(r[1] for r in rows) / len(rows)
    return spark.createDataFrame([(k, da, mean, 0.48 <= mean <= 0.52) for k, da in rows], "permutation int, da double, mean_da double, passed boolean")


def naive_regressors(df: DataFrame, c: str = "actual", span: float = 20.0) -> DataFrame:
    """(asset, random_walk, ewma, hist_mean): 0, the last exponentially weighted mean with weights summing to one, the mean."""
    decay = 1 - 2.0 / (span + 1)
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("timestamp"))) - 1
    x = df.filter(F.col(c).isNotNull()).withColumn("__w", F.pow(F.lit(decay), back.cast(D)))
    return x.groupBy("asset").agg(F.lit(0.0).alias("random_walk"), (F.sum(F.col("__w") * F.col(c)) / F.sum("__w")).alias("ewma"), F.avg(c).alias("hist_mean"))


def pnl_variants(df: DataFrame, cost: float = 0.001) -> DataFrame:
    """(asset, variant, mean, std, total) of df(asset, timestamp, clf, reg, actual): positions by the sign of clf alone, of reg alone, and
    of both where they agree; each pays cost x |change of position|, first from 0."""
    side = {"clf_only": F.signum("clf"), "reg_only": F.signum("reg"), "combined": F.when(F.signum("clf") == F.signum("reg"), F.signum("clf")).otherwise(0.0)}
    x = df.withColumns({f"__{k}": v for k, v in side.items()})
    net = {k: F.col(f"__{k}") * F.col("actual") - cost * F.abs(F.col(f"__{k}") - F.lag(f"__{k}", 1, 0.0).over(ordered())) for k in side}
    x = x.withColumns({f"__net_{k}": v for k, v in net.items()})
    x = x.select("asset", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(f"__net_{k}").alias("net")) for k in side])).alias("z"))
    return x.groupBy("asset", "z.variant").agg(F.avg("z.net").alias("mean"), F.stddev_samp("z.net").alias("std"), F.sum("z.net").alias("total"))


def bootstrap_accuracy(df: DataFrame, by: list[str], resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, da, low, high): percentile interval of the share of y = pred. A resample of n rows has a binomial number of hits, so
    only the counts are resampled: one small kernel per group, whatever n is."""
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == F.col("pred")).cast("long")).alias("k"))

    def one(batches):
        for g in batches:
            draw = [np.random.default_rng(seed).binomial(n, k / n, resamples) / n for n, k in zip(g["n"], g["k"])]
            ends = [np.quantile(d, [(1 - level) / 2, (1 + level) / 2]) for d in draw]
            yield g[by].assign(da=g["k"] / g["n"], low=[e[0] for e in ends], high=[e[1] for e in ends])

    return a.mapInPandas(one, ", ".join(f"{c} {a.schema[c].dataType.simpleString()}" for c in by) + ", da double, low double, high double")


def wdl(*_) -> None:
    """The specification leaves this measure undefined."""
    raise NotImplementedError("wdl is not defined")


def majority(df: DataFrame, by: list[str]) -> DataFrame:
    up = F.sum((F.col("y") == 1).cast("long"))
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(F.when(up * 2 >= n, 1).otherwise(-1).alias("pred"), (F.greatest(up, n - up) / n).alias("confidence"))


def persistence(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by("y", "timestamp").alias("pred"), F.lit(0.5).alias("confidence"))


def winsorized_predictions(df: DataFrame, c: str = "predicted", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with c clipped to its quantiles within the asset."""
    from .targets import winsorized

    return winsorized(df, [c], low, high)
