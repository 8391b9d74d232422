"""Meta-labelling: labels, recommender features, baseline recommenders and their metrics."""

from __future__ import annotations

from itertools import permutations
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import lag, lead, mean, ordered, rolling, std, trailing, whole


def labels(bars: DataFrame, signals: DataFrame, horizon: int = 7, bps: float = 10.0) -> DataFrame:
    """strategy_return of each long or short signal: the directed return to the horizon's bar less twice the cost.

    The horizon counts bars, so the later close is looked up before the join; signals without one get null.
    """
    b = bars.withColumn("__later", lead("close", horizon)).select("asset", "timestamp", "close", "__later")
    s = signals.filter(F.col("side").isin("long", "short")).select("asset", "timestamp", "side")
    r = F.try_divide("__later", "close") - 1
    net = F.when(F.col("side") == "long", r).otherwise(-r) - F.lit(2 * bps / 1e4)
    return b.join(s, ["asset", "timestamp"]).withColumns({"strategy_return": net, "horizon": F.lit(horizon)}).drop("__later", "close")


def classifier_features(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("clf_rolling_accuracy", mean(F.col("clf_correct").cast("double"), n, 1))


def vol_features(df: DataFrame, n: int = 20) -> DataFrame:
    ratio = F.when(F.col("vol_actual") > 0, F.col("vol_predicted") / F.col("vol_actual"))
    loss = F.when(ratio > 0, ratio - F.log(ratio) - 1.0)
    return df.withColumns({"vol_error_trend": mean(F.col("vol_predicted") - F.col("vol_actual"), n, 1), "vol_qlike_residual": mean(loss, n, 1)})


def combined_features(df: DataFrame) -> DataFrame:
    d, r = F.col("clf_direction"), F.col("reg_predicted_return")
    agree = F.when(((d > 0) & (r > 0)) | ((d < 0) & (r < 0)), 1).otherwise(0)
    return df.withColumns({"forecast_agreement": agree, "conviction_score": F.abs(r) * F.col("clf_confidence")})


def vol_regime(df: DataFrame, k: float = 1.0, column: str = "vol_predicted") -> DataFrame:
    """1 where the column is above mean + k deviations of the asset's whole slice."""
    cut = F.avg(column).over(whole()) + k * F.stddev_samp(column).over(whole())
    return df.withColumn("vol_regime", F.when(F.col(column) > cut, 1).otherwise(0))


def strategy_features(df: DataFrame, n: int = 20) -> DataFrame:
    m, s = mean("strategy_return", n, 2), std("strategy_return", n, 2)
    win = mean((F.col("strategy_return") > 0).cast("double"), n, 1)
    return df.withColumns({"rolling_strategy_sharpe": F.when(s > 0, F.try_divide(m, s)).otherwise(F.lit(0.0)), "rolling_win_rate": win})


def corr_beta(df: DataFrame, a: str = "asset_return", b: str = "btc_return", n: int = 20) -> DataFrame:
    """Rolling correlation and beta (population covariance by sample variance) of two return columns."""
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a))
    w = trailing(n)
    varied = (F.var_pop(F.when(both.isNotNull(), F.col(a))).over(w) > 1e-18) & (F.var_pop(F.when(both.isNotNull(), F.col(b))).over(w) > 1e-18)
    corr = F.when((F.count(both).over(w) >= 2) & varied, F.corr(a, b).over(w))
    var = rolling(F.var_samp(b), F.col(b), n, 2)
    cov = mean(F.col(a) * F.col(b), n, 2) - mean(a, n, 2) * mean(b, n, 2)
    beta = F.when(var > 0, F.try_divide(cov, var)).otherwise(F.lit(0.0))
    return df.withColumns({"rolling_cross_corr": corr, "btc_beta": beta})


def relative_strength(df: DataFrame) -> DataFrame:
    return df.withColumn("relative_strength", F.try_divide("close", lag("close")) - 1.0 - F.col("universe_mean_return"))


def pattern(column: str, m: int = 3) -> Column:
    """The ordinal pattern of the last m values, oldest first, as text of their ranks; ties by position; null if too few."""
    v = [F.lag(column, m - 1 - k).over(ordered()) for k in range(m)]
    rank = lambda i: sum((((v[j] < v[i]) | ((v[j] == v[i]) & F.lit(j < i))).cast("int") for j in range(m) if j != i), F.lit(0))
    text = F.concat(*[rank(i).cast("string") for i in range(m)])
    return F.when(F.count(column).over(ordered().rowsBetween(-(m - 1), 0)) >= m, text)


def rolling_entropy(df: DataFrame, n: int = 20, m: int = 3, column: str = "ret") -> DataFrame:
    """Normalised permutation entropy of the last n values: counts of the m! patterns over a window of n - m + 1 rows."""
    d = df.withColumn("__pattern", pattern(column, m))
    w = ordered().rowsBetween(-(n - m), 0)
    total = F.count("__pattern").over(w).cast("double")
    h = F.lit(0.0)
    for p in permutations(range(m)):
        share = F.sum(F.when(F.col("__pattern") == "".join(map(str, p)), 1).otherwise(0)).over(w) / F.nullif(total, F.lit(0.0))
        h = h - F.when(share > 0, share * F.log(share)).otherwise(0.0)
    scale = log(len(list(permutations(range(m)))))
    full = F.count(column).over(trailing(n)) >= n
    return d.withColumn("rolling_perm_entropy", F.when(full, h / scale)).drop("__pattern")


def features(market: DataFrame, **parts: DataFrame) -> DataFrame:
    """market with the columns of each part, left-joined on (asset, timestamp)."""
    out = market
    for part in parts.values():
        out = out.join(part, ["asset", "timestamp"], "left")
    return out


def aligned(features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on (asset, timestamp); expected columns that are missing or null become 0.0; unlabelled rows go."""
    x = features.select("asset", "timestamp", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in features.columns else F.lit(0.0).alias(c) for c in names])
    return x.join(labels.filter(F.col("strategy_return").isNotNull()), ["asset", "timestamp"])


def deploy(df: DataFrame, kind: str, threshold: float = 0.0, cap: float = 1.0, pred: str = "pred", sigma: str = "sigma") -> DataFrame:
    """deploy and size of the baseline recommenders over a batch; sigma: deviation of the training returns."""
    p, s = F.col(pred), F.col(sigma)
    if kind == "all_assets":
        go, size = F.lit(True), F.lit(1.0)
    elif kind == "classifier_only":
        go, size = F.abs(p) > threshold, F.least(F.coalesce(F.try_divide(F.abs(p), s), F.lit(0.0)), F.lit(cap))
    elif kind == "regressor_only":
        go, size = p > threshold, F.least(F.greatest(F.coalesce(F.try_divide(p - threshold, s), F.lit(0.0)), F.lit(0.0)), F.lit(cap))
    elif kind == "equal_weight":
        go, size = p > threshold, F.coalesce(F.try_divide(F.lit(1.0), F.sum((p > threshold).cast("double")).over(whole())), F.lit(0.0))
    else:
        raise ValueError(kind)
    return df.withColumns({"deploy": go, "size": F.when(go, size).otherwise(0.0)})


def recommendation_metrics(df: DataFrame, actual: str = "actual") -> DataFrame:
    """Per asset: deploy rate, precision of deployed rows (null if none), their mean and the compounded sized return."""
    r = F.col(actual)
    got = F.col("size") * r
    return df.groupBy("asset").agg(
        F.avg(F.col("deploy").cast("double")).alias("deploy_rate"),
        F.avg(F.when(F.col("deploy"), (r > 0).cast("double"))).alias("deploy_precision"),
        F.avg(F.when(F.col("deploy"), r)).alias("mean_deployed"),
        F.sum(F.when(got.isNotNull(), F.log1p(F.greatest(got, F.lit(-0.999999))))).alias("log_growth"),
    ).withColumn("cumulative", F.exp("log_growth") - 1)


def recommendation_sharpe(df: DataFrame, actual: str = "actual", per_year: float = 8766.0, lags: int = 6) -> DataFrame:
    """(asset, sharpe_sized, sharpe_binary, lo_sized, lo_binary, sizing_value): annualised Sharpe ratios of the sized and of the plain
    deployments, 0 where nothing is deployed; the Lo factor of the sized returns corrects both. Null below two rows or
    without a deviation."""
    from .metrics import lo_factor

    r = F.when(F.col("deploy"), F.col(actual)).otherwise(0.0)
    x = df.filter(F.col(actual).isNotNull()).select("asset", "timestamp", (F.when(F.col("deploy"), F.col("size")).otherwise(0.0) * r).alias("ret"), r.alias("__binary"))
    ratio = lambda c: F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * F.lit(per_year**0.5))
    s = x.groupBy("asset").agg(ratio("ret").alias("sharpe_sized"), ratio("__binary").alias("sharpe_binary")).join(lo_factor(x, "ret", lags), "asset", "left")
    s = s.withColumns({"lo_sized": F.col("sharpe_sized") * F.col("eta"), "lo_binary": F.col("sharpe_binary") * F.col("eta")}).drop("eta")
    return s.withColumn("sizing_value", F.col("lo_sized") - F.col("lo_binary"))


def conformal_quantile(df: DataFrame, residual: Column, alpha: float = 0.1) -> DataFrame:
    """(asset, q): the split-conformal quantile of the absolute residuals at min(1, (1 - alpha)(1 + 1/n))."""
    a = df.select("asset", F.abs(residual).alias("__r")).filter("__r IS NOT NULL")
    counts = a.groupBy("asset").agg(F.count(F.lit(1)).alias("__n"))
    # values are counted and merged; the two that the level falls between are found by their running counts
    by_value = a.groupBy("asset", "__r").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy("asset").orderBy("__r"))
    x = by_value.withColumn("__upto", upto).join(counts, "asset")
    at = F.least(F.lit(1.0), F.lit(1 - alpha) * (1 + 1.0 / F.col("__n"))) * (F.col("__n") - 1)
    low = F.floor(at)
    x = x.withColumns({"__at": at, "__low": low, "__high": F.least(low + 1, F.col("__n") - 1)})
    value = lambda place: F.min(F.when(F.col("__upto") > F.col(place), F.col("__r")))
    s = x.groupBy("asset").agg(value("__low").alias("a"), value("__high").alias("b"), F.first(F.col("__at") - F.col("__low")).alias("part"))
    return s.select("asset", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("q"))


def regressor_features(df: DataFrame) -> DataFrame:
    """The key and those of the regressor's columns that are there."""
    return df.select("asset", "timestamp", *[c for c in ("reg_predicted_return", "reg_prediction_std", "reg_quantile_spread", "reg_ci_width") if c in df.columns])


# -- the walk-forward run ------------------------------------------------------------------------------------------------

_MARK = "\x01"


def slices(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """df's rows by position in each window's training and test part; the part is in the asset's name, so that every window
    function starts anew in it."""
    rows = df.withColumn("__pos", F.row_number().over(ordered()) - 1)
    both = rows.join(bounds, "asset").filter((F.col("__pos") >= F.col("low")) & (F.col("__pos") < F.col("high")))
    return both.withColumn("asset", F.concat_ws(_MARK, "asset", F.col("window").cast("string"), "part")).drop("__pos", "low", "high", "window", "part")


def window_bounds(bars: DataFrame, **kw) -> DataFrame:
    """(asset, window, part, low, high) of window_splits(); two rows for each asset and window, from one count per asset."""
    from .cv import window_splits

    w = window_splits(bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n")), **kw)
    part = lambda name, low, high: F.struct(F.lit(name).alias("part"), F.col(low).alias("low"), F.col(high).alias("high"))
    return w.select("asset", "window", F.explode(F.array(part("train", "train_start", "train_end"), part("test", "test_start", "test_end"))).alias("p")).select("asset", "window", "p.*")


def boosted_recommender(x: np.ndarray, y: np.ndarray, z: np.ndarray, **kw) -> tuple[np.ndarray, float]:
    """Expected returns at z of trees fitted to (x, y), and the sample deviation of y."""
    from .models import Boosted

    return Boosted(**kw).fit(x, y).predict(z), max(float(y.std(ddof=1)), 1e-10)


def random_recommender(n: int, seed: int, p: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected return, deploy, size) by chance: sides alike, magnitudes up to 0.01, deployed with probability p."""
    rng = np.random.default_rng(seed)
    go = rng.uniform(0.0, 1.0, n) < p
    side = rng.choice(np.array([1, -1]), size=n)
    r = side * rng.uniform(0.0, 0.01, n)
    return r, go, np.where(go, rng.uniform(0.0, 1.0, n), 0.0)


RUN = "asset string, window int, recommender string, timestamp {t}, actual double, pred double, deploy boolean, size double, confidence double"


def run(bars: DataFrame, signals: DataFrame, market: DataFrame, parts: dict[str, tuple], names: list[str], threshold: float = 0.0, cap: float = 1.0, seed: int = 42, bounds: DataFrame | None = None, **kw) -> DataFrame:
    """Walk-forward recommendations (asset, window, recommender, timestamp, actual, pred, deploy, size, confidence).

    parts: name -> (frame, function that makes its features); each is left-joined to market on (asset, timestamp). Every
    input is cut by row position into each window's training and test part (window_bounds(), with purge and embargo between
    them); features and labels are made within a part, so nothing looks across its edge. The boosted recommender and the
    random one are fitted in one kernel for each asset and window, which run side by side; a window with fewer than two
    training labels, or without a test label, gives no rows.
    """
    bounds = window_bounds(bars, **kw) if bounds is None else bounds
    made = {k: make(slices(frame, bounds)) for k, (frame, make) in parts.items()}
    x = features(slices(market, bounds), **made)
    y = labels(slices(bars, bounds), slices(signals, bounds))
    rows = aligned(x, y, names)
    key = F.split("asset", _MARK)
    rows = rows.select(F.get(key, F.lit(0)).alias("asset"), F.get(key, F.lit(1)).cast("int").alias("window"), F.get(key, F.lit(2)).alias("part"), "timestamp", *names, F.col("strategy_return").alias("actual"))
    columns = [c.split(" ")[0] for c in RUN.split(", ")]

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("timestamp", kind="stable")
        train, test = g[g["part"] == "train"], g[g["part"] == "test"]
        if len(train) < 2 or not len(test):
            return pd.DataFrame(columns=columns)
        r, sigma = boosted_recommender(train[names].to_numpy(float), train["actual"].to_numpy(float), test[names].to_numpy(float))
        boosted = {"recommender": "gradient_boosting", "pred": r, "deploy": r > threshold, "size": np.minimum(np.maximum(r - threshold, 0) / sigma, cap), "confidence": np.minimum(abs(r) / sigma, 1.0) if sigma > 1e-10 else 0.0}
        q, go, size = random_recommender(len(test), seed + key[1])
        chance = {"recommender": "random", "pred": q, "deploy": go, "size": size, "confidence": 0.5}
        base = test[["timestamp", "actual"]].assign(asset=key[0], window=key[1])
        return pd.concat([base.assign(**boosted), base.assign(**chance)])[columns]

    kind = rows.schema["timestamp"].dataType.simpleString()
    return rows.groupBy("asset", "window").applyInPandas(one, RUN.format(t=kind))
