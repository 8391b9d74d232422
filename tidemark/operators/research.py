"""Research views: coverage, gaps, weekly profiles, correlations, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ordered
from .metrics import seconds


def gaps(df: DataFrame, interval: float = 3600.0, multiple: float = 3.0) -> DataFrame:
    """Stretches between neighbouring rows longer than multiple x interval seconds, with the rows missing there."""
    d = df.withColumn("gap_start", F.lag("timestamp").over(ordered()))
    s = seconds("timestamp") - seconds("gap_start")
    d = d.withColumn("gap_hours", s / 3600).filter(s > multiple * interval)
    return d.select("asset", "gap_start", F.col("timestamp").alias("gap_end"), "gap_hours", F.greatest(F.floor(F.col("gap_hours") * 3600 / interval) - 1, F.lit(0)).cast("long").alias("missing"))


def coverage(df: DataFrame, interval: float = 3600.0) -> DataFrame:
    a = df.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    expected = (F.floor((seconds("last_ts") - seconds("first_ts")) / interval) + 1).cast("long")
    a = a.withColumn("expected", expected)
    return a.withColumns({"coverage_pct": F.least(F.lit(100.0), F.col("n") / F.col("expected") * 100), "days": (seconds("last_ts") - seconds("first_ts")) / 86400})


def asset_filter(cov: DataFrame, min_days: float = 730, max_gap: float = 0.05) -> DataFrame:
    ratio = 1 - F.col("n") / F.col("expected")
    reason = F.when(F.col("days") < min_days, "insufficient").when(ratio > max_gap, "gaps").otherwise("passed")
    return cov.select("asset", (reason == "passed").alias("included"), reason.alias("reason"))


def pivot(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.first(value))


def weekly(df: DataFrame, value: Column, name: str) -> DataFrame:
    """value by week (labelled by its Sunday) and asset, 0 for weeks without rows between the first and the last."""
    monday = F.date_trunc("week", "timestamp").cast("date")
    w = df.groupBy("asset", monday.alias("m")).agg(value.alias(name))
    spine = w.groupBy("asset").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    spine = spine.select("asset", F.explode(F.expr("sequence(a, b, INTERVAL 7 DAYS)")).alias("m"))
    out = spine.join(w, ["asset", "m"], "left")
    return out.select("asset", F.date_add("m", 6).cast("timestamp_ntz").alias("week"), F.coalesce(F.col(name), F.lit(0)).alias(name))


def durations(bars: DataFrame) -> DataFrame:
    """Minutes from start to end of bars: mean, median, deviation, bounds, coefficient of variation."""
    m = (seconds("end_ts") - seconds("start_ts")) / 60
    a = bars.withColumn("__m", m).groupBy("asset").agg(F.avg("__m").alias("mean"), F.percentile("__m", F.lit(0.5)).alias("median"), F.stddev_samp("__m").alias("std"), F.min("__m").alias("min"), F.max("__m").alias("max"))
    return a.withColumn("cv", F.try_divide("std", "mean"))


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) of all pairs, pairwise complete, in one aggregate."""
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    one = df.agg(*[F.corr(x, y).alias(f"{i}") for i, (x, y) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(str(i)).alias("r")) for i, (x, y) in enumerate(pairs)]))
    return one.select(rows.alias("z")).select("z.*")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(.., rho): correlation of mean ranks over rows that have both."""
    clean = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0
    r = clean.withColumns({"__x": rank(x), "__y": rank(y)})
    return r.groupBy(*by).agg(F.corr("__x", "__y").alias("rho"))


def entropy(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Shannon entropy of a histogram with 1 + floor(log2 n) equal bins, the last one closed."""
    x = df.filter(F.col(c).isNotNull())
    s = x.groupBy(*by).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("k", 1 + F.floor(F.log2(F.col("n").cast("double")) + 1e-12))
    at = F.floor(F.try_divide((F.col(c) - F.col("lo")) * F.col("k"), F.col("hi") - F.col("lo")))
    b = x.join(s, by).withColumn("bin", F.coalesce(F.least(at, F.col("k") - 1), F.lit(0)))
    p = b.groupBy(*by, "bin").agg((F.count(F.lit(1)) / F.max("n")).alias("p"))
    return p.groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def amplification(df: DataFrame, regime: str = "HIGH", cost: float = 0.002) -> DataFrame:
    """Mean |ret| in a regime by the overall one, and the regime's break-even accuracy."""
    a = df.groupBy("asset").agg(F.avg(F.when(F.col("regime") == regime, F.abs("ret"))).alias("m"), F.avg(F.abs("ret")).alias("all"))
    return a.select("asset", F.try_divide("m", "all").alias("amplification"), F.least(F.lit(1.0), 0.5 + F.try_divide(F.lit(cost), 2 * F.col("m"))).alias("breakeven_da"))


def retention(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """train(feature, kept) left-joined with holdout(feature, kept): which kept features are kept again."""
    h = holdout.select("feature", F.col("kept").alias("held"))
    return train.join(h, "feature", "left").withColumn("retained", F.col("kept") & F.coalesce("held", F.lit(False)))


def effect_size(mi: Column) -> Column:
    return F.when(mi > 0.05, "strong").when(mi > 0.01, "moderate").when(mi > 0.001, "weak").otherwise("negligible")


def gaussian_entropy(df: DataFrame, by: list[str], c: str) -> DataFrame:
    from math import e, pi

    return df.groupBy(*by).agg((0.5 * F.log(2 * pi * e * F.var_pop(c))).alias("entropy"))


def dedup_vote(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """Fold predictions (row, p, y) averaged by row and voted: accuracy over the rows."""
    v = df.groupBy("row").agg(F.avg("p").alias("p"), F.first("y").alias("y"))
    return v.withColumn("hit", ((F.round("p", 9) > cut).cast("int") == F.col("y")).cast("int"))


def feature_target_correlations(df: DataFrame, features: list[str], targets: list[str], by: list[str]) -> DataFrame:
    """(.., feature, target, r) in one aggregate; null where either side does not vary."""
    pairs = [(f, t) for f in features for t in targets]
    both = lambda f, t, c: F.when(F.col(f).isNotNull() & F.col(t).isNotNull(), F.col(c))
    r = lambda f, t: F.when((F.var_pop(both(f, t, f)) > 1e-18) & (F.var_pop(both(f, t, t)) > 1e-18), F.corr(f, t))
    one = df.groupBy(*by).agg(*[r(f, t).alias(f"{i}") for i, (f, t) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f"`{i}`").alias("r")) for i, (f, t) in enumerate(pairs)]))
    return one.select(*by, rows.alias("z")).select(*by, "z.*")


def horizon_summary(correlations: DataFrame) -> DataFrame:
    """Per target: how many pairs, mean and largest |r|."""
    return correlations.groupBy("target").agg(F.count("r").alias("n"), F.avg(F.abs("r")).alias("mean_abs"), F.max(F.abs("r")).alias("max_abs"))


def mi_table(correlations: DataFrame) -> DataFrame:
    """correlations with the mutual information of a normal pair of that r, and its effect size."""
    mi = -0.5 * F.log(1 - F.col("r") * F.col("r"))
    return correlations.withColumn("mi", mi).withColumn("effect", effect_size(F.col("mi")))


def flag_summary(df: DataFrame, by: str, flag: str) -> DataFrame:
    """Per feature how many of its series carry the flag: universal, never or mixed."""
    a = df.groupBy(by).agg(F.sum(F.col(flag).cast("long")).alias("n_true"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n_true") == F.col("n"), "universal").when(F.col("n_true") == 0, "never").otherwise("mixed")
    return a.withColumns({"share": F.col("n_true") / F.col("n"), "kind": kind})


# -- result tables ------------------------------------------------------------------------------------------------------


def weekly_variability(counts: DataFrame, by: str = "bar_type", value: str = "n") -> DataFrame:
    """(by, n_weeks, mean, std, cv) of weekly counts."""
    a = counts.groupBy(by).agg(F.count(F.lit(1)).alias("n_weeks"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return a.withColumn("cv", F.try_divide("std", "mean"))


def distributions(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """(.., feature, n, mean, std, q25, median, q75, skew, kurtosis): moments corrected for bias, null for too few rows."""
    long = df.unpivot(by, names, "feature", "v").filter("v IS NOT NULL")
    a = long.groupBy(*by, "feature").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.percentile("v", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("__q"),
        F.skewness("v").alias("__g"), F.kurtosis("v").alias("__k"),
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("__g"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__k") + 6))
    return a.select(*by, "feature", "n", "mean", "std", *[F.col("__q")[i].alias(c) for i, c in enumerate(("q25", "median", "q75"))], skew.alias("skew"), kurt.alias("kurtosis"))


def entropy_table(pe: DataFrame, dimensions: tuple[int, ...] = (3, 4, 5, 6)) -> DataFrame:
    """pe(asset, bar_type, d, entropy, complexity) with a column for each dimension."""
    wide = pe.groupBy("asset", "bar_type").pivot("d", list(dimensions)).agg(F.first("entropy"))
    return wide.withColumnsRenamed({str(d): f"H_d{d}" for d in dimensions})


def complexity_entropy(pe: DataFrame, d: int = 5) -> DataFrame:
    return pe.filter(F.col("d") == d).select("asset", "bar_type", "entropy", "complexity")


#: Published permutation entropies that a study's are compared with.
REFERENCE_ENTROPY = {"BTCUSDT": 0.985, "ETHUSDT": 0.987}


def against_reference(pe: DataFrame, reference: dict[str, float] = REFERENCE_ENTROPY, d: int = 5) -> DataFrame:
    """complexity_entropy() with the reference value and the difference; null for assets without one."""
    ref = pe.sparkSession.createDataFrame(list(reference.items()), "asset string, reference double")
    out = complexity_entropy(pe, d).join(F.broadcast(ref), "asset", "left")
    return out.withColumn("difference", F.col("entropy") - F.col("reference"))


def profile_rows(profile: DataFrame, name: str, parameter: str, value: str) -> DataFrame:
    """(asset, bar_type, <parameter>, <value>, p) of one statistic of a long profile."""
    return profile.filter(F.col("name") == name).select("asset", "bar_type", F.col("parameter").alias(parameter), F.col("value").alias(value), "p").orderBy("asset", "bar_type", parameter)


def n_eff_table(profile: DataFrame) -> DataFrame:
    """(asset, bar_type, n, n_eff, ratio), the largest effective size first."""
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    a = profile.groupBy("asset", "bar_type").agg(one("n").alias("n"), one("n_eff").alias("n_eff")).filter("n_eff IS NOT NULL")
    return a.withColumn("ratio", F.try_divide("n_eff", "n")).orderBy(F.desc("n_eff"), "asset", "bar_type")


def feasibility(df: DataFrame, margin: float = 0.01) -> DataFrame:
    """df(.., breakeven_da, mde_da) with gap and status: feasible if the break-even accuracy is above the least detectable one by
    `margin`, underpowered if it is below it by as much, else marginal."""
    gap = F.col("breakeven_da") - F.col("mde_da")
    return df.withColumn("gap", gap).withColumn("status", F.when(gap > margin, "feasible").when(gap < -margin, "underpowered").otherwise("marginal"))


def stationarity_summary(df: DataFrame) -> DataFrame:
    """df(feature, verdict, ..) by feature: share of each verdict's series, and universal, never or mixed."""
    a = flag_summary(df.withColumn("__s", F.col("verdict") == "stationary"), "feature", "__s")
    share = df.groupBy("feature").agg(*[F.avg((F.col("verdict") == v).cast("double") * 100).alias(f"pct_{v}") for v in ("stationary", "trend_stationary", "unit_root", "inconclusive")])
    return a.join(share, "feature")


def stationarity_cross(df: DataFrame, combos: list[str]) -> DataFrame:
    """feature x combo with the verdicts, "missing" where there is none."""
    return df.groupBy("feature").pivot("combo", combos).agg(F.first("verdict")).fillna("missing", combos)


def da_table(report: DataFrame) -> DataFrame:
    """report(.., da, da_null) with the excess in percentage points, the largest first."""
    return report.withColumn("excess_pp", (F.col("da") - F.col("da_null")) * 100).orderBy(F.desc("excess_pp"), "feature")


def cross_bars(report: DataFrame, bar_types: list[str], value: str = "mi") -> DataFrame:
    """feature x bar type of one value."""
    return report.groupBy("feature").pivot("bar_type", bar_types).agg(F.first(value))


def horizons(report: DataFrame, hs: list[int], values: tuple[str, ...] = ("mi", "da")) -> DataFrame:
    """feature x horizon with several values at once."""
    return report.groupBy("feature").pivot("horizon", hs).agg(*[F.first(v).alias(v) for v in values])


def variances(df: DataFrame, names: list[str], by: list[str], least: float = 1e-10) -> DataFrame:
    """(.., feature, variance, degenerate)."""
    a = df.unpivot(by, names, "feature", "v").groupBy(*by, "feature").agg(F.var_samp("v").alias("variance"))
    return a.withColumn("degenerate", F.coalesce(F.col("variance") < least, F.lit(True)))


def conditional_breakeven(df: DataFrame, by: list[str], cost: float = 0.002) -> DataFrame:
    """(.., regime, n, breakeven_da) for each regime; 1 where nothing moves."""
    m = F.avg(F.abs("ret"))
    return df.groupBy(*by, "regime").agg(F.count("ret").alias("n"), F.least(F.lit(1.0), F.coalesce(0.5 + F.try_divide(F.lit(cost), 2 * m), F.lit(1.0))).alias("breakeven_da"))


def breakeven_grid(df: DataFrame, bps: tuple[int, ...] = (10, 15, 20, 25, 30)) -> DataFrame:
    """(asset, cost_bps, breakeven_da): one aggregate, the costs are columns first."""
    a = df.groupBy("asset").agg(F.avg(F.abs("ret")).alias("m"))
    x = a.withColumn("cost_bps", F.explode(F.array(*[F.lit(b) for b in bps])))
    return x.select("asset", "cost_bps", F.least(F.lit(1.0), 0.5 + F.try_divide(F.col("cost_bps") / 10_000.0, 2 * F.col("m"))).alias("breakeven_da"))


def dedup_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the voted fold predictions df(asset, row, p, y), y in {0, 1}."""
    v = df.groupBy("asset", "row").agg((F.round(F.avg("p"), 9) > 0.5).cast("int").alias("vote"), F.first("y").alias("y"))
    cell = lambda a, b: F.sum(((F.col("vote") == a) & (F.col("y") == b)).cast("double"))
    a = v.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    z = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select("asset", "n", ((tp + F.col("tn")) / F.col("n")).alias("accuracy"), z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"))


def histogram(df: DataFrame, c: str, by: list[str], bins: int = 50) -> DataFrame:
    """(.., bin, low, high, n) of equal bins between the least and the greatest value; the frame of a distribution chart."""
    x = df.filter(F.col(c).isNotNull())
    s = x.groupBy(*by).agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    step = (F.col("__hi") - F.col("__lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col(c) - F.col("__lo"), step)), F.lit(0)), F.lit(bins - 1)).cast("int")
    b = x.join(s, by).groupBy(*by, at.alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("n"))
    return b.select(*by, "bin", (F.col("__lo") + F.col("bin") * step).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * step).alias("high"), "n")


def boxes(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """(.., min, q25, median, q75, max): the frame of a box chart."""
    q = F.percentile(c, F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75)]))
    a = df.groupBy(*by).agg(F.min(c).alias("min"), q.alias("q"), F.max(c).alias("max"))
    return a.select(*by, "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))], "max")


def acf_bands(acf: DataFrame) -> DataFrame:
    """acf(asset, n, lag, rho) with the band 1.96 / sqrt(n) and whether rho is beyond it: the frame of a stem chart."""
    band = 1.96 / F.sqrt(F.col("n").cast("double"))
    return acf.withColumns({"band": band, "significant": F.abs("rho") > band})
