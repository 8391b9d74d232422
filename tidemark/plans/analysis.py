"""Queries over statistics, forecast evaluation and research views; each with its DuckDB SQL where that can say it."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..functions import windows as W
from ..operators import bars as B
from ..operators import forecast as FC
from ..operators import linear as LN
from ..operators import indicators as I
from ..operators import profiling as P
from ..operators import research as RS
from ..sources.tables import candles, table
from .market import C, R, SQL, T0, _lead, _roll, query, rounded
from .trading import FE, _features

LR = f"{R}, lr AS (SELECT asset, timestamp, lr AS ret, close FROM r)"


def _ret(spark, d) -> DataFrame:
    return I.with_steps(candles(spark, d)).select("asset", "timestamp", F.col("__lr").alias("ret"), "close")


_SK = "(avg(pow(ret, 3)) - 3 * avg(ret) * avg(pow(ret, 2)) + 2 * pow(avg(ret), 3)) / pow(var_pop(ret), 1.5)"


@query("stat_descriptive", f"WITH {LR} SELECT asset, count(ret) AS n, round(avg(ret), 9) AS mean, round(stddev_samp(ret), 9) AS std, round({_SK}, 6) AS skew, round(kurtosis_pop(ret), 6) AS kurt, CASE WHEN count(ret) > 2000 THEN 'A' WHEN count(ret) >= 500 THEN 'B' ELSE 'C' END AS tier FROM lr WHERE ret IS NOT NULL GROUP BY 1")
def stat_descriptive(spark, d):
    x = P.descriptive(_ret(spark, d))
    return x.select("asset", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"), "tier")


@query("stat_jarque_bera", f"WITH {LR}, m AS (SELECT asset, count(*) / 6.0 * (pow({_SK}, 2) + pow(kurtosis_pop(ret), 2) / 4.0) AS jb FROM lr WHERE ret IS NOT NULL GROUP BY 1) SELECT asset, round(jb, 4) AS jb, round(exp(-jb / 2), 9) AS jb_p FROM m")
def stat_jarque_bera(spark, d):
    return P.descriptive(_ret(spark, d)).select("asset", F.round("jb", 4).alias("jb"), F.round("jb_p", 9).alias("jb_p"))


_ACF = f"""{LR}, dv AS (SELECT *, ret - avg(ret) OVER (PARTITION BY asset) AS d FROM lr WHERE ret IS NOT NULL), pr AS (SELECT *, {', '.join(f'd * lag(d, {k}) OVER ({T0}) AS p{k}' for k in range(1, 21))} FROM dv),
ac AS (SELECT asset, count(*) AS n, {', '.join(f'sum(p{k}) / sum(d * d) AS r{k}' for k in range(1, 21))} FROM pr GROUP BY 1)"""
_LB = " UNION ALL ".join(f"SELECT asset, {m} AS lag, round(n * (n + 2) * ({' + '.join(f'r{k} * r{k} / (n - {k})' for k in range(1, m + 1))}), 6) AS q FROM ac" for m in (5, 10, 20))


@query("stat_acf", f"WITH {_ACF} " + " UNION ALL ".join(f"SELECT asset, {k} AS lag, round(r{k}, 9) AS rho FROM ac" for k in range(1, 11)))
def stat_acf(spark, d):
    return rounded(P.autocorrelations(_ret(spark, d), lags=10).select("asset", "lag", "rho"), places=9)


@query("stat_ljung_box", f"WITH {_ACF} {_LB}")
def stat_ljung_box(spark, d):
    return rounded(P.ljung_box(P.autocorrelations(_ret(spark, d), lags=20), (5, 10, 20)))


_LBP = " UNION ALL ".join(f"SELECT asset, lag, q, round(exp(-q / 2) * ({' + '.join(f'pow(q / 2, {i}) / {float(factorial(i))!r}' for i in range(m // 2))}), 9) AS p FROM lb WHERE lag = {m}" for m in (10, 20))


@query("stat_ljung_box_p", f"WITH {_ACF}, lb AS ({_LB}) {_LBP}")
def stat_ljung_box_p(spark, d):
    q = rounded(P.ljung_box(P.autocorrelations(_ret(spark, d), lags=20), (10, 20)))
    return P.chi2_p(q, "q", "lag").withColumn("p", F.round("p", 9))


@query("stat_acf_bands", f"WITH {_ACF} " + " UNION ALL ".join(f"SELECT asset, n, {k} AS lag, round(r{k}, 9) AS rho, round(1.96 / sqrt(n), 9) AS band, abs(r{k}) > 1.96 / sqrt(n) AS significant FROM ac" for k in range(1, 11)))
def stat_acf_bands(spark, d):
    return rounded(RS.acf_bands(P.autocorrelations(_ret(spark, d), lags=10)), places=9)


@query("stat_perm_entropy", f"""WITH {LR}, l AS (SELECT asset, timestamp, lag(ret, 2) OVER ({T0}) AS a, lag(ret, 1) OVER ({T0}) AS b, ret AS c3 FROM lr WHERE ret IS NOT NULL),
q AS (SELECT asset, concat(CAST((b < a) AS INT) + CAST((c3 < a) AS INT), CAST((a <= b) AS INT) + CAST((c3 < b) AS INT), CAST((a <= c3) AS INT) + CAST((b <= c3) AS INT)) AS p FROM l WHERE a IS NOT NULL),
n AS (SELECT asset, p, count(*) AS n FROM q GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY asset) AS q FROM n),
h AS (SELECT asset, -sum(q * ln(q)) AS h, -sum((q + 1.0 / 6) / 2 * ln((q + 1.0 / 6) / 2)) - (6 - count(*)) * (1.0 / 12) * ln(1.0 / 12) AS hm FROM s GROUP BY 1)
SELECT asset, round(h / ln(6), 9) AS entropy, round((hm - (h + ln(6)) / 2) / (-(7.0 / 12 * ln(7.0 / 12) + 5 * (1.0 / 12) * ln(1.0 / 12)) - ln(6) / 2) * h / ln(6), 6) AS complexity FROM h""")
def stat_perm_entropy(spark, d):
    x = P.permutation_entropy(_ret(spark, d))
    return x.select("asset", F.round("entropy", 9).alias("entropy"), F.round("complexity", 6).alias("complexity"))


_RV = f"{R}, v AS (SELECT asset, timestamp, lr AS ret, {_roll('stddev_samp(lr)', 'lr', 20)} AS rv FROM r), qq AS (SELECT asset, quantile_cont(rv, 0.25) AS q1, quantile_cont(rv, 0.75) AS q3 FROM v GROUP BY 1), rg AS (SELECT v.*, CASE WHEN rv < q1 THEN 'LOW' WHEN rv > q3 THEN 'HIGH' ELSE 'NORMAL' END AS regime FROM v JOIN qq ON qq.asset = v.asset)"


def _regimes(spark, d):
    s = I.with_steps(candles(spark, d))
    return P.regimes(s.select("asset", "timestamp", F.col("__lr").alias("ret"), W.std("__lr", 20).alias("rv")), "rv")


@query("stat_regimes", f"WITH {_RV} SELECT asset, timestamp, regime FROM rg")
def stat_regimes(spark, d):
    return _regimes(spark, d).select("asset", "timestamp", "regime")


_Z = tails.norm_ppf(0.95) + tails.norm_ppf(0.80)


@query("stat_breakeven_mde", f"WITH {LR} SELECT asset, round(avg(abs(ret)), 9) AS mean_abs, round(least(greatest(0.5 + 0.002 / (2 * avg(abs(ret))), 0.5), 1.0), 9) AS breakeven_da, round(least(greatest(0.5 + {_Z!r} / (2 * sqrt(count(*))), 0.5), 1.0), 9) AS mde_da FROM lr WHERE ret IS NOT NULL GROUP BY 1")
def stat_breakeven_mde(spark, d):
    return rounded(P.breakeven(_ret(spark, d)), places=9)


#: A family of tests: a pseudo p-value for each asset and hour of the day from the hour's mean return.
_FAM = f"{LR}, fam AS (SELECT asset, CAST(hour(timestamp) AS INT) AS h, count(*) AS n, 1 / (1 + pow(abs(avg(ret)) * sqrt(count(*)) / 1.5, 4)) AS p FROM lr WHERE ret IS NOT NULL GROUP BY 1, 2)"


def _family(spark, d):
    x = _ret(spark, d).filter("ret IS NOT NULL").groupBy("asset", F.hour("timestamp").alias("h")).agg(F.avg("ret").alias("m"), F.count(F.lit(1)).alias("n"))
    return x.select("asset", "h", (1 / (1 + F.pow(F.abs("m") * F.sqrt(F.col("n").cast("double")) / 1.5, F.lit(4.0)))).alias("p"))


@query("stat_bh", f"WITH {_FAM}, k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM fam), b AS (SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY p DESC, r DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM k) SELECT asset, h, round(p, 9) AS p, round(p_adj, 9) AS p_adj, p_adj <= 0.05 AS reject FROM b")
def stat_bh(spark, d):
    return rounded(P.benjamini_hochberg(_family(spark, d)), places=9)


@query("stat_holm", f"WITH {_FAM}, k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM fam) SELECT asset, h, round(p, 9) AS p, min(CASE WHEN p < 0.05 / (m - r + 1) THEN 1 ELSE 0 END) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) = 1 AS reject FROM k")
def stat_holm(spark, d):
    return rounded(P.holm(_family(spark, d)), places=9)


@query("stat_partitions", f"WITH {C} SELECT asset, count(*) AS n FROM c WHERE timestamp >= TIMESTAMP '2024-01-01' GROUP BY 1")
def stat_partitions(spark, d):
    return P.filter_partition(candles(spark, d), "holdout").groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


@query("stat_bars_per_day", f"WITH {C} SELECT asset, round(greatest(1.0, count(*) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6)), 9) AS bars_per_day FROM c GROUP BY 1")
def stat_bars_per_day(spark, d):
    return rounded(P.bars_per_day(candles(spark, d)), places=9)


@query("stat_transforms", f"WITH {R}, x AS (SELECT *, {_roll('avg(tr)', 'tr', 14)} AS atr FROM r) SELECT asset, timestamp, round(atr / nullif(close, 0), 9) AS pct_atr, round((close - {_roll('avg(close)', 'close', 24)}) / nullif({_roll('stddev_samp(close)', 'close', 24)}, 0), 9) AS rolling_zscore, round(close - lag(close) OVER ({T0}), 9) AS first_difference FROM x")
def stat_transforms(spark, d):
    s = I.with_steps(candles(spark, d)).withColumn("atr", W.mean("__tr", 14))
    return rounded(P.transforms(s, "close", "atr").select("asset", "timestamp", "pct_atr", "rolling_zscore", "first_difference"), places=9)


def _kernel(name: str, fit, schema: str):
    @query(name)
    def run(spark, d):
        return rounded(P.kernel(_ret(spark, d), "ret", fit, schema))


_VR = f"""{LR}, dv AS (SELECT *, row_number() OVER ({T0}) AS i, ret - avg(ret) OVER (PARTITION BY asset) AS d FROM lr WHERE ret IS NOT NULL),
s AS (SELECT *, CASE WHEN i >= 8 THEN sum(d) OVER ({T0} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS s8, {', '.join(f'd * d * pow(lag(d, {k}) OVER ({T0}), 2) AS p{k}' for k in range(1, 8))} FROM dv),
a AS (SELECT asset, count(*) AS n, sum(d * d) AS v, sum(s8 * s8) AS q, {' + '.join(f'pow(2 * {8 - k} / 8.0, 2) * sum(p{k})' for k in range(1, 8))} AS t FROM s GROUP BY 1),
rt AS (SELECT asset, (q / (8 * (n - 7) * (1 - 8.0 / n))) / (v / (n - 1)) AS vr, t / (v * v) AS theta FROM a)"""


@query("stat_variance_ratio", f"WITH {_VR} SELECT asset, round(vr, 6) AS vr, round((vr - 1) / sqrt(theta), 6) AS z FROM rt")
def stat_variance_ratio(spark, d):
    return rounded(P.kernel(_ret(spark, d), "ret", lambda x: dict(zip(("vr", "z"), P.variance_ratio(x, 8))), "vr double, z double"))


_FIT = "omega double, alpha double, gamma double, beta double, nu double, skew double, aic double, bic double"
_kernel("stat_adf_kpss", P.stationarity, "adf double, adf_p double, kpss double, kpss_p double, verdict string")
_kernel("stat_garch", P.garch_fit, _FIT)
_kernel("stat_gjr_garch", lambda x: P.garch_fit(x, True), _FIT)
_kernel("stat_student_fit", P.student_fit, "nu double, loc double, scale double, aic_t double, aic_normal double, bic_t double, bic_normal double")
_kernel("stat_bds", lambda x: {f"bds_{m}": s for m, s, _ in P.bds(x)}, "bds_2 double, bds_3 double, bds_4 double, bds_5 double")


@query("stat_ks_normal")
def stat_ks_normal(spark, d):
    return rounded(P.ks_test(_ret(spark, d)))


@query("stat_sign_bias")
def stat_sign_bias(spark, d):
    return rounded(LN.sign_bias(_ret(spark, d)))


@query("stat_arch_lm")
def stat_arch_lm(spark, d):
    return rounded(LN.arch_lm(_ret(spark, d)))


@query("stat_granger")
def stat_granger(spark, d):
    """p of every ordered pair of assets at lags 1, 2, 4 and 8, on daily mean returns. The pairs are the result, so it grows with
    the square of the number of assets."""
    daily = _ret(spark, d).groupBy("asset", F.date_trunc("day", "timestamp").alias("day")).agg(F.avg("ret").alias("x"))
    a, b = (daily.select(F.col("asset").alias(k), "day", F.col("x").alias(f"x{k}")) for k in "ab")
    got = LN.granger(a.join(b, "day").filter("a <> b"), "xa", "xb", [1, 2, 4, 8], ["a", "b"], "day")
    return got.select(F.col("a").alias("cause"), F.col("b").alias("effect"), "lag", F.round("p", 9).alias("p"))


# -- forecast evaluation: directions from the slope, outcomes from the next row ------------------------------------------

_EV = f"""{FE}, ev0 AS (SELECT asset, timestamp, slope, rv, {_lead('close', 1)} / close - 1 AS nxt FROM x),
ev AS (SELECT asset, timestamp, CASE WHEN nxt >= 0 THEN 1 ELSE -1 END AS y, CASE WHEN slope >= 0 THEN 1 ELSE -1 END AS pred, 0.5 + abs(slope) / (2 + 2 * abs(slope)) AS confidence, 1 / (1 + exp(-slope)) AS score, nxt AS ret, nxt AS actual, slope / 10 AS predicted, rv AS vol FROM ev0 WHERE nxt IS NOT NULL AND slope IS NOT NULL)"""


def _eval(spark, d):
    x = _features(spark, d).select("asset", "timestamp", "slope", "rv", (F.try_divide(W.lead("close", 1), F.col("close")) - 1).alias("actual")).filter("actual IS NOT NULL AND slope IS NOT NULL")
    s = F.col("slope")
    return x.select("asset", "timestamp", F.when(F.col("actual") >= 0, 1).otherwise(-1).alias("y"), F.when(s >= 0, 1).otherwise(-1).alias("pred"), (0.5 + F.abs(s) / (2 + 2 * F.abs(s))).alias("confidence"), (1 / (1 + F.exp(-s))).alias("score"), F.col("actual").alias("ret"), "actual", (s / 10).alias("predicted"), F.col("rv").alias("vol"))


_CF = f"""{_EV}, cf AS (SELECT asset, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS uu, sum(CASE WHEN y = 1 AND pred = -1 THEN 1 ELSE 0 END)::DOUBLE AS ud, sum(CASE WHEN y = -1 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS du, sum(CASE WHEN y = -1 AND pred = -1 THEN 1 ELSE 0 END)::DOUBLE AS dd FROM ev GROUP BY 1),
ms AS (SELECT asset, uu + ud AS n_up, du + dd AS n_down, (uu + dd) / (uu + ud + du + dd) AS accuracy, coalesce(uu / nullif(uu + du, 0), 0.0) AS precision_up, coalesce(uu / nullif(uu + ud, 0), 0.0) AS recall_up, coalesce(2 * uu / nullif(2 * uu + du + ud, 0), 0.0) AS f1_up,
 coalesce(dd / nullif(dd + ud, 0), 0.0) AS precision_down, coalesce(dd / nullif(dd + du, 0), 0.0) AS recall_down, coalesce(2 * dd / nullif(2 * dd + ud + du, 0), 0.0) AS f1_down FROM cf)"""
_NAMES = ("accuracy", "precision_up", "recall_up", "f1_up", "precision_down", "recall_down", "f1_down")


@query("cls_confusion", f"WITH {_CF} SELECT asset, " + ", ".join(f"round({c}, 9) AS {c}" for c in _NAMES) + " FROM ms")
def cls_confusion(spark, d):
    return rounded(FC.confusion(_eval(spark, d), ["asset"]).select("asset", *_NAMES), places=9)


@query("cls_asymmetric", f"WITH {_CF} SELECT asset, " + ", ".join(f"round((1.0 * {m}_up * n_up + 1.5 * {m}_down * n_down) / (1.0 * n_up + 1.5 * n_down), 9) AS weighted_{m}" for m in ("precision", "recall", "f1")) + " FROM ms")
def cls_asymmetric(spark, d):
    x = FC.asymmetric(FC.confusion(_eval(spark, d), ["asset"]))
    return rounded(x.select("asset", "weighted_precision", "weighted_recall", "weighted_f1"), places=9)


@query("cls_auc", f"""WITH {_EV}, rk AS (SELECT *, rank() OVER (PARTITION BY asset ORDER BY score) + (count(*) OVER (PARTITION BY asset, score) - 1) / 2.0 AS r FROM ev),
s AS (SELECT asset, sum(CASE WHEN y = 1 THEN r END) AS s, count(CASE WHEN y = 1 THEN 1 END) AS np, count(CASE WHEN y <> 1 THEN 1 END) AS nn FROM rk GROUP BY 1) SELECT asset, round((s - np * (np + 1) / 2.0) / (np * nn), 9) AS auc FROM s""")
def cls_auc(spark, d):
    return rounded(FC.auc(_eval(spark, d), ["asset"]), places=9)


@query("cls_labels_auc", """WITH t AS (SELECT l.toxic AS y, CAST(d.n_chars AS DOUBLE) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id), rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM t),
s AS (SELECT sum(CASE WHEN y = 1 THEN r END) AS s, count(CASE WHEN y = 1 THEN 1 END) AS np, count(CASE WHEN y <> 1 THEN 1 END) AS nn FROM rk) SELECT 'all' AS g, round((s - np * (np + 1) / 2.0) / (np * nn), 9) AS auc FROM s""")
def cls_labels_auc(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(FC.auc(t.select(F.lit("all").alias("g"), F.col("toxic").alias("y"), F.col("n_chars").cast("double").alias("score")), ["g"]), places=9)


@query("cls_abstention", f"WITH {_EV} SELECT asset, cut, round(avg(CASE WHEN confidence >= cut THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(avg(CASE WHEN confidence >= cut THEN CASE WHEN y = pred THEN 1.0 ELSE 0.0 END END), 9) AS accuracy FROM ev, (VALUES (0.5::DOUBLE), (0.55), (0.6), (0.65), (0.7)) t(cut) GROUP BY 1, 2")
def cls_abstention(spark, d):
    return rounded(FC.abstention(_eval(spark, d), ["asset"]), places=9)


@query("cls_ece", f"WITH {_EV}, b AS (SELECT asset, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS a FROM ev GROUP BY 1, 2) SELECT asset, round(sum(n * abs(a - c)) / sum(n), 9) AS ece FROM b GROUP BY 1")
def cls_ece(spark, d):
    return rounded(FC.calibration_error(_eval(spark, d), ["asset"]), places=9)


@query("cls_economic", f"WITH {_EV} SELECT asset, round(sum(abs(ret) * CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) / sum(abs(ret)), 9) AS economic_accuracy FROM ev GROUP BY 1")
def cls_economic(spark, d):
    return rounded(FC.economic_accuracy(_eval(spark, d), ["asset"]), places=9)


@query("cls_naive", f"WITH {_EV} SELECT asset, CASE WHEN 2 * count(CASE WHEN y = 1 THEN 1 END) >= count(*) THEN 1 ELSE -1 END AS majority, arg_max(y, timestamp) AS persistence FROM ev GROUP BY 1")
def cls_naive(spark, d):
    e = _eval(spark, d)
    return FC.majority(e, ["asset"]).select("asset", F.col("pred").alias("majority")).join(FC.persistence(e, ["asset"]).select("asset", F.col("pred").alias("persistence")), "asset")


@query("reg_metrics", f"WITH {_EV} SELECT asset, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg(pow(actual - predicted, 2))), 6) AS rmse, round(1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(actual)), 6) AS r2, round(avg(CASE WHEN sign(actual) = sign(predicted) THEN 1.0 ELSE 0.0 END), 9) AS directional FROM ev GROUP BY 1")
def reg_metrics(spark, d):
    x = FC.regression(_eval(spark, d), ["asset"], p="predicted")
    return x.select("asset", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")], F.round("directional", 9).alias("directional"))


@query("reg_dc", f"WITH {_EV} SELECT asset, round(avg(CASE WHEN sign(actual) = sign(predicted) THEN abs(actual - predicted) END), 6) AS dc_mae, round(sqrt(avg(CASE WHEN sign(actual) = sign(predicted) THEN pow(actual - predicted, 2) END)), 6) AS dc_rmse FROM ev GROUP BY 1")
def reg_dc(spark, d):
    return rounded(FC.direction_correct(_eval(spark, d), ["asset"], p="predicted"))


@query("reg_pdr", f"WITH {_EV} SELECT asset, round(coalesce(avg(CASE WHEN sign(actual) = sign(predicted) AND abs(predicted) > 0.01 THEN CASE WHEN abs(actual) > 0.005 THEN 1.0 ELSE 0.0 END END), 0.0), 9) AS pdr FROM ev GROUP BY 1")
def reg_pdr(spark, d):
    return rounded(FC.profitable(_eval(spark, d), ["asset"], p="predicted"), places=9)


_VOL = f"{FE}, vv AS (SELECT asset, timestamp, rv AS predicted, {_lead('rv', 24)} AS actual FROM x)"


def _vols(spark, d):
    return _features(spark, d).select("asset", "timestamp", F.col("rv").alias("predicted"), F.lead("rv", 24).over(W.ordered()).alias("actual"))


@query("reg_qlike_mz", f"WITH {_VOL} SELECT asset, round(avg(pow(actual / predicted, 2) - ln(pow(actual / predicted, 2)) - 1.0), 9) AS qlike, round(regr_slope(actual, predicted), 9) AS mz_slope, round(regr_intercept(actual, predicted), 9) AS mz_intercept, round(regr_r2(actual, predicted), 9) AS mz_r2, round(avg(abs(ln(actual) - ln(predicted))), 9) AS log_mae FROM vv WHERE actual > 0 AND predicted > 0 GROUP BY 1")
def reg_qlike_mz(spark, d):
    return rounded(FC.volatility(_vols(spark, d), ["asset"], p="predicted"), places=9)


@query("reg_econ_sharpe", f"WITH {_EV}, n AS (SELECT asset, sign(predicted) * actual - 0.001 * abs(sign(predicted) - lag(sign(predicted), 1, 0.0) OVER ({T0})) AS net FROM ev) SELECT asset, round(avg(net) / stddev_samp(net), 9) AS economic_sharpe FROM n GROUP BY 1")
def reg_econ_sharpe(spark, d):
    return rounded(FC.economic_sharpe(_eval(spark, d).drop("pred").withColumnRenamed("predicted", "pred")), places=9)


@query("regime_coverage", f"WITH {_EV}, b AS (SELECT *, predicted - vol AS lo, predicted + vol AS hi FROM ev WHERE vol IS NOT NULL), m AS (SELECT asset, quantile_cont(vol, 0.5) AS m FROM b GROUP BY 1) SELECT b.asset, round(avg(CASE WHEN vol > m THEN CASE WHEN actual >= lo AND actual <= hi THEN 1.0 ELSE 0.0 END END), 9) AS high, round(avg(CASE WHEN vol <= m THEN CASE WHEN actual >= lo AND actual <= hi THEN 1.0 ELSE 0.0 END END), 9) AS low FROM b JOIN m ON m.asset = b.asset GROUP BY 1")
def regime_coverage(spark, d):
    e = _eval(spark, d).filter("vol IS NOT NULL").withColumns({"lower": F.col("predicted") - F.col("vol"), "upper": F.col("predicted") + F.col("vol")})
    return rounded(FC.regime_coverage(e, ["asset"]), places=9)


@query("reliability_quantile", f"WITH {_EV} SELECT asset, q AS quantile, round(avg(CASE WHEN actual <= predicted + (q - 0.5) * vol THEN 1.0 ELSE 0.0 END), 9) AS observed FROM ev, (VALUES (0.1::DOUBLE), (0.5), (0.9)) t(q) WHERE vol IS NOT NULL GROUP BY 1, 2")
def reliability_quantile(spark, d):
    e = _eval(spark, d).filter("vol IS NOT NULL")
    e = e.withColumns({f"q{i}": F.col("predicted") + (q - 0.5) * F.col("vol") for i, q in enumerate((0.1, 0.5, 0.9))})
    return rounded(FC.quantile_reliability(e, ["asset"], {0.1: "q0", 0.5: "q1", 0.9: "q2"}), places=9)


_SPLIT = "2024-01-16"
_ACI = f"""WITH RECURSIVE {_EV}, sc AS (SELECT asset, list(abs(actual - predicted) ORDER BY abs(actual - predicted)) AS v, count(*) AS n FROM ev WHERE timestamp < TIMESTAMP '{_SPLIT}' GROUP BY 1),
t AS (SELECT asset, timestamp, actual, predicted, row_number() OVER ({T0}) AS i FROM ev WHERE timestamp >= TIMESTAMP '{_SPLIT}'),
f AS (SELECT asset, CAST(1 AS BIGINT) AS i, CAST(0.1 AS DOUBLE) AS alpha FROM sc UNION ALL
 SELECT f.asset, f.i + 1, least(0.5::DOUBLE, greatest(0.001::DOUBLE, f.alpha + 0.01::DOUBLE * (CASE WHEN abs(t.actual - t.predicted) > v[CAST(floor((1 - f.alpha) * (n - 1)) AS INT) + 1] + ((1 - f.alpha) * (n - 1) - floor((1 - f.alpha) * (n - 1))) * (v[least(CAST(floor((1 - f.alpha) * (n - 1)) AS INT) + 2, n)] - v[CAST(floor((1 - f.alpha) * (n - 1)) AS INT) + 1]) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 0.1::DOUBLE)))
 FROM f JOIN t ON t.asset = f.asset AND t.i = f.i JOIN sc ON sc.asset = f.asset),
w AS (SELECT t.asset, timestamp, alpha, predicted, actual, v[CAST(floor((1 - alpha) * (n - 1)) AS INT) + 1] + ((1 - alpha) * (n - 1) - floor((1 - alpha) * (n - 1))) * (v[least(CAST(floor((1 - alpha) * (n - 1)) AS INT) + 2, n)] - v[CAST(floor((1 - alpha) * (n - 1)) AS INT) + 1]) AS width FROM t JOIN f ON f.asset = t.asset AND f.i = t.i JOIN sc ON sc.asset = t.asset)
SELECT asset, timestamp, round(alpha, 6) AS alpha, round(predicted - width, 6) AS lower, round(predicted + width, 6) AS upper, abs(actual - predicted) <= width AS covered FROM w"""


@query("conformal_adaptive", _ACI)
def conformal_adaptive(spark, d):
    e, cut = _eval(spark, d), F.lit(_SPLIT).cast("timestamp_ntz")
    scores = e.filter(F.col("timestamp") < cut).select("asset", (F.col("actual") - F.col("predicted")).alias("residual"))
    rows = e.filter(F.col("timestamp") >= cut).select("asset", "timestamp", F.col("predicted").alias("pred"), "actual")
    return rounded(FC.adaptive_conformal(scores, rows))


def _cdf_sql(z: str) -> str:
    """The normal distribution function by its series, the terms through logarithms of gamma functions."""
    terms = f"list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    return f"CASE WHEN {z} > 7 THEN 1.0 WHEN {z} < -7 THEN 0.0 WHEN {z} = 0 THEN 0.5 ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {terms} END"


@query("crps_gaussian", f"WITH {_EV}, z AS (SELECT asset, vol, (actual - predicted) / vol AS z FROM ev WHERE vol IS NOT NULL), p AS (SELECT asset, vol, z, {_cdf_sql('z')} AS cdf FROM z) SELECT asset, round(avg(vol * (z * (2 * cdf - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 6) AS crps FROM p GROUP BY 1")
def crps_gaussian(spark, d):
    return rounded(FC.crps_gaussian(_eval(spark, d).filter("vol IS NOT NULL"), "actual", "predicted", "vol").groupBy("asset").agg(F.avg("crps").alias("crps")))


@query("ridge_single", f"WITH {_EV} SELECT asset, round(covar_pop(predicted, actual) * count(*) / (regr_sxx(actual, predicted) + 1.0), 9) AS slope, round(avg(actual) - covar_pop(predicted, actual) * count(*) / (regr_sxx(actual, predicted) + 1.0) * avg(predicted), 9) AS intercept FROM ev GROUP BY 1")
def ridge_single(spark, d):
    return rounded(FC.ridge_single(_eval(spark, d), ["asset"], "predicted", "actual"), places=9)


def _before(n: int) -> str:
    w = f"OVER ({T0} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"round(CASE WHEN count(rv) {w} >= {n} THEN avg(rv) {w} END, 9)"


@query("har_features", f"WITH {FE} SELECT asset, timestamp, round(lag(rv) OVER ({T0}), 9) AS har_1, {_before(5)} AS har_5, {_before(22)} AS har_22 FROM x")
def har_features(spark, d):
    return rounded(FC.har_features(_features(spark, d)).select("asset", "timestamp", "har_1", "har_5", "har_22"), places=9)


_DMK = ", ".join(f"dd * lag(dd, {k}) OVER ({T0}) AS p{k}" for k in range(1, 13))
_LRV = "sum(dd * dd) / count(*)" + "".join(f" + CASE WHEN floor(pow(count(*), {1 / 3!r})) >= {k} THEN 2 * (1 - {k} / (floor(pow(count(*), {1 / 3!r})) + 1)) * sum(p{k}) / count(*) ELSE 0.0 END" for k in range(1, 13))


@query("dm_test", f"WITH {_EV}, l AS (SELECT asset, timestamp, pow(actual - predicted, 2) - pow(actual, 2) AS x FROM ev), dl AS (SELECT *, x - avg(x) OVER (PARTITION BY asset) AS dd FROM l), pk AS (SELECT *, {_DMK} FROM dl), v AS (SELECT asset, avg(x) AS m, count(*) AS n, {_LRV} AS lrv FROM pk GROUP BY 1) SELECT asset, round(CASE WHEN lrv > 0 THEN m / sqrt(lrv / n) END, 6) AS dm FROM v")
def dm_test(spark, d):
    e = _eval(spark, d).withColumns({"la": F.pow(F.col("actual") - F.col("predicted"), F.lit(2.0)), "lb": F.pow("actual", F.lit(2.0))})
    return rounded(LN.diebold_mariano(e, "la", "lb", ["asset"]).select("asset", "dm"))


# -- research ------------------------------------------------------------------------------------------------------------

_G = f"{C}, g AS (SELECT *, lag(timestamp) OVER ({T0}) AS gs FROM c)"


@query("gap_detection", f"WITH {_G} SELECT asset, gs AS gap_start, timestamp AS gap_end, (epoch_us(timestamp) - epoch_us(gs)) / 3600e6 AS gap_hours, CAST(greatest(floor((epoch_us(timestamp) - epoch_us(gs)) / 3600e6) - 1, 0) AS BIGINT) AS missing FROM g WHERE epoch_us(timestamp) - epoch_us(gs) > 3 * 3600e6")
def gap_detection(spark, d):
    return RS.gaps(candles(spark, d))


_COV = f"{C}, v AS (SELECT asset, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts, CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3600e6) + 1 AS BIGINT) AS expected FROM c GROUP BY 1)"


@query("coverage", f"WITH {_COV} SELECT *, round(least(100.0, n / expected * 100), 9) AS coverage_pct, round((epoch_us(last_ts) - epoch_us(first_ts)) / 86400e6, 9) AS days FROM v")
def coverage(spark, d):
    return rounded(RS.coverage(candles(spark, d)), places=9)


@query("asset_filter", f"WITH {_COV}, f AS (SELECT asset, CASE WHEN (epoch_us(last_ts) - epoch_us(first_ts)) / 86400e6 < 20 THEN 'insufficient' WHEN 1 - n / expected > 0.09 THEN 'gaps' ELSE 'passed' END AS reason FROM v) SELECT asset, reason = 'passed' AS included, reason FROM f")
def asset_filter(spark, d):
    return RS.asset_filter(RS.coverage(candles(spark, d)), 20, 0.09)


@query("coverage_pivot", "SELECT event_type AS asset, CAST(count(DISTINCT date_trunc('hour', ts)) AS BIGINT) AS hour, CAST(count(DISTINCT date_trunc('day', ts)) AS BIGINT) AS day FROM events GROUP BY 1")
def coverage_pivot(spark, d):
    n = [candles(spark, d, t).groupBy("asset").agg(F.count(F.lit(1)).alias("n")).withColumn("timeframe", F.lit(t)) for t in ("hour", "day")]
    return RS.pivot(n[0].unionByName(n[1]), "asset", "timeframe", ["hour", "day"], "n")


@query("weekly_bar_counts", f"WITH {C}, w AS (SELECT asset, CAST(date_trunc('week', timestamp) AS DATE) AS m, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT asset, unnest(range(min(m), max(m) + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS m FROM w GROUP BY 1) SELECT s.asset, CAST(s.m + INTERVAL 6 DAY AS TIMESTAMP) AS week, coalesce(w.n, 0) AS n FROM s LEFT JOIN w ON w.asset = s.asset AND w.m = s.m")
def weekly_bar_counts(spark, d):
    return RS.weekly(candles(spark, d), F.count(F.lit(1)), "n")


@query("volume_profile", "WITH o AS (SELECT o_orderpriority AS asset, o_orderdate AS timestamp, o_totalprice AS v FROM orders), w AS (SELECT asset, CAST(date_trunc('week', timestamp) AS DATE) AS m, sum(v) AS v FROM o GROUP BY 1, 2), s AS (SELECT asset, unnest(range(min(m), max(m) + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS m FROM w GROUP BY 1) SELECT s.asset, CAST(s.m + INTERVAL 6 DAY AS TIMESTAMP) AS week, round(coalesce(w.v, 0), 2) AS volume FROM s LEFT JOIN w ON w.asset = s.asset AND w.m = s.m")
def volume_profile(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").alias("timestamp"), "o_totalprice")
    return rounded(RS.weekly(o, F.sum("o_totalprice"), "volume"), places=2)


@query("bar_duration", SQL["bars_volume"].replace("SELECT v.asset, bar_id, min(timestamp)", ", bars AS (SELECT v.asset, bar_id, min(timestamp)").replace("FROM ids)\n, bars", "FROM ids), bars") + ") SELECT asset, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.5), 6) AS median, round(stddev_samp(m), 6) AS std, round(min(m), 6) AS min, round(max(m), 6) AS max, round(stddev_samp(m) / avg(m), 9) AS cv FROM (SELECT asset, (epoch_us(end_ts) - epoch_us(start_ts)) / 60e6 AS m FROM bars) GROUP BY 1")
def bar_duration(spark, d):
    x = RS.durations(B.standard_bars(candles(spark, d), "volume", 5000.0))
    return x.select("asset", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")], F.round("cv", 9).alias("cv"))


_CN = ("close", "volume", "rv", "slope")


@query("corr_matrix", f"WITH {FE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM x" for i, a in enumerate(_CN) for b in _CN[i:]))
def corr_matrix(spark, d):
    return rounded(RS.correlations(_features(spark, d), list(_CN)), places=9)


@query("spearman", f"WITH {_EV}, rk AS (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY predicted) + (count(*) OVER (PARTITION BY asset, predicted) - 1) / 2.0 AS a, rank() OVER (PARTITION BY asset ORDER BY actual) + (count(*) OVER (PARTITION BY asset, actual) - 1) / 2.0 AS b FROM ev) SELECT asset, round(corr(a, b), 9) AS rho FROM rk GROUP BY 1")
def spearman(spark, d):
    return rounded(RS.spearman(_eval(spark, d), ["asset"], "predicted", "actual"), places=9)


@query("discrete_entropy", f"WITH {LR}, s AS (SELECT asset, min(ret) AS lo, max(ret) AS hi, count(*) AS n, 1 + floor(log2(count(*)) + 1e-12) AS k FROM lr WHERE ret IS NOT NULL GROUP BY 1), b AS (SELECT lr.asset, least(floor((ret - lo) * k / (hi - lo)), k - 1) AS bin, n FROM lr JOIN s ON s.asset = lr.asset WHERE ret IS NOT NULL), p AS (SELECT asset, bin, count(*) / max(n) AS p FROM b GROUP BY 1, 2) SELECT asset, round(-sum(p * ln(p)), 9) AS entropy FROM p GROUP BY 1")
def discrete_entropy(spark, d):
    return rounded(RS.entropy(_ret(spark, d), ["asset"], "ret"), places=9)


@query("gaussian_entropy", f"WITH {LR} SELECT asset, round(0.5 * ln(2 * pi() * exp(1) * var_pop(ret)), 9) AS entropy FROM lr GROUP BY 1")
def gaussian_entropy(spark, d):
    return rounded(RS.gaussian_entropy(_ret(spark, d), ["asset"], "ret"), places=9)


@query("amplification", f"WITH {_RV} SELECT asset, round(avg(CASE WHEN regime = 'HIGH' THEN abs(ret) END) / avg(abs(ret)), 9) AS amplification, round(least(1.0, 0.5 + 0.002 / (2 * avg(CASE WHEN regime = 'HIGH' THEN abs(ret) END))), 9) AS breakeven_da FROM rg GROUP BY 1")
def amplification(spark, d):
    return rounded(RS.amplification(_regimes(spark, d)), places=9)


_HR = f"{LR}, hr AS (SELECT asset || '_' || CAST(hour(timestamp) AS VARCHAR) AS feature, count(CASE WHEN timestamp < TIMESTAMP '2024-01-16' AND abs(ret) > 1 THEN 1 END) AS a, count(CASE WHEN timestamp >= TIMESTAMP '2024-01-16' AND abs(ret) > 1 THEN 1 END) AS b FROM lr GROUP BY 1)"


@query("holdout_retention", f"WITH {_HR}, t AS (SELECT feature, a >= 6 AS kept FROM hr), h AS (SELECT feature, b >= 6 AS held FROM hr) SELECT t.feature, kept, held, kept AND coalesce(held, false) AS retained FROM t LEFT JOIN h ON h.feature = t.feature")
def holdout_retention(spark, d):
    """Hours of an asset with six moves above 1 or more before the cut, and whether they have as many after it."""
    x = _ret(spark, d).withColumn("feature", F.concat_ws("_", "asset", F.hour("timestamp").cast("string")))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    part = lambda f: x.groupBy("feature").agg((F.count_if(f & (F.abs("ret") > 1)) >= 6).alias("kept"))
    return RS.retention(part(F.col("timestamp") < cut), part(F.col("timestamp") >= cut))


@query("melt_stats", f"WITH {FE} SELECT asset, name AS stat, round(value, 6) AS value FROM (SELECT asset, avg(close) AS mean_close, avg(volume) AS mean_volume, avg(rv) AS mean_rv FROM x GROUP BY 1) UNPIVOT (value FOR name IN (mean_close, mean_volume, mean_rv))")
def melt_stats(spark, d):
    x = _features(spark, d).groupBy("asset").agg(F.avg("close").alias("mean_close"), F.avg("volume").alias("mean_volume"), F.avg("rv").alias("mean_rv"))
    return rounded(x.unpivot(["asset"], ["mean_close", "mean_volume", "mean_rv"], "stat", "value"))


@query("argmin_per_group", f"WITH {C} SELECT asset, arg_min(timestamp, (close, timestamp)) AS at, min(close) AS lowest FROM c GROUP BY 1")
def argmin_per_group(spark, d):
    return candles(spark, d).groupBy("asset").agg(F.min_by("timestamp", F.struct("close", "timestamp")).alias("at"), F.min("close").alias("lowest"))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_vote", "WITH f AS (SELECT l_orderkey AS row, avg(l_discount * 10) AS p, max(CAST(l_quantity > 25 AS INT)) AS y FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN CAST(round(p, 9) > 0.5 AS INT) = y THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM f")
def dedup_vote(spark, d):
    x = table(spark, d, "lineitem")
    y = x.groupBy(F.col("l_orderkey").alias("row")).agg(F.max((F.col("l_quantity") > 25).cast("int")).alias("y"))
    f = x.select(F.col("l_orderkey").alias("row"), (F.col("l_discount") * 10).alias("p")).join(y, "row")
    return RS.dedup_vote(f).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 9).alias("accuracy"))




_FT = f"{FE}, ft AS (SELECT asset, rv, slope, volume, {', '.join(f'CASE WHEN {_lead("close", h)} > 0 AND close > 0 THEN ln({_lead("close", h)} / close) END AS fwd_{h}' for h in (1, 4, 24))} FROM x)"
_PAIRS = [(f, h) for f in ("rv", "slope", "volume") for h in (1, 4, 24)]
_FTC = _FT + ", fc AS (" + " UNION ALL ".join(f"SELECT asset, '{f}' AS feature, 'fwd_{h}' AS target, corr({f}, fwd_{h}) AS r FROM ft GROUP BY 1" for f, h in _PAIRS) + ")"


def _correlated(spark, d):
    x = _features(spark, d).withColumns({f"fwd_{h}": W.log_ratio(F.lead("close", h).over(W.ordered()), F.col("close")) for h in (1, 4, 24)})
    return RS.feature_target_correlations(x, ["rv", "slope", "volume"], ["fwd_1", "fwd_4", "fwd_24"], ["asset"])


@query("feature_target_corr", f"WITH {_FTC} SELECT asset, feature, target, round(r, 9) AS r FROM fc")
def feature_target_corr(spark, d):
    return rounded(_correlated(spark, d), places=9)


@query("horizon_summary", f"WITH {_FTC} SELECT target, count(r) AS n, round(avg(abs(r)), 9) AS mean_abs, round(max(abs(r)), 9) AS max_abs FROM fc GROUP BY 1")
def horizon_summary(spark, d):
    return rounded(RS.horizon_summary(_correlated(spark, d)), places=9)


@query("mi_table", f"WITH {_FTC}, m AS (SELECT *, -0.5 * ln(1 - r * r) AS mi FROM fc) SELECT asset, feature, target, round(r, 9) AS r, round(mi, 9) AS mi, CASE WHEN mi > 0.05 THEN 'strong' WHEN mi > 0.01 THEN 'moderate' WHEN mi > 0.001 THEN 'weak' ELSE 'negligible' END AS effect FROM m")
def mi_table(spark, d):
    return rounded(RS.mi_table(_correlated(spark, d)), places=9)


@query("stability_pivot", f"WITH {_FTC} SELECT concat(asset, '/', feature) AS series, " + ", ".join(f"round(max(CASE WHEN target = 'fwd_{h}' THEN r END), 9) AS fwd_{h}" for h in (1, 4, 24)) + " FROM fc GROUP BY 1")
def stability_pivot(spark, d):
    x = _correlated(spark, d).withColumn("series", F.concat_ws("/", "asset", "feature"))
    return rounded(RS.pivot(x, "series", "target", ["fwd_1", "fwd_4", "fwd_24"], "r"), places=9)


@query("flag_summary", f"WITH {_FTC}, s AS (SELECT feature, sum(CASE WHEN abs(r) > 0.02 THEN 1 ELSE 0 END)::BIGINT AS n_true, count(*) AS n FROM fc WHERE r IS NOT NULL GROUP BY 1) SELECT feature, n_true, n, round(n_true / n, 9) AS share, CASE WHEN n_true = n THEN 'universal' WHEN n_true = 0 THEN 'never' ELSE 'mixed' END AS kind FROM s")
def flag_summary(spark, d):
    x = _correlated(spark, d).filter("r IS NOT NULL").withColumn("flag", F.abs("r") > 0.02)
    return rounded(RS.flag_summary(x, "feature", "flag"), places=9)
