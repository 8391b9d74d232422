"""Queries over profiles, result tables, walk-forward runs and resampling; with DuckDB SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import backtest as BT
from ..operators import battery as BY
from ..operators import bars as B
from ..operators import cv as CV
from ..operators import forecast as FC
from ..operators import profiling as P
from ..operators import recommend as RC
from ..operators import research as RS
from ..operators import strategies as ST
from ..operators import walkforward as WF
from ..sources.tables import candles, table
from .analysis import _EV, _RV, LR, _eval, _regimes, _ret
from .market import C, T0, query, rounded
from .trading import FE, _features

# -- result tables -------------------------------------------------------------------------------------------------------

_NF = ("rv", "slope", "volume")
_MOM = "avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, (avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) / pow(var_pop({c}), 1.5) AS g, kurtosis_pop({c}) AS k"


@query("feature_distributions", f"WITH {FE}, m AS (" + " UNION ALL ".join(f"SELECT asset, '{c}' AS feature, count({c}) AS n, {_MOM.format(c=c)} FROM x WHERE {c} IS NOT NULL GROUP BY 1" for c in _NF) + ") SELECT asset, feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(sqrt(n * (n - 1.0)) / (n - 2) * g, 4) AS skew, round((n - 1) / ((n - 2.0) * (n - 3)) * ((n + 1) * k + 6), 4) AS kurtosis FROM m")
def feature_distributions(spark, d):
    x = RS.distributions(_features(spark, d).select("asset", *_NF), list(_NF), ["asset"])
    return x.select("asset", "feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "median", "q75")], *[F.round(c, 4).alias(c) for c in ("skew", "kurtosis")])


@query("feature_variances", f"WITH {FE} " + " UNION ALL ".join(f"SELECT asset, '{c}' AS feature, round(var_samp({c}), 6) AS variance, coalesce(var_samp({c}) < 1e-10, true) AS degenerate FROM x GROUP BY 1" for c in _NF))
def feature_variances(spark, d):
    return rounded(RS.variances(_features(spark, d).select("asset", *_NF), list(_NF), ["asset"]))


@query("weekly_variability", """WITH w AS (SELECT event_type AS bar_type, date_trunc('week', ts) AS m, count(*) AS n FROM events GROUP BY 1, 2) SELECT bar_type, count(*) AS n_weeks, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(stddev_samp(n) / avg(n), 9) AS cv FROM w GROUP BY 1""")
def weekly_variability(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("bar_type"), F.date_trunc("week", "ts").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    x = RS.weekly_variability(e)
    return x.select("bar_type", "n_weeks", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("cv", 9).alias("cv"))


@query("conditional_breakeven", f"WITH {_RV} SELECT asset, regime, count(ret) AS n, round(least(1.0, coalesce(0.5 + 0.002 / (2 * avg(abs(ret))), 1.0)), 9) AS breakeven_da FROM rg GROUP BY 1, 2")
def conditional_breakeven(spark, d):
    return rounded(RS.conditional_breakeven(_regimes(spark, d), ["asset"]), places=9)


@query("breakeven_grid", f"WITH {LR} SELECT asset, c AS cost_bps, round(least(1.0, 0.5 + c / 10000.0 / (2 * avg(abs(ret)))), 9) AS breakeven_da FROM lr, (VALUES (10), (15), (20), (25), (30)) t(c) GROUP BY 1, 2")
def breakeven_grid(spark, d):
    return rounded(RS.breakeven_grid(_ret(spark, d)), places=9)


@query("feasibility_table", f"WITH {LR}, b AS (SELECT asset, 0.5 + 0.02 / (2 * avg(abs(ret))) AS breakeven_da, 0.5 + 2.486475 / (2 * sqrt(count(ret))) AS mde_da FROM lr GROUP BY 1) SELECT asset, round(breakeven_da, 9) AS breakeven_da, round(mde_da, 9) AS mde_da, round(breakeven_da - mde_da, 9) AS gap, CASE WHEN breakeven_da - mde_da > 0.01 THEN 'feasible' WHEN breakeven_da - mde_da < -0.01 THEN 'underpowered' ELSE 'marginal' END AS status FROM b")
def feasibility_table(spark, d):
    x = _ret(spark, d).groupBy("asset").agg((0.5 + 0.02 / (2 * F.avg(F.abs("ret")))).alias("breakeven_da"), (0.5 + 2.486475 / (2 * F.sqrt(F.count("ret").cast("double")))).alias("mde_da"))
    return rounded(RS.feasibility(x), places=9)


_DM = "WITH f AS (SELECT l_returnflag AS asset, l_orderkey AS row, avg(l_discount * 10) AS p, max(CAST(l_quantity > 25 AS INT)) AS y FROM lineitem GROUP BY 1, 2), v AS (SELECT asset, CAST(round(p, 9) > 0.5 AS INT) AS vote, y FROM f), c AS (SELECT asset, count(*) AS n, sum(CASE WHEN vote = 1 AND y = 1 THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN vote = 1 AND y = 0 THEN 1.0 ELSE 0.0 END) AS fp, sum(CASE WHEN vote = 0 AND y = 1 THEN 1.0 ELSE 0.0 END) AS fn, sum(CASE WHEN vote = 0 AND y = 0 THEN 1.0 ELSE 0.0 END) AS tn FROM v GROUP BY 1)"


@query("dedup_metrics", _DM + " SELECT asset, n, round((tp + tn) / n, 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c")
def dedup_metrics(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("asset"), F.col("l_orderkey").alias("row"), (F.col("l_discount") * 10).alias("p"), (F.col("l_quantity") > 25).cast("int").alias("q"))
    y = x.groupBy("asset", "row").agg(F.max("q").alias("y"))
    return rounded(RS.dedup_metrics(x.drop("q").join(y, ["asset", "row"])), places=9)


@query("return_histogram", f"WITH {LR}, s AS (SELECT asset, min(ret) AS lo, (max(ret) - min(ret)) / 20 AS w FROM lr GROUP BY 1), b AS (SELECT lr.asset, lo, w, CAST(least(floor((ret - lo) / w), 19) AS INT) AS bin FROM lr JOIN s ON s.asset = lr.asset WHERE ret IS NOT NULL) SELECT asset, bin, round(lo + bin * w, 9) AS low, round(lo + (bin + 1) * w, 9) AS high, count(*) AS n FROM b GROUP BY asset, bin, lo, w")
def return_histogram(spark, d):
    return rounded(RS.histogram(_ret(spark, d), "ret", ["asset"], 20), places=9)


@query("price_boxes", f"WITH {C} SELECT asset, min(close) AS min, quantile_cont(close, 0.25) AS q25, quantile_cont(close, 0.5) AS median, quantile_cont(close, 0.75) AS q75, max(close) AS max FROM c GROUP BY 1")
def price_boxes(spark, d):
    return RS.boxes(candles(spark, d), "close", ["asset"])


_PE = "WITH pe AS (SELECT o_orderpriority AS asset, o_orderstatus AS bar_type, CAST(month(o_orderdate) % 4 + 3 AS INT) AS d, avg(o_totalprice) / 1e6 AS entropy, min(o_totalprice) / 1e6 AS complexity FROM orders GROUP BY 1, 2, 3)"


def _pe(spark, d):
    o = table(spark, d, "orders")
    by = [F.col("o_orderpriority").alias("asset"), F.col("o_orderstatus").alias("bar_type"), (F.month("o_orderdate") % 4 + 3).cast("int").alias("d")]
    return o.groupBy(*by).agg((F.avg("o_totalprice") / 1e6).alias("entropy"), (F.min("o_totalprice") / 1e6).alias("complexity"))


@query("pe_table", _PE + " SELECT asset, bar_type, " + ", ".join(f"round(max(CASE WHEN d = {k} THEN entropy END), 9) AS H_d{k}" for k in (3, 4, 5, 6)) + " FROM pe GROUP BY 1, 2")
def pe_table(spark, d):
    return rounded(RS.entropy_table(_pe(spark, d)), places=9)


@query("complexity_entropy", _PE + " SELECT asset, bar_type, round(entropy, 9) AS entropy, round(complexity, 9) AS complexity FROM pe WHERE d = 5")
def complexity_entropy(spark, d):
    return rounded(RS.complexity_entropy(_pe(spark, d)), places=9)


@query("entropy_reference", _PE + " SELECT asset, bar_type, round(entropy, 9) AS entropy, round(complexity, 9) AS complexity, r AS reference, round(entropy - r, 9) AS difference FROM pe LEFT JOIN (VALUES ('1-URGENT', 0.15::DOUBLE), ('2-HIGH', 0.14::DOUBLE)) t(a, r) ON asset = a WHERE d = 5")
def entropy_reference(spark, d):
    return rounded(RS.against_reference(_pe(spark, d), {"1-URGENT": 0.15, "2-HIGH": 0.14}), places=9)


_VD = "WITH v AS (SELECT p_brand AS feature, p_size || '' AS combo, CASE WHEN p_retailprice > 1500 THEN 'stationary' WHEN p_retailprice > 1300 THEN 'trend_stationary' WHEN p_retailprice > 1100 THEN 'unit_root' ELSE 'inconclusive' END AS verdict FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1)"


def _verdicts(spark, d):
    p = table(spark, d, "part")
    v = F.when(F.col("p_retailprice") > 1500, "stationary").when(F.col("p_retailprice") > 1300, "trend_stationary").when(F.col("p_retailprice") > 1100, "unit_root").otherwise("inconclusive")
    x = p.groupBy(F.col("p_brand").alias("feature"), F.col("p_size").cast("string").alias("combo")).agg(F.min_by(v, "p_partkey").alias("verdict"))
    return x


@query("stationarity_summary", _VD + ", s AS (SELECT feature, sum(CASE WHEN verdict = 'stationary' THEN 1 ELSE 0 END)::BIGINT AS n_true, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN verdict = '{k}' THEN 1.0 ELSE 0.0 END) * 100, 9) AS pct_{k}" for k in ("stationary", "trend_stationary", "unit_root", "inconclusive")) + " FROM v GROUP BY 1) SELECT *, round(n_true / n, 9) AS share, CASE WHEN n_true = n THEN 'universal' WHEN n_true = 0 THEN 'never' ELSE 'mixed' END AS kind FROM s")
def stationarity_summary(spark, d):
    return rounded(RS.stationarity_summary(_verdicts(spark, d)), places=9)


@query("stationarity_cross", _VD + " SELECT feature, " + ", ".join(f"coalesce(max(CASE WHEN combo = '{k}' THEN verdict END), 'missing') AS \"{k}\"" for k in (1, 7, 14)) + " FROM v GROUP BY 1")
def stationarity_cross(spark, d):
    return RS.stationarity_cross(_verdicts(spark, d), ["1", "7", "14"])


_RP = "WITH r AS (SELECT p_brand AS feature, CAST(p_size % 3 AS INT) AS horizon, avg(p_retailprice) / 3000 AS da, min(p_retailprice) / 3000 AS da_null, max(p_retailprice) / 1e5 AS mi FROM part GROUP BY 1, 2)"


def _report(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature"), (F.col("p_size") % 3).cast("int").alias("horizon"))
    return p.agg((F.avg("p_retailprice") / 3000).alias("da"), (F.min("p_retailprice") / 3000).alias("da_null"), (F.max("p_retailprice") / 1e5).alias("mi"))


@query("da_table", _RP + " SELECT feature, horizon, round(da, 9) AS da, round(da_null, 9) AS da_null, round(mi, 9) AS mi, round((da - da_null) * 100, 6) AS excess_pp FROM r")
def da_table(spark, d):
    x = RS.da_table(_report(spark, d))
    return x.select("feature", "horizon", *[F.round(c, 9).alias(c) for c in ("da", "da_null", "mi")], F.round("excess_pp", 6).alias("excess_pp"))


@query("cross_bar_comparison", _RP + " SELECT feature, " + ", ".join(f"round(max(CASE WHEN horizon = {h} THEN mi END), 9) AS \"{h}\"" for h in (0, 1, 2)) + " FROM r GROUP BY 1")
def cross_bar_comparison(spark, d):
    return rounded(RS.cross_bars(_report(spark, d).withColumn("bar_type", F.col("horizon").cast("string")), ["0", "1", "2"]), places=9)


@query("multi_horizon", _RP + " SELECT feature, " + ", ".join(f"round(max(CASE WHEN horizon = {h} THEN {v} END), 9) AS \"{h}_{v}\"" for h in (0, 1, 2) for v in ("mi", "da")) + " FROM r GROUP BY 1")
def multi_horizon(spark, d):
    return rounded(RS.horizons(_report(spark, d), [0, 1, 2]), places=9)


# -- forecasts ---------------------------------------------------------------------------------------------------------

_SIDES = {"clf_only": "pred", "reg_only": "sign(predicted - 0.01)", "combined": "CASE WHEN sign(pred) = sign(predicted - 0.01) THEN pred ELSE 0 END"}


@query("pnl_variants", f"WITH {_EV}, p AS (" + " UNION ALL ".join(f"SELECT asset, timestamp, actual, '{k}' AS variant, CAST({e} AS DOUBLE) AS pos FROM ev" for k, e in _SIDES.items()) + "), n AS (SELECT asset, variant, pos * actual - 0.001 * abs(pos - lag(pos, 1, 0.0) OVER (PARTITION BY asset, variant ORDER BY timestamp)) AS net FROM p) SELECT asset, variant, round(avg(net), 6) AS mean, round(stddev_samp(net), 6) AS std, round(sum(net), 6) AS total FROM n GROUP BY 1, 2")
def pnl_variants(spark, d):
    return rounded(FC.pnl_variants(_eval(spark, d).withColumns({"clf": F.col("pred").cast("double"), "reg": F.col("predicted") - 0.01})))


@query("naive_regressors", f"WITH {_EV}, w AS (SELECT asset, actual, pow({1 - 2 / 21!r}, row_number() OVER (PARTITION BY asset ORDER BY timestamp DESC) - 1) AS w FROM ev) SELECT asset, 0.0::DOUBLE AS random_walk, round(sum(w * actual) / sum(w), 6) AS ewma, round(avg(actual), 6) AS hist_mean FROM w GROUP BY 1")
def naive_regressors(spark, d):
    return rounded(FC.naive_regressors(_eval(spark, d)))


@query("breusch_pagan", f"WITH {_EV}, e AS (SELECT asset, actual - predicted AS e, predicted AS p FROM ev), b AS (SELECT asset, avg(e) AS mean, stddev_samp(e) AS std, count(*) * regr_r2(e * e, p) AS bp FROM e GROUP BY 1) SELECT asset, round(mean, 6) AS mean, round(std, 6) AS std, round(bp, 6) AS bp FROM b")
def breusch_pagan(spark, d):
    x = _eval(spark, d).withColumn("e", F.col("actual") - F.col("predicted"))
    return rounded(FC.breusch_pagan(x, ["asset"], "e", "predicted").select("asset", "mean", "std", "bp"))


@query("residual_diagnostics")
def residual_diagnostics(spark, d):
    return rounded(FC.residual_diagnostics(_eval(spark, d).withColumn("e", F.col("actual") - F.col("predicted")), "e", "predicted"))


@query("bootstrap_da")
def bootstrap_da(spark, d):
    return rounded(FC.bootstrap_accuracy(_eval(spark, d), ["asset"]))


@query("shuffled_labels")
def shuffled_labels(spark, d):
    from ..operators import models as MD

    x = _eval(spark, d).filter("vol IS NOT NULL").select("asset", "timestamp", "y", "predicted", "vol")
    cut = F.lit("2024-01-22").cast("timestamp_ntz")
    return rounded(FC.shuffled_labels(x.filter(F.col("timestamp") < cut), x.filter(F.col("timestamp") >= cut), ["predicted", "vol"], lambda a, b, n: MD.classify(a, b, n)))


_PT = f"""WITH {C}, p AS (SELECT asset, timestamp, row_number() OVER ({T0}) - 1 AS pos FROM c), f AS (SELECT *, CASE WHEN pos BETWEEN 100 AND 199 OR pos BETWEEN 300 AND 349 THEN 'test' ELSE 'train' END AS part, epoch_us(timestamp) / 1e6 AS t FROM p),
g AS (SELECT asset, t, t - lag(t) OVER (PARTITION BY asset ORDER BY t) AS gap FROM f WHERE part = 'test'), m AS (SELECT asset, quantile_cont(gap, 0.5) AS m FROM g GROUP BY 1),
s AS (SELECT g.asset, t, sum(CASE WHEN gap > 2 * m THEN 1 ELSE 0 END) OVER (PARTITION BY g.asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g JOIN m ON m.asset = g.asset), b AS (SELECT asset, s, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1, 2)
SELECT asset, pos, CASE WHEN part = 'train' AND EXISTS (SELECT 1 FROM b WHERE b.asset = f.asset AND f.t BETWEEN lo - 7200 AND hi + 7200) THEN 'purged' ELSE part END AS part FROM f"""


@query("purge_by_time", _PT)
def purge_by_time(spark, d):
    x = CV.positioned(candles(spark, d).select("asset", "timestamp"))
    test = F.col("pos").between(100, 199) | F.col("pos").between(300, 349)
    x = x.withColumns({"fold": F.lit(0), "part": F.when(test, "test").otherwise("train")})
    return CV.purge_by_time(x, 7200.0).select("asset", F.col("pos").cast("long").alias("pos"), "part")


# -- walk-forward --------------------------------------------------------------------------------------------------------

#: Buy and hold in each window: a share f of the cash enters at the second live bar's open, leaves at the last close.
_WF = f"""WITH {C}, p AS (SELECT *, row_number() OVER ({T0}) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n, epoch_us(timestamp) / 1e6 AS sec FROM c),
w AS (SELECT p.*, w FROM p, range(0, 1000) t(w) WHERE pos >= 60 + w * 30 AND pos < 90 + w * 30 AND 90 + w * 30 <= n),
g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY asset, w ORDER BY pos) AS gap FROM w),
st AS (SELECT asset, w, 2 * list(gap ORDER BY gap)[CAST(floor(count(gap) / 2) AS INT) + 1] AS stale, arg_max(close, pos) AS last_close, max(timestamp) AS last_ts FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
k AS (SELECT g.*, last_close, last_ts, row_number() OVER (PARTITION BY g.asset, g.w ORDER BY pos) AS seq FROM g JOIN st ON st.asset = g.asset AND st.w = g.w WHERE gap IS NULL OR gap <= stale),
e AS (SELECT asset, w, open AS entry FROM k WHERE seq = 2),
v AS (SELECT k.asset, k.w, k.timestamp, last_ts, seq, max(seq) OVER (PARTITION BY k.asset, k.w) AS top, CASE WHEN seq = 1 THEN 1.0 ELSE 1 - 0.9 * 1.001 + 0.9 * close / entry END AS h, 1 - 0.9 * 1.001 + 0.9 * last_close / entry * 0.999 AS gain FROM k JOIN e ON e.asset = k.asset AND e.w = k.w),
gn AS (SELECT DISTINCT asset, w, gain FROM v), cs AS (SELECT asset, w, 100000.0::DOUBLE * coalesce(exp(sum(ln(gain)) OVER (PARTITION BY asset ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS cash FROM gn)
SELECT v.asset, CASE WHEN seq = top THEN last_ts ELSE timestamp END AS timestamp, round(cash * CASE WHEN seq = top THEN gain ELSE h END, 2) AS equity FROM v JOIN cs ON cs.asset = v.asset AND cs.w = v.w"""


def _ohlc(spark, d):
    return candles(spark, d).select("asset", "timestamp", "open", "high", "low", "close")


@query("walk_forward_equity", _WF)
def walk_forward_equity(spark, d):
    curve = WF.walk_forward(_ohlc(spark, d), lambda train: BT.buy_and_hold, 60, 30, size=BT.fixed_fraction(0.9))
    return rounded(WF.chained(curve), places=2)


@query("walk_forward_trades")
def walk_forward_trades(spark, d):
    return rounded(WF.walk_forward(_ohlc(spark, d), WF.momentum, 60, 30, size=BT.fixed_fraction(0.9), trades=True))


# -- profiles --------------------------------------------------------------------------------------------------------------


def _series(spark, d):
    """Returns of hourly time bars and of volume bars."""
    hours = _ret(spark, d).select("asset", F.lit("time_1h").alias("bar_type"), "timestamp", "ret")
    v = B.standard_bars(candles(spark, d), "volume", 5000.0).select("asset", F.col("start_ts").alias("timestamp"), "close")
    volume = v.select("asset", F.lit("volume").alias("bar_type"), "timestamp", W.log_ratio(F.col("close"), W.lag("close")).alias("ret"))
    return hours.unionByName(volume)


@query("profile_all")
def profile_all(spark, d):
    return rounded(BY.profile_all(_series(spark, d)))


@query("profile_corrected")
def profile_corrected(spark, d):
    return rounded(BY.corrected(BY.profile_all(_series(spark, d))), places=9)


@query("qq_normal", f"WITH {LR}, o AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ret) AS i, count(*) OVER (PARTITION BY asset) AS n FROM lr WHERE ret IS NOT NULL) SELECT asset, round(CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END, 9) AS p, round(ret, 9) AS ordered FROM o")
def qq_normal(spark, d):
    return rounded(P.qq(_ret(spark, d)).select("asset", "p", "ordered"), places=9)


@query("model_gru")
def model_gru(spark, d):
    """Directions and returns of each asset's last rows by small recurrent networks (two layers of 16 units, 8 epochs)."""
    from ..operators.recurrent import recurrent_forecast

    x = _eval(spark, d).filter("vol IS NOT NULL").select("asset", "timestamp", "predicted", "vol", "actual", "y")
    make = lambda target, classes: recurrent_forecast(x, ["predicted", "vol"], target, classes, steps=12, hidden=16, epochs=8, passes=20)
    side = make("y", True).select("asset", "timestamp", F.col("pred").cast("int").alias("direction"), F.col("spread").alias("confidence"))
    return rounded(side.join(make("actual", False), ["asset", "timestamp"]))


# -- recommendations -------------------------------------------------------------------------------------------------------

RECO = ["volatility", "momentum", "rolling_strategy_sharpe", "rolling_win_rate"]


@query("reco_pipeline")
def reco_pipeline(spark, d):
    """Walk-forward recommendations of every asset: momentum signals, market and strategy features, boosted and random ones; three windows with 10 rows between their parts."""
    x = _features(spark, d).select("asset", "timestamp", "close", F.col("rv").alias("volatility"), F.col("slope").alias("momentum"), F.col("__lr").alias("ret"))
    bars = x.select("asset", "timestamp", "close")
    signals = ST.momentum(_features(spark, d), "slope", 0.1).select("asset", "timestamp", "side", "strength")
    strategy = x.select("asset", "timestamp", (F.signum(F.coalesce("momentum", F.lit(0.0))) * F.coalesce("ret", F.lit(0.0))).alias("strategy_return"))
    made = lambda s: RC.strategy_features(s).drop("strategy_return")
    return rounded(RC.run(bars, signals, x.drop("close", "ret"), {"strategy": (strategy, made)}, RECO, windows=3, purge=7, embargo=3))


@query("reco_run_metrics")
def reco_run_metrics(spark, d):
    got = reco_pipeline(spark, d).withColumn("asset", F.concat_ws("/", "asset", "recommender"))
    return rounded(RC.recommendation_metrics(got))
