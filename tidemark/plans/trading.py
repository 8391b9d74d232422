"""Queries over signals, labels, backtests, performance and splits; each with its DuckDB SQL where that can say it."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import backtest as BT
from ..operators import cv as CV
from ..operators import indicators as I
from ..operators import metrics as M
from ..operators import recommend as RC
from ..operators import strategies as ST
from ..sources.tables import candles
from .market import C, R, T0, _lead, _roll, query, rounded

#: Candles with the plain-window features that the strategies read (the trailing mean range stands for the ATR).
FE = R + f", x AS (SELECT *, {_roll('avg(tr)', 'tr', 14)} AS atr, {_roll('stddev_samp(lr)', 'lr', 24)} AS rv, {_roll('regr_slope(close, rn)', 'close', 14)} AS slope FROM r)"


def _features(spark, d) -> DataFrame:
    s = I.with_steps(candles(spark, d))
    return s.withColumns({"atr": W.mean("__tr", 14), "rv": W.std("__lr", 24), "slope": W.slope(F.col("close"), F.col("__rn"), 14)})


def _sig(df: DataFrame) -> DataFrame:
    return df.select("asset", "timestamp", "side", F.round("strength", 9).alias("strength"))


def _clip01(e: str) -> str:
    return f"CASE WHEN ({e}) IS NOT NULL THEN greatest(0.0, least(1.0, {e})) END"


_TOP = f"CASE WHEN count(h1) OVER ({T0} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN max(h1) OVER ({T0} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END"


@query("sig_donchian", f"WITH {FE}, h AS (SELECT *, lag(high) OVER ({T0}) AS h1 FROM x), d AS (SELECT *, {_TOP} AS top FROM h) SELECT asset, timestamp, CASE WHEN close > top THEN 'long' ELSE 'flat' END AS side, round(CASE WHEN close > top THEN {_clip01('(close - top) / (atr + 1e-12)')} ELSE 0.0 END, 9) AS strength FROM d")
def sig_donchian(spark, d):
    return _sig(ST.donchian(_features(spark, d), atr="atr"))


_MR = f"WITH {FE}, b AS (SELECT *, {_roll('avg(close)', 'close', 20)} - 1.5 * {_roll('stddev_samp(close)', 'close', 20)} AS lo, {_roll('avg(close)', 'close', 20)} + 1.5 * {_roll('stddev_samp(close)', 'close', 20)} AS hi FROM x)"


@query("sig_mean_reversion", _MR + f""" SELECT asset, timestamp, CASE WHEN rv < 2.0 AND close < lo THEN 'long' WHEN rv < 2.0 AND close > hi THEN 'short' ELSE 'flat' END AS side,
 round(CASE WHEN rv < 2.0 AND close < lo THEN {_clip01('(lo - close) / (hi - lo + 1e-12)')} WHEN rv < 2.0 AND close > hi THEN {_clip01('(close - hi) / (hi - lo + 1e-12)')} ELSE 0.0 END, 9) AS strength FROM b""")
def sig_mean_reversion(spark, d):
    return _sig(ST.mean_reversion(_features(spark, d), k=1.5, regime="rv", limit=2.0))


@query("sig_momentum", f"WITH {FE} SELECT asset, timestamp, CASE WHEN slope > 0.1 THEN 'long' WHEN slope < -0.1 THEN 'short' ELSE 'flat' END AS side, round(CASE WHEN abs(slope) > 0.1 THEN {_clip01('abs(slope)')} ELSE 0.0 END, 9) AS strength FROM x")
def sig_momentum(spark, d):
    return _sig(ST.momentum(_features(spark, d), "slope", 0.1))


@query("sig_no_trade", f"WITH {FE} SELECT asset, timestamp, 'flat' AS side, CASE WHEN rv < 1.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strength FROM x")
def sig_no_trade(spark, d):
    return _sig(ST.no_trade(_features(spark, d), 0.5, "rv", low_vol=1.8))


@query("sig_vol_target", f"WITH {FE} SELECT asset, timestamp, 'long' AS side, round({_clip01('0.15 / (rv + 1e-12)')}, 9) AS strength FROM x")
def sig_vol_target(spark, d):
    return _sig(ST.vol_target(_features(spark, d), column="rv"))


@query("labels_fixed_horizon", f"""WITH {FE}, f AS (SELECT *, {_lead('close', 7)} AS later FROM x)
SELECT asset, timestamp, side, round(CASE WHEN side = 'long' THEN later / close - 1 ELSE -(later / close - 1) END - 0.002, 9) AS strategy_return, 7::BIGINT AS horizon
FROM (SELECT *, CASE WHEN slope > 0.1 THEN 'long' WHEN slope < -0.1 THEN 'short' ELSE 'flat' END AS side FROM f) WHERE side <> 'flat'""")
def labels_fixed_horizon(spark, d):
    x = _features(spark, d)
    got = RC.labels(x, ST.momentum(x, "slope", 0.1))
    return rounded(got.select("asset", "timestamp", "side", "strategy_return", F.col("horizon").cast("long").alias("horizon")), places=9)


_PREV = "lag(close) OVER (" + T0 + ")"
#: Stand-ins for model outputs: direction and confidence from the slope, return forecast from the last return.
_OUT = FE + f""", o AS (SELECT *, sign(slope) AS clf_direction, abs(slope) / (1 + abs(slope)) AS clf_confidence, CASE WHEN lr IS NOT NULL AND slope IS NOT NULL THEN sign(lr) = sign(slope) END AS clf_correct,
 lr AS reg_predicted_return, rv AS vol_predicted, abs(lr) + 0.01 AS vol_actual, close / {_PREV} - 1 AS ret FROM x)"""


def _outputs(spark, d):
    x = _features(spark, d)
    return x.withColumns({
        "clf_direction": F.signum("slope"), "clf_confidence": F.abs("slope") / (1 + F.abs("slope")), "clf_correct": F.signum("__lr") == F.signum("slope"),
        "reg_predicted_return": F.col("__lr"), "vol_predicted": F.col("rv"), "vol_actual": F.abs("__lr") + 0.01, "ret": F.try_divide("close", W.lag("close")) - 1,
    })


def _rol(e: str, n: int, least: int, agg: str = "avg") -> str:
    w = f"OVER ({T0} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({e}) {w} >= {least} THEN {agg}({e}) {w} END"


_QL = "CASE WHEN vol_predicted > 0 THEN vol_predicted / vol_actual - ln(vol_predicted / vol_actual) - 1.0 END"


@query("reco_features", _OUT + f""" SELECT asset, timestamp, round({_rol('CAST(CAST(clf_correct AS INT) AS DOUBLE)', 20, 1)}, 9) AS clf_rolling_accuracy,
 round({_rol('vol_predicted - vol_actual', 20, 1)}, 9) AS vol_error_trend, round({_rol(_QL, 20, 1)}, 9) AS vol_qlike_residual,
 CASE WHEN (clf_direction > 0 AND reg_predicted_return > 0) OR (clf_direction < 0 AND reg_predicted_return < 0) THEN 1 ELSE 0 END AS forecast_agreement,
 round(abs(reg_predicted_return) * clf_confidence, 9) AS conviction_score,
 CASE WHEN vol_predicted > avg(vol_predicted) OVER (PARTITION BY asset) + stddev_samp(vol_predicted) OVER (PARTITION BY asset) THEN 1 ELSE 0 END AS vol_regime FROM o""")
def reco_features(spark, d):
    o = _outputs(spark, d)
    key = ["asset", "timestamp"]
    clf = RC.classifier_features(o.select(*key, "clf_direction", "clf_confidence", "clf_correct"))
    reg = o.select(*key, "reg_predicted_return")
    vol = RC.vol_features(o.select(*key, "vol_predicted", "vol_actual"))
    x = RC.vol_regime(RC.combined_features(RC.features(o.select(*key, "close"), clf=clf, reg=reg, vol=vol)))
    return rounded(x.select(*key, "clf_rolling_accuracy", "vol_error_trend", "vol_qlike_residual", "forecast_agreement", "conviction_score", "vol_regime"), places=9)


from .market import SQL  # noqa: E402

SQL["reco_features"] = "WITH " + SQL["reco_features"]


@query("reco_strategy_features", "WITH " + _OUT + f" SELECT asset, timestamp, round(CASE WHEN ({_rol('ret', 20, 2, 'stddev_samp')}) > 0 THEN ({_rol('ret', 20, 2)}) / ({_rol('ret', 20, 2, 'stddev_samp')}) ELSE 0.0 END, 9) AS rolling_strategy_sharpe, round({_rol('CAST(CAST(ret > 0 AS INT) AS DOUBLE)', 20, 1)}, 9) AS rolling_win_rate FROM o")
def reco_strategy_features(spark, d):
    o = _outputs(spark, d).select("asset", "timestamp", F.col("ret").alias("strategy_return"))
    return rounded(RC.strategy_features(o).select("asset", "timestamp", "rolling_strategy_sharpe", "rolling_win_rate"), places=9)


_PAIR = f"""WITH {C}, s AS (SELECT asset, timestamp, close / {_PREV} - 1 AS ret FROM c), b AS (SELECT timestamp, ret AS btc FROM s WHERE asset = 'purchase'),
j AS (SELECT s.asset, s.timestamp, s.ret AS a, b.btc AS b FROM s LEFT JOIN b ON b.timestamp = s.timestamp WHERE s.asset <> 'purchase'),
p AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS pa, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS pb FROM j)"""
_W20 = f"OVER ({T0} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("rolling_corr_beta", _PAIR + f""" SELECT asset, timestamp, round(CASE WHEN count(pa) {_W20} >= 2 AND var_pop(pa) {_W20} > 1e-18 AND var_pop(pb) {_W20} > 1e-18 THEN corr(pa, pb) {_W20} END, 6) AS rolling_cross_corr,
 round(CASE WHEN ({_rol('b', 20, 2, 'var_samp')}) > 0 THEN (({_rol('a * b', 20, 2)}) - ({_rol('a', 20, 2)}) * ({_rol('b', 20, 2)})) / ({_rol('b', 20, 2, 'var_samp')}) ELSE 0.0 END, 6) AS btc_beta FROM p""")
def rolling_corr_beta(spark, d):
    s = candles(spark, d).select("asset", "timestamp", (F.try_divide("close", W.lag("close")) - 1).alias("asset_return"))
    b = s.filter("asset = 'purchase'").select("timestamp", F.col("asset_return").alias("btc_return"))
    x = s.filter("asset <> 'purchase'").join(b, "timestamp", "left")
    return rounded(RC.corr_beta(x).select("asset", "timestamp", "rolling_cross_corr", "btc_beta"))


_RANK = "CASE WHEN count(ret) OVER w2 >= 3 THEN concat(CAST((b < a) AS INT) + CAST((c3 < a) AS INT), CAST((a <= b) AS INT) + CAST((c3 < b) AS INT), CAST((a <= c3) AS INT) + CAST((b <= c3) AS INT)) END"
_PATS = ("012", "021", "102", "120", "201", "210")
_W18 = f"OVER ({T0} ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)"
_SHARE = [f"(sum(CASE WHEN p = '{p}' THEN 1 ELSE 0 END) {_W18}) / CAST(nullif(count(p) {_W18}, 0) AS DOUBLE)" for p in _PATS]
_ENT = "0.0" + "".join(f" - CASE WHEN {s} > 0 THEN ({s}) * ln({s}) ELSE 0.0 END" for s in _SHARE)


@query("rolling_perm_entropy", f"""WITH {C}, s AS (SELECT asset, timestamp, close / {_PREV} - 1 AS ret FROM c),
l AS (SELECT *, lag(ret, 2) OVER ({T0}) AS a, lag(ret, 1) OVER ({T0}) AS b, ret AS c3 FROM s),
q AS (SELECT *, {_RANK} AS p FROM l WINDOW w2 AS ({T0} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT asset, timestamp, round(CASE WHEN count(ret) {_W20} >= 20 THEN ({_ENT}) / {log(6)!r} END, 9) AS rolling_perm_entropy FROM q""")
def rolling_perm_entropy(spark, d):
    s = candles(spark, d).select("asset", "timestamp", (F.try_divide("close", W.lag("close")) - 1).alias("ret"))
    return rounded(RC.rolling_entropy(s).select("asset", "timestamp", "rolling_perm_entropy"), places=9)


@query("relative_strength", f"WITH {C}, s AS (SELECT *, close / {_PREV} - 1 AS ret FROM c), u AS (SELECT timestamp, avg(ret) AS m FROM s GROUP BY 1) SELECT asset, s.timestamp, round(ret - m, 9) AS relative_strength FROM s LEFT JOIN u ON u.timestamp = s.timestamp")
def relative_strength(spark, d):
    c = candles(spark, d)
    s = c.withColumn("ret", F.try_divide("close", W.lag("close")) - 1)
    u = s.groupBy("timestamp").agg(F.avg("ret").alias("universe_mean_return"))
    return rounded(RC.relative_strength(c.join(u, "timestamp", "left")).select("asset", "timestamp", "relative_strength"), places=9)


_DEP = f"WITH {FE}, p AS (SELECT asset, timestamp, slope AS pred, stddev_samp(slope) OVER (PARTITION BY asset) AS sigma, {_lead('close', 1)} / close - 1 AS actual FROM x)"
_SIZES = {
    "all_assets": ("true", "1.0"),
    "classifier_only": ("abs(pred) > 0.05", "least(coalesce(abs(pred) / nullif(sigma, 0), 0.0), 1.0)"),
    "regressor_only": ("pred > 0.05", "least(greatest(coalesce((pred - 0.05) / nullif(sigma, 0), 0.0), 0.0), 1.0)"),
    "equal_weight": ("pred > 0.05", "coalesce(1.0 / nullif(sum(CAST(pred > 0.05 AS INT)) OVER (PARTITION BY asset), 0), 0.0)"),
}


def _predictions(spark, d):
    x = _features(spark, d).select("asset", "timestamp", F.col("slope").alias("pred"), (F.try_divide(W.lead("close", 1), F.col("close")) - 1).alias("actual"))
    return x.withColumn("sigma", F.stddev_samp("pred").over(W.whole()))


@query("reco_baselines", _DEP + " SELECT asset, timestamp, " + ", ".join(f"round(CASE WHEN {g} THEN {s} ELSE 0.0 END, 9) AS size_{k}" for k, (g, s) in _SIZES.items()) + " FROM p")
def reco_baselines(spark, d):
    p = _predictions(spark, d)
    for k in _SIZES:
        p = RC.deploy(p, k, 0.0 if k == "all_assets" else 0.05).withColumnRenamed("size", f"size_{k}").drop("deploy")
    return rounded(p.select("asset", "timestamp", *[f"size_{k}" for k in _SIZES]), places=9)


_RG, _RS = _SIZES["regressor_only"]


@query("reco_metrics", _DEP + f""", s AS (SELECT *, {_RG} AS deploy, CASE WHEN {_RG} THEN {_RS} ELSE 0.0 END AS size FROM p)
SELECT asset, round(avg(CAST(CAST(deploy AS INT) AS DOUBLE)), 9) AS deploy_rate, round(avg(CASE WHEN deploy THEN CAST(CAST(actual > 0 AS INT) AS DOUBLE) END), 9) AS deploy_precision, round(avg(CASE WHEN deploy THEN actual END), 6) AS mean_deployed,
 round(sum(ln(1 + CASE WHEN size * actual IS NOT NULL THEN greatest(size * actual, -0.999999) END)), 6) AS log_growth FROM s GROUP BY 1""")
def reco_metrics(spark, d):
    m = RC.recommendation_metrics(RC.deploy(_predictions(spark, d), "regressor_only", 0.05))
    return rounded(m.select("asset", "deploy_rate", "deploy_precision", F.round("mean_deployed", 6).alias("mean_deployed"), F.round("log_growth", 6).alias("log_growth")), places=9)


@query("conformal_split", _DEP + """, ab AS (SELECT asset, abs(actual - pred) AS r FROM p WHERE actual - pred IS NOT NULL), n AS (SELECT asset, list(r ORDER BY r) AS v, count(*) AS n FROM ab GROUP BY 1), a AS (SELECT *, least(1.0, 0.9 * (1 + 1.0::DOUBLE / n)) * (n - 1) AS x0 FROM n)
SELECT asset, round(v[CAST(floor(x0) AS INT) + 1] + (x0 - floor(x0)) * (v[least(CAST(floor(x0) AS INT) + 2, n)] - v[CAST(floor(x0) AS INT) + 1]), 9) AS q FROM a""")
def conformal_split(spark, d):
    return rounded(RC.conformal_quantile(_predictions(spark, d), F.col("actual") - F.col("pred")), places=9)


# -- backtest -----------------------------------------------------------------------------------------------------


def _signalled(spark, d):
    return ST.momentum(_features(spark, d), "slope", 0.1).select("asset", "timestamp", "open", "high", "low", "close", "side", "strength")


_BH = f"""WITH RECURSIVE {C}, g AS (SELECT *, row_number() OVER ({T0}) AS rn, epoch_us(timestamp) / 1e6 AS sec, lag(epoch_us(timestamp) / 1e6) OVER ({T0}) AS psec FROM c),
m AS (SELECT asset, 2 * list(sec - psec ORDER BY sec - psec)[CAST(floor(count(sec - psec) / 2) AS INT) + 1] AS stale, max(rn) AS n FROM g WHERE psec IS NOT NULL GROUP BY 1),
k AS (SELECT g.*, n, ROW_NUMBER() OVER (PARTITION BY g.asset ORDER BY g.rn) AS seq FROM g JOIN m ON g.asset = m.asset WHERE psec IS NULL OR sec - psec <= stale),
e AS (SELECT k.asset, k.open AS entry FROM k WHERE seq = 2),
z AS (SELECT asset, arg_max(close, rn) AS last_close FROM g GROUP BY 1),
v AS (SELECT k.asset, k.timestamp, k.seq, k.close, entry, 100000.0::DOUBLE * 0.99 / entry AS units, last_close, max(k.seq) OVER (PARTITION BY k.asset) AS last_seq FROM k JOIN e ON e.asset = k.asset JOIN z ON z.asset = k.asset)
SELECT asset, 10.0::DOUBLE AS fee_bps, timestamp, round(CASE WHEN seq = 1 THEN 100000.0 WHEN seq = last_seq THEN 100000.0 - entry * units * 1.001 + last_close * units - last_close * units * 0.001
 ELSE greatest(0.0, 100000.0 - entry * units * 1.001 + close * units) END, 4) AS equity FROM v"""


@query("backtest_equity", _BH)
def backtest_equity(spark, d):
    bars = candles(spark, d).select("asset", "timestamp", "open", "high", "low", "close")
    got = BT.run(bars, strategy=lambda: BT.buy_and_hold, size=BT.fixed_fraction(0.99))
    return rounded(got.select("asset", "fee_bps", "timestamp", "equity"), places=4)


@query("backtest_trades")
def backtest_trades(spark, d):
    return rounded(BT.run(_signalled(spark, d), trades=True, size=BT.fixed_fraction(0.5)))


@query("backtest_random")
def backtest_random(spark, d):
    return rounded(BT.run(_signalled(spark, d), strategy=lambda: BT.random_side(), size=BT.fixed_fraction(0.5)))


@query("cost_sweep")
def cost_sweep(spark, d):
    return rounded(BT.cost_sweep(_signalled(spark, d), size=BT.fixed_fraction(0.5)))


# -- performance of a curve (the close) -----------------------------------------------------------------------------


def _curve(spark, d):
    return candles(spark, d).select("asset", "timestamp", F.col("close").alias("equity"))


E = f"{C}, e AS (SELECT asset, timestamp, close AS equity, close / {_PREV} - 1 AS ret, max(close) OVER ({T0} ROWS UNBOUNDED PRECEDING) AS top FROM c)"


@query("perf_returns", f"WITH {E} SELECT asset, timestamp, round(ret, 9) AS ret FROM e")
def perf_returns(spark, d):
    return rounded(M.with_returns(_curve(spark, d)).select("asset", "timestamp", "ret"), places=9)


@query("perf_drawdown", f"WITH {E} SELECT asset, timestamp, round((equity - top) / top, 9) AS drawdown FROM e")
def perf_drawdown(spark, d):
    return rounded(M.drawdowns(_curve(spark, d)).select("asset", "timestamp", "drawdown"), places=9)


@query("perf_drawdown_duration", f"""WITH {E}, u AS (SELECT *, sum(CASE WHEN equity < top THEN 0 ELSE 1 END) OVER ({T0} ROWS UNBOUNDED PRECEDING) AS island, lead(timestamp) OVER ({T0}) AS nxt FROM e),
s AS (SELECT asset, island, min(timestamp) AS a, max(coalesce(nxt, timestamp)) AS b FROM u WHERE equity < top GROUP BY 1, 2)
SELECT asset, round(max((epoch_us(b) - epoch_us(a)) / 86400e6), 9) AS max_dd_days FROM s GROUP BY 1""")
def perf_drawdown_duration(spark, d):
    return rounded(M.longest_drawdown(_curve(spark, d)), places=9)


@query("perf_streaks", f"""WITH {E}, w AS (SELECT *, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) OVER ({T0} ROWS UNBOUNDED PRECEDING) AS island FROM e WHERE ret IS NOT NULL)
SELECT asset, max(n) AS max_losses FROM (SELECT asset, island, count(CASE WHEN NOT ret > 0 THEN 1 END) AS n FROM w GROUP BY 1, 2) GROUP BY 1""")
def perf_streaks(spark, d):
    r = M.with_returns(_curve(spark, d)).filter("ret IS NOT NULL")
    return M.longest_losing_streak(r, "ret")


_LO = f"""{E}, dm AS (SELECT *, ret - avg(ret) OVER (PARTITION BY asset) AS dev FROM e WHERE ret IS NOT NULL), l AS (SELECT *, {', '.join(f'dev * lag(dev, {k}) OVER ({T0}) AS p{k}' for k in range(1, 7))} FROM dm),
lo AS (SELECT asset, 6 + 2 * ({' + '.join(f'{6 - k} * sum(p{k})' for k in range(1, 7))}) / nullif(sum(dev * dev), 0) AS den FROM l GROUP BY 1)"""


@query("perf_lo_factor", f"WITH {_LO} SELECT asset, round(CASE WHEN den > 0 THEN sqrt(6.0 / den) END, 9) AS eta FROM lo")
def perf_lo_factor(spark, d):
    return rounded(M.lo_factor(M.with_returns(_curve(spark, d))), places=9)


@query("perf_ratios", f"""WITH {_LO}, gp AS (SELECT asset, epoch_us(timestamp) / 1e6 - lag(epoch_us(timestamp) / 1e6) OVER ({T0}) AS gap FROM c), pp AS (SELECT asset, 31557600.0 / quantile_cont(gap, 0.5) AS ppy FROM gp GROUP BY 1),
a AS (SELECT asset, arg_min(equity, timestamp) AS f, arg_max(equity, timestamp) AS z, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6 AS days, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS dn, min((equity - top) / top) AS mdd FROM e GROUP BY 1)
SELECT a.asset, round(z / f - 1, 6) AS total_return, round(ln(z / f) * (365.25 / days), 4) AS log_annual, round(s * sqrt(ppy), 4) AS ann_vol, round(dn * sqrt(ppy), 6) AS down_vol, round(m / s * sqrt(ppy), 6) AS sharpe,
 round(m / s * sqrt(ppy) * CASE WHEN den > 0 THEN sqrt(6.0 / den) END, 6) AS lo_sharpe, round(m / dn * sqrt(ppy), 4) AS sortino, round(mdd, 9) AS max_drawdown FROM a JOIN pp ON pp.asset = a.asset JOIN lo ON lo.asset = a.asset""")
def perf_ratios(spark, d):
    r = M.ratios(_curve(spark, d)).drop("annual_return")
    places = {"ann_vol": 4, "sortino": 4, "log_annual": 4, "max_drawdown": 9}
    return r.select("asset", *[F.round(c, places.get(c, 6)).alias(c) for c in r.columns[1:]])


# -- splits --------------------------------------------------------------------------------------------------------

_POS = f"{C}, pos AS (SELECT asset, timestamp, row_number() OVER ({T0}) - 1 AS pos FROM c), cnt AS (SELECT asset, count(*) AS n FROM c GROUP BY 1)"


@query("walk_forward_windows", f'WITH {_POS} SELECT asset, CAST(w AS INT) AS "window", 0 AS train_start, CAST(200 + w * 50 AS INT) AS test_start, CAST(250 + w * 50 AS INT) AS test_end FROM cnt, range(0, 10000) t(w) WHERE 250 + w * 50 <= n')
def walk_forward_windows(spark, d):
    n = candles(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    w = CV.walk_forward(n, 200, 50)
    return w.select("asset", *[F.col(c).cast("int").alias(c) for c in ("window", "train_start", "test_start", "test_end")])


@query("pipeline_splits", f"""WITH {C}, n AS (SELECT asset, count(*) AS n, CAST(floor(count(*) * 0.6::DOUBLE) AS INT) AS f FROM c GROUP BY 1),
p AS (SELECT asset, n, f, i, CAST(round(f + i * (n - f) / 5.0) AS INT) AS a, CAST(round(f + (i + 1) * (n - f) / 5.0) AS INT) AS b FROM n, range(0, 5) t(i) WHERE f >= 2 AND n - f > 15)
SELECT asset, CAST(row_number() OVER (PARTITION BY asset ORDER BY i) - 1 AS INT) AS window, 0 AS train_start, a AS train_end, a + 15 AS test_start, b AS test_end FROM p WHERE a >= 2 AND a + 15 < b""")
def pipeline_splits(spark, d):
    return CV.window_splits(candles(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n")))


def _cpcv_sql(before: int, after: int) -> str:
    return f"""WITH {_POS}, b AS (SELECT p.asset, p.pos, CAST(CASE WHEN p.pos < (n % 6) * (n // 6 + 1) THEN p.pos // (n // 6 + 1) ELSE n % 6 + (p.pos - (n % 6) * (n // 6 + 1)) // (n // 6) END AS INT) AS block FROM pos p JOIN cnt ON cnt.asset = p.asset),
ed AS (SELECT asset, block, min(pos) AS lo, max(pos) AS hi FROM b GROUP BY 1, 2),
fo AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS fold, i, j FROM range(0, 6) x(i), range(0, 6) y(j) WHERE i < j),
q AS (SELECT b.asset, fold, CASE WHEN b.block IN (i, j) THEN 'test' WHEN EXISTS (SELECT 1 FROM ed WHERE ed.asset = b.asset AND ed.block IN (i, j) AND b.pos BETWEEN lo - {before} AND hi + {after}) THEN 'purged' ELSE 'train' END AS part, pos FROM b, fo)
SELECT asset, CAST(fold AS INT) AS fold, part, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM q GROUP BY 1, 2, 3"""


def _folds(spark, d, **kw):
    f = CV.cpcv(candles(spark, d), **kw)
    return f.groupBy("asset", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


@query("cpcv_folds", _cpcv_sql(2, 2))
def cpcv_folds(spark, d):
    return _folds(spark, d)


@query("cpcv_purge_embargo", _cpcv_sql(3, 8))
def cpcv_purge_embargo(spark, d):
    return _folds(spark, d, purge=3, embargo=5, after_only=True)


_UNI = f"""{_POS}, u AS (SELECT p.asset, p.pos, avg(1.0::DOUBLE / least(p.pos + k + 1, 7, n, n + 6 - p.pos - k)) AS u FROM pos p JOIN cnt ON cnt.asset = p.asset, range(0, 7) t(k) GROUP BY 1, 2)"""


@query("label_uniqueness", f"WITH {_UNI} SELECT asset, pos, round(u, 9) AS uniqueness FROM u")
def label_uniqueness(spark, d):
    u = CV.uniqueness(candles(spark, d), 7)
    return rounded(u.select("asset", F.col("pos").cast("long").alias("pos"), "uniqueness"), places=9)


@query("n_eff_weights", f"WITH {_UNI} SELECT asset, round(sum(u) * sum(u) / sum(u * u), 6) AS n_eff FROM u GROUP BY 1")
def n_eff_weights(spark, d):
    return rounded(CV.effective_n(CV.uniqueness(candles(spark, d), 7)))


@query("non_overlapping", f"WITH {_POS} SELECT asset, timestamp FROM pos WHERE pos % 7 = 0")
def non_overlapping(spark, d):
    return CV.non_overlapping(candles(spark, d).select("asset", "timestamp"), 7).select("asset", "timestamp")



