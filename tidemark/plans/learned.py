"""Queries over overlapping labels, linear systems by sweeps, paged sources and streams; with DuckDB SQL where that can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tails
from ..operators import backtest as BT
from ..operators import bars as BA
from ..operators import forecast as FC
from ..operators import linear as LN
from ..operators import metrics as ME
from ..operators import overlap as O
from ..operators import profiling as P
from ..operators import recommend as RC
from ..operators import strategies as ST
from ..operators import thresholds as TH
from ..sources import paged
from ..sources import store as S
from ..sources.shared import materialize, shared_folder
from ..functions import windows as W
from ..sources.tables import candles
from ..streaming import stateful as SF
from .market import _THRESHOLD, C, Q, SQL, T0, _bars_out, query, rounded
from .analysis import _EV, LR, _eval, _ret
from .trading import _DEP, _RG, _RS, FE, _features, _outputs, _predictions

# -- overlapping labels --------------------------------------------------------------------------------------------------

_LAB = f"""WITH {FE}, s AS (SELECT asset, timestamp, row_number() OVER ({T0}) - 1 AS pos, CASE WHEN slope > 0.1 THEN 'long' WHEN slope < -0.1 THEN 'short' ELSE 'flat' END AS side FROM x),
q AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER ({T0}) THEN pos END AS turn, max(pos) OVER (PARTITION BY asset) AS last FROM s),
z AS (SELECT *, coalesce(min(turn) OVER ({T0} ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), least(pos + 24, last + 1)) AS until FROM q),
l AS (SELECT asset, pos AS label, pos AS a, until AS b FROM z WHERE side <> 'flat'),
o AS (SELECT asset, label, unnest(generate_series(a, b - 1)) AS t FROM l)"""


def _labels(spark, d):
    """The held spans of the momentum signal: labels of one to 24 bars."""
    return O.held_labels(ST.momentum(_features(spark, d), "slope", 0.1), "side")


@query("label_indicator", _LAB + " SELECT asset, label, count(*) AS n, min(t) AS first_at, max(t) AS last_at FROM o GROUP BY 1, 2")
def label_indicator(spark, d):
    """Row sums and ends of the indicator matrix."""
    return O.indicator(_labels(spark, d)).groupBy("asset", "label").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("label_concurrency", _LAB + ", al AS (SELECT asset, t, count(*) AS n FROM o GROUP BY 1, 2) SELECT asset, CAST(t AS DOUBLE) AS t, n AS alive FROM al")
def label_concurrency(spark, d):
    """Column sums of the indicator matrix, from the labels' ends alone."""
    steps = O.concurrency(_labels(spark, d)).filter("alive > 0")
    at = F.explode(F.sequence(F.col("at").cast("long"), F.col("until").cast("long") - 1))
    return steps.select("asset", at.alias("t"), "alive").withColumn("t", F.col("t").cast("double"))


@query("label_uniqueness", _LAB + ", al AS (SELECT asset, t, count(*) AS n FROM o GROUP BY 1, 2) SELECT o.asset, label, round(avg(1.0::DOUBLE / n), 9) AS uniqueness FROM o JOIN al ON al.asset = o.asset AND al.t = o.t GROUP BY 1, 2")
def label_uniqueness(spark, d):
    return rounded(O.uniqueness(_labels(spark, d)), places=9)


@query("label_weights_subsample", f"WITH {FE}, p AS (SELECT asset, row_number() OVER ({T0}) - 1 AS pos FROM x) SELECT asset, count(*) AS n_raw, CAST(count(*) FILTER (pos % 24 = 0) AS DOUBLE) AS n_eff FROM p GROUP BY 1")
def label_weights_subsample(spark, d):
    return O.weights(candles(spark, d), 24, "subsample")[1]


@query("label_weights", f"""WITH {FE}, p AS (SELECT asset, row_number() OVER ({T0}) - 1 AS pos FROM x), o AS (SELECT asset, pos, unnest(generate_series(pos, pos + 23)) AS t FROM p),
al AS (SELECT asset, t, count(*) AS n FROM o GROUP BY 1, 2), w AS (SELECT o.asset, pos, avg(1.0::DOUBLE / n) AS w FROM o JOIN al ON al.asset = o.asset AND al.t = o.t GROUP BY 1, 2)
SELECT asset, count(*) AS n_raw, round(sum(w) * sum(w) / sum(w * w), 6) AS n_eff FROM w GROUP BY 1""")
def label_weights(spark, d):
    return rounded(O.weights(candles(spark, d), 24)[1])


@query("sequential_bootstrap")
def sequential_bootstrap(spark, d):
    """Ten replicates of each asset's momentum labels, with the uniqueness of their draws among themselves."""
    return rounded(O.sample_uniqueness(O.sequential_bootstrap(_labels(spark, d), 10)))

# -- the paged source ----------------------------------------------------------------------------------------------------

_JAN = (1704067200000, 1706659200000)


def _pages_of_events(spark, d, name):
    """The candles of events as an API that gives 100 a page, registered as a source."""
    c = candles(spark, d)
    raw = c.select("asset", (F.unix_millis(F.col("timestamp").cast("timestamp"))).alias("open_ms"), *[F.col(x).cast("string").alias(x) for x in ("open", "high", "low", "close")], "volume")
    fixed = materialize(raw.repartitionByRange("asset", "open_ms").sortWithinPartitions("asset", "open_ms"))
    paged.register(spark, name, paged.TableTransport(fixed._tidemark_path))
    return [r[0] for r in S.assets(fixed).collect()]


@query("paged_source", f"WITH {C} SELECT asset, '1h' AS timeframe, timestamp, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM c WHERE epoch_ms(timestamp) >= {_JAN[0]} AND epoch_ms(timestamp) < {_JAN[1]}")
def paged_source(spark, d):
    """January's hourly candles of every asset, read page by page by tasks of four days each."""
    assets = _pages_of_events(spark, d, "tidemark_event_pages")
    got = paged.candles(spark, "tidemark_event_pages", assets, ["1h"], *_JAN, limit=24, slice_pages=4)
    # the last page may reach past the end
    got = got.filter(F.unix_millis("timestamp") < _JAN[1])
    return got.select("asset", "timeframe", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], "volume")


# -- linear systems ------------------------------------------------------------------------------------------------------

_VIF = f"""WITH {FE}, v AS (SELECT asset, rv AS a, slope AS b, atr AS c FROM x WHERE rv IS NOT NULL AND slope IS NOT NULL AND atr IS NOT NULL),
co AS (SELECT asset, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM v GROUP BY 1), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM co)"""


@query("vif", _VIF + " " + " UNION ALL ".join(f"SELECT asset, '{f}' AS feature, round((1 - {r} * {r}) / det, 6) AS vif FROM d" for f, r in (("rv", "bc"), ("slope", "ac"), ("atr", "ab"))))
def vif(spark, d):
    return rounded(LN.vif(_features(spark, d), ["rv", "slope", "atr"]))


def _reco(spark, d):
    """Recommender features of each bar with the return of the next one."""
    o = _outputs(spark, d)
    key = ["asset", "timestamp"]
    clf = RC.classifier_features(o.select(*key, "clf_direction", "clf_confidence", "clf_correct"))
    reg = o.select(*key, "reg_predicted_return", F.col("rv").alias("reg_prediction_std"))
    vol = RC.vol_features(o.select(*key, "vol_predicted", "vol_actual"))
    x = RC.rolling_entropy(RC.vol_regime(RC.combined_features(RC.features(o.select(*key, "close", "ret"), clf=clf, reg=reg, vol=vol))))
    return x.withColumn("actual", F.try_divide(W.lead("close", 1), F.col("close")) - 1)


ABLATED = ["clf_direction", "clf_confidence", "clf_rolling_accuracy", "forecast_agreement", "conviction_score", "reg_predicted_return", "reg_prediction_std", "vol_regime", "rolling_perm_entropy"]


@query("ablation")
def ablation(spark, d):
    """What each group of recommender features adds to a ridge on all: fitted up to 22 January, tested on the days after."""
    x = _reco(spark, d)
    cut = F.lit("2024-01-22").cast("timestamp_ntz")
    return rounded(LN.ablation(x.filter(F.col("timestamp") < cut), x.filter(F.col("timestamp") >= cut), ABLATED))


@query("qq_student", f"WITH {LR}, o AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ret) AS i, count(*) OVER (PARTITION BY asset) AS n FROM lr WHERE ret IS NOT NULL), b AS (SELECT asset, ret, (i - 0.375::DOUBLE) / (n + 0.25) AS p FROM o), m AS (SELECT asset, avg(ret) AS loc, stddev_samp(ret) AS s FROM lr GROUP BY 1) SELECT b.asset, round(p, 9) AS p, round(loc + s * (2 * p - 1) / sqrt(2 * p * (1 - p)), 6) AS theoretical, round(ret, 9) AS ordered FROM b JOIN m ON m.asset = b.asset")
def qq_student(spark, d):
    """Quantile data of the t with two degrees of freedom, whose quantiles have a closed form."""
    r = _ret(spark, d)
    fits = r.groupBy("asset").agg(F.lit(2.0).alias("nu"), F.avg("ret").alias("loc"), F.stddev_samp("ret").alias("scale"))
    return P.qq_student(r, fits).select("asset", F.round("p", 9).alias("p"), F.round("theoretical", 6).alias("theoretical"), F.round("ordered", 9).alias("ordered"))


@query("qq_student_fitted")
def qq_student_fitted(spark, d):
    """Quantile data of each asset's own fit."""
    fits = P.kernel(_ret(spark, d), "ret", P.student_fit, "nu double, loc double, scale double, aic_t double, aic_normal double, bic_t double, bic_normal double")
    return rounded(P.qq_student(_ret(spark, d), fits), places=9)


# -- streams -------------------------------------------------------------------------------------------------------------


def _stream(spark, df, copies: int):
    """df's candles as a stream of `copies` files of about as many days; each starts a day before the last one ended."""
    c = df.select("asset", F.col("timestamp").cast("timestamp").alias("timestamp"), *[F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close", "volume")])
    low, high = (x.timestamp() for x in c.agg(F.min("timestamp"), F.max("timestamp")).first())
    path = f"{shared_folder(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    step = (high - low) / copies
    for nr in range(copies):
        at = F.unix_seconds("timestamp")
        part = c.filter((at >= low + nr * step - 86_400 * (nr > 0)) & (at <= low + (nr + 1) * step + 1))
        part.coalesce(1).write.parquet(f"{path}/in/{nr:03d}")
    # a row far ahead moves the watermark past all candles
    end = c.limit(1).select(F.lit("~").alias("asset"), F.lit("2100-01-01").cast("timestamp").alias("timestamp"), *c.columns[2:])
    end.coalesce(1).write.parquet(f"{path}/in/{copies:03d}")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    return stream, path


def _ran(spark, out, path):
    SF.run(out, f"{path}/out", f"{path}/state")
    got = spark.read.schema(out.schema).parquet(f"{path}/out").filter("asset <> '~'")
    return got.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in got.dtypes])


@query("stream_insert_or_ignore", f"WITH {C} SELECT asset, timestamp, open, high, low, close, volume FROM c")
def stream_insert_or_ignore(spark, d):
    """Candles in overlapping files through a stream: each is kept once."""
    stream, path = _stream(spark, candles(spark, d), 3)
    return _ran(spark, SF.insert_or_ignore(stream, "2 days"), path)


@query("stream_volume_bars", SQL["bars_volume"])
def stream_volume_bars(spark, d):
    """Volume bars of a stream of overlapping files, equal to the batch's."""
    stream, path = _stream(spark, candles(spark, d), 3)
    return _bars_out(_ran(spark, SF.bars(stream, "volume", _THRESHOLD["volume"], late="2 days"), path))


# -- thresholds, factors and counts --------------------------------------------------------------------------------------

_Z = tails.norm_ppf(0.95) + tails.norm_ppf(0.80)


@query("all_thresholds", f"""WITH {LR}, b AS (SELECT asset, 'time' AS bar_type, count(ret) AS n_bars, count(ret) / 3.0 AS n_eff, avg(abs(ret)) AS m FROM lr GROUP BY 1),
t AS (SELECT *, least(1.0, greatest(0.5, 0.5 + 0.002 / (2 * m))) AS breakeven_da, least(1.0, greatest(0.5, 0.5 + {_Z!r} / (2 * sqrt(n_eff)))) AS mde_da FROM b)
SELECT asset, bar_type, n_bars, round(n_eff, 6) AS n_eff, round(m, 6) AS mean_abs_return, round(breakeven_da, 6) AS breakeven_da, round(mde_da, 6) AS mde_da, round(breakeven_da - mde_da, 6) AS gap,
 CASE WHEN breakeven_da - mde_da > 0.01 THEN 'feasible' WHEN breakeven_da - mde_da >= -0.01 THEN 'marginal' ELSE 'underpowered' END AS feasibility,
 round({TH.harvey_z(345)!r}, 6) AS harvey_z, 5.0::DOUBLE AS vif_threshold, 2 AS stability_windows, round(pow({_Z!r} / (2 * (breakeven_da - 0.5)), 2), 1) AS n_eff_required FROM t""")
def all_thresholds(spark, d):
    s = _ret(spark, d).groupBy("asset").agg(F.lit("time").alias("bar_type"), F.count("ret").alias("n_bars"), (F.count("ret") / 3.0).alias("n_eff"), F.avg(F.abs("ret")).alias("mean_abs_return"))
    x = TH.all_thresholds(s).withColumn("n_eff_required", F.round("n_eff_required", 1))
    return rounded(x)


_LOU = ", ".join(f"dd * lag(dd, {k}) OVER ({T0}) AS p{k}" for k in range(1, 7))


@query("lo_unweighted", f"WITH {LR}, cd AS (SELECT asset, timestamp, ret - avg(ret) OVER (PARTITION BY asset) AS dd FROM lr WHERE ret IS NOT NULL), pk AS (SELECT *, {_LOU} FROM cd), v AS (SELECT asset, 1 + 2 * ({' + '.join(f'avg(p{k}) / avg(dd * dd)' for k in range(1, 7))}) AS s FROM pk GROUP BY 1) SELECT asset, round(CASE WHEN s > 1e-12 THEN sqrt(s) ELSE 1.0 END, 6) AS factor FROM v")
def lo_unweighted(spark, d):
    return rounded(ME.lo_unweighted(_ret(spark, d), "ret", 6))


@query("winsorized_predictions", f"WITH {_EV}, q AS (SELECT asset, quantile_cont(predicted, 0.01) AS lo, quantile_cont(predicted, 0.99) AS hi FROM ev GROUP BY 1) SELECT ev.asset, timestamp, round(greatest(lo, least(hi, predicted)), 9) AS predicted FROM ev JOIN q ON q.asset = ev.asset")
def winsorized_predictions(spark, d):
    return rounded(FC.winsorized_predictions(_eval(spark, d).select("asset", "timestamp", "predicted")), places=9)


@query("reco_sharpe", _DEP + f""", s AS (SELECT asset, timestamp, CASE WHEN {_RG} THEN ({_RS}) * actual ELSE 0.0 END AS ret, CASE WHEN {_RG} THEN actual ELSE 0.0 END AS b FROM p WHERE actual IS NOT NULL),
m AS (SELECT asset, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(8766) AS sharpe_sized, avg(b) / nullif(stddev_samp(b), 0) * sqrt(8766) AS sharpe_binary FROM s GROUP BY 1),
cd AS (SELECT asset, timestamp, ret - avg(ret) OVER (PARTITION BY asset) AS dd FROM s), pk AS (SELECT *, {_LOU} FROM cd),
e AS (SELECT asset, sqrt(6 / (6 + 2 * ({' + '.join(f'{6 - k} * sum(p{k})' for k in range(1, 7))}) / sum(dd * dd))) AS eta FROM pk GROUP BY 1)
SELECT m.asset, round(sharpe_sized, 6) AS sharpe_sized, round(sharpe_binary, 6) AS sharpe_binary, round(sharpe_sized * eta, 6) AS lo_sized, round(sharpe_binary * eta, 6) AS lo_binary, round(sharpe_sized * eta - sharpe_binary * eta, 6) AS sizing_value FROM m JOIN e ON e.asset = m.asset""")
def reco_sharpe(spark, d):
    return rounded(RC.recommendation_sharpe(RC.deploy(_predictions(spark, d), "regressor_only", 0.05)))


@query("bars_by_config", " UNION ALL ".join(f"SELECT asset, '{k}' AS bar_type, '{BA.config_hash(k, _THRESHOLD[k])}' AS bar_config_hash, count(*) AS n FROM ({SQL[f'bars_{k}']}) {k}s GROUP BY 1" for k in ("tick", "volume")))
def bars_by_config(spark, d):
    made = [Q[f"bars_{k}"](spark, d).select("asset", F.lit(k).alias("bar_type"), F.lit(BA.config_hash(k, _THRESHOLD[k])).alias("bar_config_hash")) for k in ("tick", "volume")]
    return S.count_by_config(made[0].unionByName(made[1]))


@query("cost_multipliers")
def cost_multipliers(spark, d):
    """The last equity of each asset at plain fees, and with purchases at half and views at three times the fee."""
    x = ST.momentum(_features(spark, d), "slope", 0.1)
    bars = _features(spark, d).join(x.select("asset", "timestamp", "side", "strength"), ["asset", "timestamp"]).select("asset", "timestamp", "open", "high", "low", "close", "volume", "side", "strength")
    BT.check_bars(bars)
    plain, own = (BT.cost_sweep(bars, (10.0,), size=BT.fixed_fraction(0.01), multipliers=m) for m in (None, {"purchase": 0.5, "view": 3.0}))
    return rounded(plain.join(own.select("asset", F.col("final_equity").alias("multiplied_equity")), "asset"))


@query("transform_suggestions")
def transform_suggestions(spark, d):
    """Joint ADF and KPSS verdict of each feature, and the transform of its family where it is not stationary."""
    x = _features(spark, d).select("asset", "timestamp", F.col("rv").alias("rv_24"), F.col("atr").alias("atr_14"), "slope")
    long = x.unpivot(["asset", "timestamp"], ["rv_24", "atr_14", "slope"], "feature", "v").filter("v IS NOT NULL")
    got = P.kernel(long.withColumn("asset", F.concat_ws("\x01", "asset", "feature")), "v", P.stationarity, "adf double, adf_p double, kpss double, kpss_p double, verdict string")
    parts = F.split("asset", "\x01")
    got = got.select(parts[0].alias("asset"), parts[1].alias("feature"), "verdict")
    return got.withColumn("suggested", F.when(F.col("verdict") != "stationary", P.suggested(F.col("feature"))))
