"""Queries over candles: store, bars, indicators, targets; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import targets as T
from ..sources import store as S
from ..sources.tables import candles, resample, table

Q: dict = {}
SQL: dict[str, str] = {}

#: The candles in SQL.
C = """c AS (SELECT event_type AS asset, date_trunc('hour', ts) AS timestamp, arg_min(value, (ts, event_id)) AS open,
 max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(sum(user_id) AS DOUBLE) AS volume
 FROM events GROUP BY 1, 2)"""
#: The candles with row number, one-row log return, true range and signed volume.
R = C + """, r AS (SELECT *, row_number() OVER t AS rn, CASE WHEN close > 0 AND lag(close) OVER t > 0 THEN ln(close / lag(close) OVER t) END AS lr,
 greatest(high - low, abs(high - lag(close) OVER t), abs(low - lag(close) OVER t)) AS tr,
 CASE WHEN lag(close) OVER t IS NOT NULL THEN volume * sign(close - lag(close) OVER t) END AS dv
 FROM c WINDOW t AS (PARTITION BY asset ORDER BY timestamp))"""
T0 = "PARTITION BY asset ORDER BY timestamp"


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


@query("ohlcv_resample", f"WITH {C} SELECT * FROM c")
def ohlcv_resample(spark: SparkSession, d: str) -> DataFrame:
    return candles(spark, d)


@query("ohlcv_daily_lineitem", """WITH t AS (SELECT p_brand AS asset, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, l_orderkey * 8 + l_linenumber AS seq
 FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT asset, date_trunc('month', ts) AS timestamp, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(size) AS volume FROM t GROUP BY 1, 2""")
def ohlcv_daily_lineitem(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    t = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "asset", F.col("l_shipdate").alias("timestamp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("size"))
    return resample(t, "month")


_LO, _HI = "2024-01-05 00:00:00", "2024-01-12 00:00:00"


@query("scan_range", f"WITH {C} SELECT * FROM c WHERE asset = 'purchase' AND timestamp >= TIMESTAMP '{_LO}' AND timestamp < TIMESTAMP '{_HI}'")
def scan_range(spark, d):
    return S.scan(candles(spark, d), _LO, _HI, asset="purchase")


@query("scan_split", f"WITH {C} SELECT asset, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM c WHERE timestamp >= TIMESTAMP '{_HI}' AND timestamp < TIMESTAMP '2024-01-20' GROUP BY 1")
def scan_split(spark, d):
    split = {"train": ("2024-01-01", _HI), "validation": (_HI, "2024-01-20"), "test": ("2024-01-20", "2024-02-01")}
    got = S.scan_split(candles(spark, d), split, "validation")
    return got.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("scan_cross_asset", f"WITH {C} SELECT * FROM c WHERE asset IN ('click', 'view') AND timestamp >= TIMESTAMP '{_LO}' AND timestamp < TIMESTAMP '{_HI}'")
def scan_cross_asset(spark, d):
    return S.scan_assets(candles(spark, d), ["click", "view"], _LO, _HI)


@query("available_assets", "SELECT DISTINCT event_type AS asset FROM events")
def available_assets(spark, d):
    return S.assets(table(spark, d, "events").withColumnRenamed("event_type", "asset"))


@query("date_range", f'WITH {C} SELECT asset, min(timestamp) AS "start", CASE WHEN min(timestamp) = max(timestamp) THEN max(timestamp) + INTERVAL 1 SECOND ELSE max(timestamp) END AS "end" FROM c GROUP BY 1')
def date_range(spark, d):
    return S.date_range(candles(spark, d))


@query("count_rows", f"WITH {C} SELECT asset, count(*) AS n FROM c GROUP BY 1")
def count_rows(spark, d):
    return S.count_rows(candles(spark, d))


@query("insert_or_ignore", f"""WITH {C}, batch AS (SELECT * FROM c WHERE timestamp >= TIMESTAMP '{_LO}'), stored AS (SELECT * FROM c WHERE timestamp < TIMESTAMP '{_HI}')
SELECT b.* FROM batch b ANTI JOIN stored s ON b.asset = s.asset AND b.timestamp = s.timestamp""")
def insert_or_ignore(spark, d):
    c = candles(spark, d)
    batch = S.scan(c, start=_LO)
    return S.fresh(batch.unionByName(batch), S.scan(c, end=_HI), ["asset", "timestamp"])


@query("incremental_high_water", f"""WITH {C}, stored AS (SELECT * FROM c WHERE timestamp < TIMESTAMP '{_HI}' AND asset <> 'view'), m AS (SELECT asset, max(timestamp) - INTERVAL 1 SECOND AS mark FROM stored GROUP BY 1)
SELECT c.* FROM c LEFT JOIN m USING (asset) WHERE timestamp >= greatest(TIMESTAMP '{_LO}', coalesce(mark, TIMESTAMP '{_LO}'))""")
def incremental_high_water(spark, d):
    c = candles(spark, d)
    return S.since_high_water(c, S.scan(c, end=_HI).filter("asset <> 'view'"), _LO)


_BAR_SQL = """, p AS (SELECT asset, CASE WHEN max(CASE WHEN rn = 2 THEN timestamp END) > min(timestamp) THEN max(CASE WHEN rn = 2 THEN timestamp END) - min(timestamp) ELSE INTERVAL 1 MINUTE END AS period
 FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY timestamp) AS rn FROM c) GROUP BY 1),
v AS (SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS bf FROM ids)
SELECT v.asset, bar_id, min(timestamp) AS start_ts, max(timestamp) + any_value(period) AS end_ts, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, timestamp) AS close, sum(volume) AS volume, count(*) AS tick_count, round(sum(volume * bf), 6) AS buy_volume, round(sum(volume * (1.0 - bf)), 6) AS sell_volume,
 round(CASE WHEN sum(volume) > 0 THEN sum((high + low + close) / 3.0 * volume) / sum(volume) ELSE arg_max(close, timestamp) END, 6) AS vwap
FROM v JOIN p ON p.asset = v.asset GROUP BY v.asset, bar_id"""
_METRIC = {"tick": "1.0", "volume": "volume", "dollar": "close * volume"}
_THRESHOLD = {"tick": 10.0, "volume": 5000.0, "dollar": 500000.0}


def _bars_out(b: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return b.select("asset", "bar_id", "start_ts", "end_ts", "open", "high", "low", "close", "volume", "tick_count", r("buy_volume"), r("sell_volume"), r("vwap"))


for _k in B.STANDARD:
    _m = _METRIC[_k]
    _sql = f"WITH {C}, ids AS (SELECT *, CAST(floor((sum({_m}) OVER ({T0}) - {_m}) / {_THRESHOLD[_k]}) AS BIGINT) AS bar_id FROM c)" + _BAR_SQL

    @query(f"bars_{_k}", _sql)
    def _standard(spark, d, k=_k):
        return _bars_out(B.standard_bars(candles(spark, d), k, _THRESHOLD[k]))


_INFO = {"tick": 4.0, "volume": 3000.0, "dollar": 200000.0}
for _k in B.STANDARD:
    _m = _METRIC[_k]
    _a, _w = 2.0 / 21.0, 5
    _imb = f"""WITH RECURSIVE {C}, s AS (SELECT *, row_number() OVER ({T0}) AS rn, CASE WHEN close >= open THEN 1.0 ELSE -1.0 END * ({_m}) AS x FROM c),
f(asset, rn, bar_id, nxt, cum, theta) AS (
 SELECT asset, rn, 0::BIGINT, CASE WHEN abs(x) >= {_INFO[_k]} THEN 1 ELSE 0 END::BIGINT, CASE WHEN abs(x) >= {_INFO[_k]} THEN 0.0 ELSE x END::DOUBLE,
  CASE WHEN abs(x) >= {_INFO[_k]} AND 1 >= {_w} THEN {_a!r}::DOUBLE * abs(x) + (1.0::DOUBLE - {_a!r}::DOUBLE) * {_INFO[_k]} ELSE {_INFO[_k]} END::DOUBLE FROM s WHERE rn = 1
 UNION ALL
 SELECT s.asset, s.rn, f.nxt, f.nxt + CASE WHEN abs(f.cum + s.x) >= f.theta THEN 1 ELSE 0 END, CASE WHEN abs(f.cum + s.x) >= f.theta THEN 0.0::DOUBLE ELSE f.cum + s.x END,
  CASE WHEN abs(f.cum + s.x) >= f.theta AND f.nxt + 1 >= {_w} THEN {_a!r}::DOUBLE * abs(f.cum + s.x) + (1.0::DOUBLE - {_a!r}::DOUBLE) * f.theta ELSE f.theta END
 FROM f JOIN s ON s.asset = f.asset AND s.rn = f.rn + 1),
ids AS (SELECT s.*, f.bar_id FROM s JOIN f ON s.asset = f.asset AND s.rn = f.rn)""" + _BAR_SQL
    _run = f"""WITH RECURSIVE {C}, s AS (SELECT *, row_number() OVER ({T0}) AS rn, CASE WHEN close >= open THEN 1 ELSE -1 END AS dir, CAST({_m} AS DOUBLE) AS x FROM c),
f(asset, rn, bar_id, dom, dir, stretch, best, theta, formed) AS (
 SELECT asset, rn, 0::BIGINT, x, dir, x, x, {_INFO[_k]}::DOUBLE, 0::BIGINT FROM s WHERE rn = 1
 UNION ALL
 SELECT asset, rn, bar_id, greatest(best0, stretch1), dir, stretch1, greatest(best0, stretch1), theta1, formed1 FROM (
  SELECT s.asset, s.rn, f.bar_id + CASE WHEN f.dom >= f.theta THEN 1 ELSE 0 END AS bar_id, s.dir,
   CASE WHEN f.dom >= f.theta THEN 0.0::DOUBLE ELSE f.best END AS best0,
   CASE WHEN f.dom < f.theta AND f.dir = s.dir THEN f.stretch + s.x ELSE s.x END AS stretch1,
   CASE WHEN f.dom >= f.theta AND f.formed + 1 >= {_w} THEN {_a!r}::DOUBLE * f.dom + (1.0::DOUBLE - {_a!r}::DOUBLE) * f.theta ELSE f.theta END AS theta1,
   f.formed + CASE WHEN f.dom >= f.theta THEN 1 ELSE 0 END AS formed1
  FROM f JOIN s ON s.asset = f.asset AND s.rn = f.rn + 1)),
ids AS (SELECT s.*, f.bar_id FROM s JOIN f ON s.asset = f.asset AND s.rn = f.rn)""" + _BAR_SQL

    @query(f"bars_{_k}_imbalance", _imb)
    def _imbalance(spark, d, k=_k):
        return _bars_out(B.bars(candles(spark, d), f"{k}_imbalance", _INFO[k], 20, 5))

    @query(f"bars_{_k}_run", _run)
    def _runs(spark, d, k=_k):
        return _bars_out(B.bars(candles(spark, d), f"{k}_run", _INFO[k], 20, 5))


def _steps(spark, d):
    return I.with_steps(candles(spark, d))


def _roll(agg: str, over: str, n: int) -> str:
    w = f"OVER ({T0} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({over}) {w} >= {n} THEN {agg} {w} END"


def _lnr(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END"


def _lag(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER ({T0})"


def _lead(c: str, n: int) -> str:
    return f"lead({c}, {n}) OVER ({T0})"


def _z(c: str, n: int) -> str:
    return f"({c} - {_roll(f'avg({c})', c, n)}) / ({_roll(f'stddev_samp({c})', c, n)} + 1e-12)"


_GK = f"0.5 * pow({_lnr('high', 'low')}, 2) - (2 * ln(2) - 1) * pow({_lnr('close', 'open')}, 2)"
_PK = f"pow({_lnr('high', 'low')}, 2) / (4 * ln(2))"
_AM = "abs(lr) / (close * volume + 1e-12)"
_IND = {
    "ind_logret": {f"logret_{n}": _lnr("close", _lag("close", n)) for n in (1, 4, 12, 24)},
    "ind_rv": {f"rv_{n}": _roll("stddev_samp(lr)", "lr", n) for n in (12, 24, 48)},
    "ind_gk_parkinson": {"gk_vol_24": f"sqrt({_roll(f'avg({_GK})', _GK, 24)})", "park_vol_24": f"sqrt({_roll(f'avg({_PK})', _PK, 24)})"},
    "ind_roc": {f"roc_{n}": f"close / {_lag('close', n)} - 1" for n in (1, 4, 12)},
    "ind_zscores": {"vol_zscore_24": _z("volume", 24), "ret_zscore_24": _z("lr", 24)},
    "ind_amihud": {"log_amihud_24": f"ln({_roll(f'avg({_AM})', _AM, 24)} + 1e-9)"},
    "ind_bollinger": {
        "bbpctb_20_2": f"(close - ({_roll('avg(close)', 'close', 20)} - 2.0 * {_roll('stddev_samp(close)', 'close', 20)})) / (4.0 * {_roll('stddev_samp(close)', 'close', 20)} + 1e-12)",
        "bbwidth_20_2": f"4.0 * {_roll('stddev_samp(close)', 'close', 20)} / ({_roll('avg(close)', 'close', 20)} + 1e-12)",
    },
    "ind_slope": {"slope_14": _roll("regr_slope(close, rn)", "close", 14)},
}
for _name, _cols in _IND.items():
    _body = ", ".join(f"round({e}, 9) AS {c}" for c, e in _cols.items())

    @query(_name, f"WITH {R} SELECT asset, timestamp, {_body} FROM r")
    def _indicator(spark, d, names=tuple(_cols)):
        cols = I.rolling_columns()
        cols["log_amihud_24"] = F.log(cols["amihud_24"] + 1e-9)
        return _steps(spark, d).select("asset", "timestamp", *[F.round(cols[c], 9).alias(c) for c in names])


@query("ind_true_range", f"WITH {R} SELECT asset, timestamp, tr AS true_range FROM r")
def ind_true_range(spark, d):
    return _steps(spark, d).select("asset", "timestamp", F.col("__tr").alias("true_range"))


@query("ind_obv_slope", f"WITH {R}, o AS (SELECT *, CASE WHEN dv IS NOT NULL THEN sum(dv) OVER ({T0}) END AS obv FROM r) SELECT asset, timestamp, round({_roll('regr_slope(obv, rn)', 'obv', 14)}, 6) AS obv_slope_14 FROM o")
def ind_obv_slope(spark, d):
    return I.with_obv_slope(_steps(spark, d)).select("asset", "timestamp", F.round("obv_slope_14", 6).alias("obv_slope_14"))


_EWM = f"""WITH RECURSIVE {R}, s AS (SELECT *, CASE WHEN rn > 1 THEN greatest(close - lag(close) OVER ({T0}), 0) END AS gain, CASE WHEN rn > 1 THEN greatest(lag(close) OVER ({T0}) - close, 0) END AS loss FROM r),
f(asset, rn, atr, fast, slow, up, dn) AS (
 SELECT asset, rn, tr, close, close, gain, loss FROM s WHERE rn = 1
 UNION ALL
 SELECT s.asset, s.rn, s.tr / 14.0 + 13.0 / 14.0 * f.atr, 2.0 / 9.0 * s.close + 7.0 / 9.0 * f.fast, 2.0 / 22.0 * s.close + 20.0 / 22.0 * f.slow,
  CASE WHEN f.up IS NULL THEN s.gain ELSE s.gain / 14.0 + 13.0 / 14.0 * f.up END, CASE WHEN f.dn IS NULL THEN s.loss ELSE s.loss / 14.0 + 13.0 / 14.0 * f.dn END
 FROM f JOIN s ON s.asset = f.asset AND s.rn = f.rn + 1)"""


@query("ind_ewm", _EWM + " SELECT s.asset, s.timestamp, round(atr, 6) AS atr_14, round((fast - slow) / (atr + 1e-12), 6) AS ema_xover_8_21, round(100 - 100 / (1 + up / (dn + 1e-12)), 6) AS rsi_14 FROM f JOIN s ON s.asset = f.asset AND s.rn = f.rn")
def ind_ewm(spark, d):
    return rounded(I.with_ewm(_steps(spark, d)).select("asset", "timestamp", "atr_14", "ema_xover_8_21", "rsi_14"))


@query("ind_hurst")
def ind_hurst(spark, d):
    return rounded(I.with_hurst(candles(spark, d)).select("asset", "timestamp", "hurst_100"))


@query("ind_all")
def ind_all(spark, d):
    return rounded(I.all_indicators(candles(spark, d)))


def _fvol(h: int) -> str:
    w = f"OVER ({T0} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(lr) {w} >= {h} THEN stddev_samp(lr) {w} END"


_FWD = {f"fwd_logret_{h}": _lnr(_lead("close", h), "close") for h in T.HORIZONS}
_FWD |= {f"fwd_vol_{h}": _fvol(h) for h in T.VOL_HORIZONS}
_FWD |= {f"fwd_zret_{h}": f"({_FWD[f'fwd_logret_{h}']}) / ({_roll('stddev_samp(lr)', 'lr', 24)} + 1e-12)" for h in T.HORIZONS}
_DIR = {f"fwd_dir_{h}": f"CAST(CASE WHEN {_lead('close', h)} IS NOT NULL THEN CASE WHEN ({_FWD[f'fwd_logret_{h}']}) >= 0 THEN 1 ELSE -1 END END AS TINYINT)" for h in T.HORIZONS}
_RAW = R + ", t AS (SELECT asset, timestamp, " + ", ".join(f"{e} AS {c}" for c, e in (_FWD | _DIR).items()) + " FROM r)"


@query("targets_fwd", f"WITH {_RAW} SELECT asset, timestamp, " + ", ".join(f"round({c}, 9) AS {c}" for c in _FWD) + ", " + ", ".join(_DIR) + " FROM t")
def targets_fwd(spark, d):
    got = T.all_targets(candles(spark, d), winsorize=False)
    return rounded(got.select("asset", "timestamp", *_FWD, *_DIR), places=9)


@query("targets_winsorized", f"WITH {_RAW}, q AS (SELECT asset, " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in _FWD) + " FROM t GROUP BY 1) SELECT t.asset, timestamp, " + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest({c}_lo, least({c}_hi, {c})) END, 9) AS {c}" for c in _FWD) + " FROM t JOIN q ON t.asset = q.asset")
def targets_winsorized(spark, d):
    return rounded(T.all_targets(candles(spark, d)).select("asset", "timestamp", *_FWD), places=9)


@query("btc_lagged_asof", f"""WITH {R}, b AS (SELECT timestamp, lr AS btc_logret, {_roll('stddev_samp(lr)', 'lr', 24)} AS btc_rv, CASE WHEN lr IS NOT NULL THEN CASE WHEN lr >= 0 THEN 1 ELSE -1 END END AS btc_dir FROM r WHERE asset = 'purchase'),
a AS (SELECT c.*, btc_logret, btc_rv, btc_dir FROM (SELECT * FROM c WHERE asset <> 'purchase') c ASOF LEFT JOIN b ON c.timestamp >= b.timestamp)
SELECT asset, timestamp, round({_lag('btc_logret', 1)}, 9) AS btc_logret, round({_lag('btc_rv', 1)}, 9) AS btc_rv, {_lag('btc_dir', 1)} AS btc_dir FROM a""")
def btc_lagged_asof(spark, d):
    got = T.cross_asset(candles(spark, d), "purchase").select("asset", "timestamp", "btc_logret", "btc_rv", "btc_dir")
    return rounded(got, places=9)


@query("feature_matrix_counts", f"WITH {_RAW}, m AS (SELECT r.asset, {_roll('stddev_samp(lr)', 'lr', 24)} AS rv, r.timestamp FROM r) SELECT m.asset, count(*) AS n_raw, count(CASE WHEN rv IS NOT NULL AND fwd_logret_24 IS NOT NULL AND fwd_vol_24 IS NOT NULL THEN 1 END) AS n_clean FROM m JOIN t ON t.asset = m.asset AND t.timestamp = m.timestamp GROUP BY 1")
def feature_matrix_counts(spark, d):
    x = T.all_targets(_steps(spark, d).withColumn("rv_24", W.std("__lr", 24)).drop("__lr"), winsorize=False)
    ok = T.feature_matrix(x, ["rv_24", "fwd_logret_24", "fwd_vol_24"]).groupBy("asset").agg(F.count(F.lit(1)).alias("n_clean"))
    raw = x.groupBy("asset").agg(F.count(F.lit(1)).alias("n_raw"))
    return raw.join(ok, "asset", "left").select("asset", "n_raw", F.coalesce("n_clean", F.lit(0)).cast("long").alias("n_clean"))
