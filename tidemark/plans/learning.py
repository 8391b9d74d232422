"""Queries over learners, validation and resampling: rows-only checks here, tests elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import boosting as BO
from ..operators import linear as LN
from ..operators import models as MD
from ..operators import validation as V
from .analysis import _eval
from .market import query, rounded
from .trading import _features


def _split(df):
    cut = F.lit("2024-01-22").cast("timestamp_ntz")
    return df.filter(F.col("timestamp") < cut), df.filter(F.col("timestamp") >= cut)


def _data(spark, d):
    x = _features(spark, d).select("asset", "timestamp", "slope", "rv", F.col("__lr").alias("lr"), F.log1p("volume").alias("lv"), (F.try_divide(W.lead("close", 1), F.col("close")) - 1).alias("nxt"))
    x = x.withColumns({"y": F.when(F.col("nxt") >= 0, 1).otherwise(-1), "actual": F.log1p("nxt")})
    return x.filter("nxt IS NOT NULL AND slope IS NOT NULL AND rv IS NOT NULL AND lr IS NOT NULL").drop("nxt")


NAMES = ["slope", "rv", "lr", "lv"]

for _kind in ("logistic", "forest", "boosted"):

    @query(f"model_{_kind}")
    def _classify(spark, d, kind=_kind):
        return MD.classify(*_split(_data(spark, d)), NAMES, kind).select("asset", "timestamp", "y", "pred", F.round("confidence", 6).alias("confidence"))


for _kind in ("ridge", "huber", "boosted"):

    @query(f"model_reg_{_kind}")
    def _regress(spark, d, kind=_kind):
        return rounded(MD.regress(*_split(_data(spark, d)), NAMES, kind).select("asset", "timestamp", "actual", "reg_pred", "reg_std"))


@query("model_calibrated")
def model_calibrated(spark, d):
    return rounded(MD.calibrated(*_split(_data(spark, d)), NAMES).select("asset", "timestamp", "y", "pred", "confidence"))


@query("model_quantile")
def model_quantile(spark, d):
    """Quantiles of the days after 22 January: 20 rounds of small trees, all five quantiles in the same passes."""
    got = BO.quantiles(*_split(_data(spark, d)), NAMES, rounds=20, leaves=6)
    return rounded(got.select("asset", "timestamp", "actual", "q05", "q25", "q50", "q75", "q95", "std"))


@query("model_leafwise")
def model_leafwise(spark, d):
    got = BO.classify(*_split(_data(spark, d)), NAMES, rounds=20, leaves=6)
    return rounded(got.select("asset", "timestamp", "y", "pred", "confidence"))


@query("model_har")
def model_har(spark, d):
    return rounded(LN.har(_features(spark, d).filter("rv IS NOT NULL")))


@query("model_garch_forecast")
def model_garch_forecast(spark, d):
    return rounded(MD.garch_forecast(_features(spark, d).withColumn("ret", F.col("__lr"))))


@query("bootstrap_mean")
def bootstrap_mean(spark, d):
    return rounded(MD.bootstrap_mean(_eval(spark, d), "actual"))


WEEKS = [("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-01-22"), ("2024-01-22", "2024-01-31")]


@query("feature_validation")
def feature_validation(spark, d):
    """The statistical gate on four features of each asset: 1,000 permutations (ridge: 500, stability: 500) of blocks of 12 hours, four windows of a week."""
    report, _ = V.validate(_data(spark, d).select("asset", "timestamp", *NAMES, "actual"), NAMES, "actual", WEEKS, least=2, block=12)
    return rounded(report)


@query("feature_interactions")
def feature_interactions(spark, d):
    x = _data(spark, d)
    return rounded(V.interactions(x.withColumnsRenamed({"rv": "rv_24", "lr": "rv_1"}), ["rv_24", "rv_1", "slope", "lv"], "actual"))
