"""Forecasters: distributed learners of pyspark.ml, and small sequential kernels by asset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiling import garch_fit


def _features(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="skip")


def classifier(kind: str, rows: int, seed: int = 42):
    """logistic (L2, C = 1), forest (200 trees) or boosted trees; the label column is 0 or 1."""
    common = {"featuresCol": "__x", "labelCol": "label"}
    if kind == "logistic":
        return LogisticRegression(regParam=1.0 / max(rows, 1), standardization=False, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=200, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed, **common)
    if kind == "boosted":
        return GBTClassifier(maxIter=50, maxDepth=3, stepSize=0.1, seed=seed, **common)
    raise ValueError(kind)


def logistic_column(model, names: list[str]) -> Column:
    """The probability of label 1 as a column. A fitted logistic model's summary holds the session, which does not always travel
    to executors (not once an Observation has been made); its coefficients do."""
    score = F.lit(float(model.intercept))
    for c, w in zip(names, model.coefficients.toArray()):
        score = score + F.lit(float(w)) * F.col(c)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def classify(train: DataFrame, test: DataFrame, names: list[str], kind: str = "logistic") -> DataFrame:
    """test with pred (1, -1) and confidence (the larger probability). train has y in {1, -1}."""
    data = train.withColumn("label", (F.col("y") == 1).cast("double"))
    model = Pipeline(stages=[_features(names), classifier(kind, data.count())]).fit(data)
    if kind == "logistic":
        for c in names:
            test = test.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
        out = test.withColumn("p_up", logistic_column(model.stages[-1], names))
    else:
        out = model.transform(test).withColumn("p_up", vector_to_array("probability")[1])
    out = out.withColumns({"pred": F.when(F.col("p_up") >= 0.5, 1).otherwise(-1), "confidence": F.greatest("p_up", 1 - F.col("p_up"))})
    return out.select(*test.columns, "p_up", "pred", "confidence")


def calibrated(train: DataFrame, test: DataFrame, names: list[str], method: str = "isotonic", folds: int = 3) -> DataFrame:
    """Boosted trees with out-of-fold scores calibrated by a sigmoid or an isotonic step function."""
    part = F.pmod(F.xxhash64(*names), F.lit(folds))
    held = None
    for k in range(folds):
        one = classify(train.filter(part != k), train.filter(part == k), names, "boosted")
        held = one if held is None else held.unionByName(one)
    raw = classify(train, test, names, "boosted")
    lab = held.withColumn("label", (F.col("y") == 1).cast("double"))
    if method == "isotonic":
        m = IsotonicRegression(featuresCol="p_up", labelCol="label", predictionCol="__p").fit(lab.withColumn("weight", F.lit(1.0)))
        out = m.transform(raw)
    else:
        m = Pipeline(stages=[VectorAssembler(inputCols=["p_up"], outputCol="__s"), LogisticRegression(featuresCol="__s", labelCol="label")]).fit(lab)
        out = raw.withColumn("__p", logistic_column(m.stages[-1], ["p_up"]))
    p = F.col("__p")
    return out.withColumns({"p_up": p, "pred": F.when(p >= 0.5, 1).otherwise(-1), "confidence": F.greatest(p, 1 - p)}).select(*raw.columns)


def regress(train: DataFrame, test: DataFrame, names: list[str], kind: str = "ridge", alpha: float = 1.0) -> DataFrame:
    """test with reg_pred and reg_std (sample deviation of the training residuals). train has actual."""
    n = max(train.count(), 1)
    common = {"featuresCol": "__x", "labelCol": "actual", "predictionCol": "reg_pred"}
    if kind == "ridge":
        est = LinearRegression(regParam=alpha / n, elasticNetParam=0.0, standardization=False, **common)
    elif kind == "huber":
        est = LinearRegression(loss="huber", regParam=alpha / n, standardization=False, **common)
    elif kind == "boosted":
        est = GBTRegressor(maxIter=50, maxDepth=5, stepSize=0.1, seed=42, **common)
    else:
        raise ValueError(kind)
    model = Pipeline(stages=[_features(names), est]).fit(train)
    std = model.transform(train).agg(F.stddev_samp(F.col("actual") - F.col("reg_pred"))).first()[0]
    return model.transform(test).withColumn("reg_std", F.lit(float(std or 0.0))).select(*test.columns, "reg_pred", "reg_std")


def momentum_sign(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"pred": F.when(F.col(column) >= 0, 1).otherwise(-1), "confidence": F.lit(0.5)})


def garch_forecast(df: DataFrame, ret: str = "ret", horizon: int = 5) -> DataFrame:
    """(asset, step, variance): the GARCH(1,1) variance of the next `horizon` rows."""

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values("timestamp", kind="stable")[ret].to_numpy(float)
        r = r[np.isfinite(r)]
        p = garch_fit(r)
        h = float(r.var())
        for e in r:
            h = p["omega"] + p["alpha"] * e * e + p["beta"] * h
        out = []
        for _ in range(horizon):
            out.append(h)
            h = p["omega"] + (p["alpha"] + p["beta"]) * h
        return pd.DataFrame({"asset": key[0], "step": range(1, horizon + 1), "variance": out})

    return df.select("asset", "timestamp", ret).groupBy("asset").applyInPandas(one, "asset string, step int, variance double")


def bootstrap_mean(df: DataFrame, c: str, resamples: int = 1000, level: float = 0.95, seed: int = 42, per_task: int = 100) -> DataFrame:
    """(asset, mean, low, high): percentile interval of the mean. Resamples are dealt out in batches."""
    batches = -(-resamples // per_task)
    each = df.select("asset", F.col(c).alias("v")).filter("v IS NOT NULL").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(g["v"].to_numpy(float))
        rng = np.random.default_rng([seed, key[1]])
        k = min(per_task, resamples - key[1] * per_task)
        return pd.DataFrame({"asset": key[0], "m": [float(v[rng.integers(0, len(v), len(v))].mean()) for _ in range(k)]})

    means = each.groupBy("asset", "batch").applyInPandas(one, "asset string, m double")
    ci = means.groupBy("asset").agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))
    return df.groupBy("asset").agg(F.avg(c).alias("mean")).join(ci, "asset")


class Boosted:
    """Gradient boosting of squared errors by trees over binned columns, grown level by level; for one group's rows."""

    def __init__(self, rounds: int = 100, depth: int = 5, rate: float = 0.1, least: int = 20, bins: int = 32, ridge: float = 0.0):
        self.rounds, self.depth, self.rate, self.least, self.bins, self.ridge = rounds, depth, rate, least, bins, ridge

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, n = self.binned(x), len(y)
        self.start, self.trees = float(y.mean()), []
        f = np.full(n, self.start)
        for _ in range(self.rounds):
            g, node, tree = y - f, np.zeros(n, np.int64), []
            for level in range(self.depth):
                k = 1 << level
                gain, split = np.full(k, 1e-15), np.full((k, 2), -1)
                for j, e in enumerate(self.edges):
                    width = len(e) + 1
                    at = node * width + b[:, j]
                    sums, rows = (np.bincount(at, v, k * width).reshape(k, width).cumsum(1) for v in (g, np.ones(n)))
                    total, all_rows = sums[:, -1:], rows[:, -1:]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        got = sums**2 / (rows + self.ridge) + (total - sums) ** 2 / (all_rows - rows + self.ridge) - total**2 / (all_rows + self.ridge)
                    got[(rows < self.least) | (all_rows - rows < self.least)] = -1
                    best = got.argmax(1)
                    better = got[np.arange(k), best] > gain
                    gain[better] = got[np.arange(k), best][better]
                    split[better] = np.column_stack([np.full(k, j), best])[better]
                tree.append(split)
                node = self.descend(node, split, b)
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / np.maximum(np.bincount(node, minlength=k) + self.ridge, 1)
            self.trees.append((tree, leaf))
            f = f + leaf[node]
        return self

    @staticmethod
    def descend(node: np.ndarray, split: np.ndarray, b: np.ndarray) -> np.ndarray:
        j, cut = split[node, 0], split[node, 1]
        return node * 2 + ((j >= 0) & (b[np.arange(len(node)), np.maximum(j, 0)] > cut))

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, f = self.binned(x), np.full(len(x), self.start)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for split in tree:
                node = self.descend(node, split, b)
            f += leaf[node]
        return f
