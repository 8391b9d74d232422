"""Performance of equity columns: returns, drawdowns, streaks, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import lag, ordered, upto

LO_LAGS = 6
YEAR = 365.25 * 86400


def seconds(c: str | Column) -> Column:
    """A timestamp as seconds, exact to the microsecond."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")) / 1e6


def with_returns(df: DataFrame, equity: str = "equity") -> DataFrame:
    return df.withColumn("ret", F.try_divide(F.col(equity), lag(equity)) - 1)


def drawdowns(df: DataFrame, equity: str = "equity") -> DataFrame:
    top = F.max(equity).over(upto())
    return df.withColumn("drawdown", (F.col(equity) - top) / F.when(top <= 0, F.lit(1.0)).otherwise(top))


def longest_drawdown(df: DataFrame, equity: str = "equity") -> DataFrame:
    """(asset, max_dd_days): the longest stretch below the running maximum, up to the row that recovers it or the end."""
    d = df.withColumn("__under", (F.col(equity) < F.max(equity).over(upto())).cast("int"))
    d = d.withColumn("__island", F.sum(1 - F.col("__under")).over(upto()))
    d = d.withColumn("__next", F.lead("timestamp").over(ordered()))
    s = d.filter("__under = 1").groupBy("asset", "__island").agg(F.min("timestamp").alias("a"), F.max(F.coalesce("__next", "timestamp")).alias("b"))
    days = s.groupBy("asset").agg(F.max((seconds("b") - seconds("a")) / 86400).alias("max_dd_days"))
    return df.select("asset").distinct().join(days, "asset", "left").select("asset", F.coalesce("max_dd_days", F.lit(0.0)).alias("max_dd_days"))


def longest_losing_streak(df: DataFrame, pnl: str) -> DataFrame:
    d = df.withColumn("__win", (F.col(pnl) > 0).cast("int")).withColumn("__island", F.sum("__win").over(upto()))
    s = d.filter("__win = 0").groupBy("asset", "__island").agg(F.count(F.lit(1)).alias("n"))
    top = s.groupBy("asset").agg(F.max("n").alias("max_losses"))
    return df.select("asset").distinct().join(top, "asset", "left").select("asset", F.coalesce("max_losses", F.lit(0)).alias("max_losses"))


def periods_per_year(df: DataFrame) -> DataFrame:
    gap = seconds("timestamp") - seconds(F.lag("timestamp").over(ordered()))
    m = df.withColumn("__gap", gap).groupBy("asset").agg(F.percentile("__gap", F.lit(0.5)).alias("m"))
    return m.select("asset", F.try_divide(F.lit(YEAR), "m").alias("ppy"))


def lo_factor(df: DataFrame, ret: str = "ret", q: int = LO_LAGS) -> DataFrame:
    """(asset, eta): sqrt(q / (q + 2 sum (q - k) rho_k)); null if the denominator is not positive."""
    clean = df.filter(F.col(ret).isNotNull())
    d = clean.withColumn("__d", F.col(ret) - F.avg(ret).over(Window.partitionBy("asset")))
    d = d.withColumns({f"__p{k}": F.col("__d") * F.lag("__d", k).over(ordered()) for k in range(1, q + 1)})
    s = d.groupBy("asset").agg(F.sum(F.col("__d") * F.col("__d")).alias("v"), F.count(F.lit(1)).alias("n"), *[F.sum(f"__p{k}").alias(f"p{k}") for k in range(1, q + 1)])
    weighted = sum((F.lit(q - k) * F.col(f"p{k}") for k in range(1, q + 1)), F.lit(0.0))
    den = F.lit(float(q)) + 2 * F.try_divide(weighted, "v")
    return s.select("asset", F.when((F.col("n") >= q + 1) & (den > 0), F.sqrt(F.try_divide(F.lit(float(q)), den))).alias("eta"))


def lo_unweighted(df: DataFrame, ret: str = "ret", q: int = LO_LAGS) -> DataFrame:
    """(asset, factor): sqrt(1 + 2 sum rho_k), by which a Sharpe ratio is divided; the autocovariance at lag k is the mean of its n - k
    products. 1 where the variance or the sum is not above 1e-12."""
    clean = df.filter(F.col(ret).isNotNull())
    d = clean.withColumn("__d", F.col(ret) - F.avg(ret).over(Window.partitionBy("asset")))
    d = d.withColumns({f"__p{k}": F.col("__d") * F.lag("__d", k).over(ordered()) for k in range(1, q + 1)})
    s = d.groupBy("asset").agg(F.avg(F.col("__d") * F.col("__d")).alias("v"), *[F.avg(f"__p{k}").alias(f"p{k}") for k in range(1, q + 1)])
    total = 1 + 2 * sum((F.coalesce(F.try_divide(f"p{k}", "v"), F.lit(0.0)) for k in range(1, q + 1)), F.lit(0.0))
    return s.select("asset", F.when((F.col("v") >= 1e-12) & (total > 1e-12), F.sqrt(total)).otherwise(1.0).alias("factor"))


def ratios(df: DataFrame, equity: str = "equity") -> DataFrame:
    """Per asset: total and annual return, volatilities, Sharpe (Lo-corrected too), Sortino, drawdown, Calmar."""
    r = drawdowns(with_returns(df, equity), equity)
    a = r.groupBy("asset").agg(
        F.min_by(equity, "timestamp").alias("__first"), F.max_by(equity, "timestamp").alias("__last"),
        ((F.max(seconds("timestamp")) - F.min(seconds("timestamp"))) / 86400).alias("days"),
        F.avg("ret").alias("__m"), F.stddev_samp("ret").alias("__s"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("__down"),
        F.min("drawdown").alias("max_drawdown"),
    ).join(periods_per_year(df), "asset").join(lo_factor(r), "asset", "left")
    total = F.try_divide("__last", "__first") - 1
    grown = F.when((F.col("days") > 0) & (1 + total > 0), F.log1p(total) * F.try_divide(F.lit(365.25), "days"))
    root = F.sqrt("ppy")
    sharpe = F.when(F.col("__s") > 0, F.try_divide("__m", "__s") * root)
    return a.select(
        "asset", total.alias("total_return"), grown.alias("log_annual"), (F.exp(F.least(grown, F.lit(700.0))) - 1).alias("annual_return"), (F.col("__s") * root).alias("ann_vol"), (F.col("__down") * root).alias("down_vol"),
        sharpe.alias("sharpe"), (sharpe * F.col("eta")).alias("lo_sharpe"), F.when(F.col("__down") > 0, F.try_divide("__m", "__down") * root).alias("sortino"),
        "max_drawdown",
    )


def calmar(annual: Column, mdd: Column) -> Column:
    return F.when(mdd < 0, F.try_divide(annual, F.abs(mdd)))


def trade_stats(trades: DataFrame, least: int = 30, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Win rate, profit factor and mean win and loss; null below `least` trades."""
    p = F.col("net_pnl")
    g = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((p > 0).cast("double")).alias("w"), F.sum(F.when(p > 0, p)).alias("gain"),
        F.sum(F.when(p <= 0, -p)).alias("loss"), F.avg(F.when(p > 0, p)).alias("aw"), F.avg(F.when(p <= 0, p)).alias("al"),
    )
    on = lambda c: F.when(F.col("n_trades") >= least, c)
    return g.select(*by, "n_trades", on(F.col("w")).alias("win_rate"), on(F.try_divide("gain", "loss")).alias("profit_factor"), on(F.col("aw")).alias("avg_win"), on(F.col("al")).alias("avg_loss"))
