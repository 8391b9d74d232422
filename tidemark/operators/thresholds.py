"""Research thresholds, as scalars and for tables of series."""

from __future__ import annotations

from math import ceil, e, log, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import norm_cdf, norm_ppf


def breakeven_da(mean_abs: float, cost: float) -> float:
    return min(1.0, max(0.5, 0.5 + cost / (2 * mean_abs))) if mean_abs > 0 else 1.0


def mde_da(n_eff: float, alpha: float = 0.05, power: float = 0.8) -> float:
    return min(1.0, max(0.5, 0.5 + (norm_ppf(1 - alpha) + norm_ppf(power)) / (2 * sqrt(n_eff)))) if n_eff > 0 else 1.0


def feasibility(breakeven: float, mde: float, margin: float = 0.01) -> str:
    gap = breakeven - mde
    return "feasible" if gap > margin else "marginal" if gap >= -margin else "underpowered"


def harvey_z(trials: int, alpha: float = 0.05, least: float = 3.0) -> float:
    return max(least, norm_ppf(1 - alpha / (2 * max(trials, 1))))


def deflated_sharpe(sharpe: float, n: int, trials: int, skew: float = 0.0, excess_kurtosis: float = 0.0, spread: float | None = None) -> float:
    """Probability that the Sharpe ratio beats the best of `trials` lucky ones (Bailey and Lopez de Prado, 2014)."""
    euler = 0.5772156649015329
    spread = 1 / sqrt(n - 1) if spread is None and n > 1 else spread or 0.0  # the trials' spread under the null
    lucky = 0.0
    if trials > 1:
        lucky = spread * ((1 - euler) * norm_ppf(1 - 1 / trials) + euler * norm_ppf(1 - 1 / (trials * e)))
    den = 1 - skew * sharpe + (excess_kurtosis + 2) / 4 * sharpe**2
    return norm_cdf((sharpe - lucky) * sqrt(n - 1) / sqrt(den)) if den > 0 and n > 1 else float("nan")


def required_n(breakeven: float, alpha: float = 0.05, power: float = 0.8) -> int | None:
    edge = breakeven - 0.5
    return ceil(((norm_ppf(1 - alpha) + norm_ppf(power)) / (2 * edge)) ** 2) if edge > 0 else None


def mi_threshold(variance: float, share: float = 0.01) -> float:
    return share * 0.5 * log(2 * pi * e * variance)


def vif_threshold(strict: bool = True) -> float:
    return 5.0 if strict else 10.0


def stability_threshold(windows: int, share: float = 0.5) -> int:
    return ceil(windows * share)


def wald_ci(p: float, n: int, level: float = 0.95) -> tuple[float, float]:
    half = norm_ppf((1 + level) / 2) * sqrt(p * (1 - p) / n)
    return p - half, p + half


def binomial_power(p: float, n: int, alpha: float = 0.05) -> float:
    return norm_cdf((p - 0.5) * 2 * sqrt(n) - norm_ppf(1 - alpha)) if n else 0.0


def all_thresholds(series: DataFrame, cost: float = 0.002, features: int = 23, bar_types: int = 5, horizons: int = 3, alpha: float = 0.05, power: float = 0.8, windows: int = 4) -> DataFrame:
    """series(asset, bar_type, n_bars, n_eff, mean_abs_return) with all thresholds of each: break-even and least detectable
    directional accuracy, their gap and whether it is feasible, the multiple-testing z, the VIF bound, the windows that a
    feature must hold in, and the effective rows that break-even needs."""
    z = norm_ppf(1 - alpha) + norm_ppf(power)
    between = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.5), v))
    breakeven = F.when(F.col("mean_abs_return") > 0, between(0.5 + F.lit(cost) / (2 * F.col("mean_abs_return")))).otherwise(1.0)
    mde = F.when(F.col("n_eff") > 0, between(0.5 + F.lit(z) / (2 * F.sqrt("n_eff")))).otherwise(1.0)
    out = series.withColumns({"breakeven_da": breakeven, "mde_da": mde})
    gap, edge = F.col("breakeven_da") - F.col("mde_da"), F.col("breakeven_da") - 0.5
    status: Column = F.when(gap > 0.01, "feasible").when(gap >= -0.01, "marginal").otherwise("underpowered")
    needed = F.when(edge > 0, F.pow(F.lit(z) / (2 * edge), F.lit(2.0))).otherwise(float("inf"))
    return out.withColumns({
        "gap": gap, "feasibility": status, "harvey_z": F.lit(harvey_z(features * bar_types * horizons, alpha)), "vif_threshold": F.lit(vif_threshold()),
        "stability_windows": F.lit(stability_threshold(windows)), "n_eff_required": needed,
    })
