"""The profile of return series: all analyzers of an asset and bar type, and one family of its p-values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from . import profiling as P

#: The tests whose p-values are corrected together.
INFERENTIAL = ("ljung_box_returns", "ljung_box_squared", "variance_ratio", "bds", "arch_lm", "sign_bias_joint")
#: Least observations of an analyzer, of a volatility model, and of a law's fit.
LEAST, LEAST_GARCH, LEAST_FIT = 100, 500, 30
SCHEMA = "section string, name string, parameter string, value double, p double"


def acf(x: np.ndarray, lags: int) -> np.ndarray:
    d = x - x.mean()
    total = d @ d
    return np.array([d[k:] @ d[:-k] / total if total else 0.0 for k in range(1, lags + 1)])


def tier_of(n: int) -> str:
    return "A" if n > 2000 else "B" if n >= 500 else "C"


def distribution(x: np.ndarray, tier: str) -> list[tuple]:
    """Moments and Jarque-Bera; in tiers A and B the laws' fits and the distance from the normal."""
    n, s = len(x), float(x.std())
    d = x - x.mean()
    flat = n < 3 or s == 0
    skew, kurt = (0.0, 0.0) if flat else (float((d**3).mean() / s**3), float((d**4).mean() / s**4 - 3))
    jb = 0.0 if flat else n / 6 * (skew**2 + kurt**2 / 4)
    out = [("n", "", float(n), None), ("mean", "", float(x.mean()), None), ("std", "", float(x.std(ddof=1)) if n > 1 else 0.0, None)]
    out += [("skew", "", skew, None), ("kurtosis", "", kurt, None), ("jarque_bera", "", jb, float(np.exp(-jb / 2)))]
    if tier != "C" and n >= LEAST_FIT and not flat:
        fit = P.student_fit(x)
        out += [("student_t", k, v, None) for k, v in fit.items()]
        out.append(("ks_normal", "", *P.ks_normal(x)))
    return out


def serial(x: np.ndarray, tier: str, per_day: float) -> list[tuple]:
    """ACF, PACF, Ljung-Box of returns and squares, variance ratios with the joint test."""
    n = len(x)
    lags = min(40, n // 2 - 1)
    if lags < 1:
        return []
    rho, squared = acf(x, lags), acf(x**2, lags)
    out = [("acf", f"lag={k}", float(r), None) for k, r in enumerate(rho, 1)]
    out += [("pacf", f"lag={k}", float(r), None) for k, r in enumerate(P.pacf(list(rho)), 1)]
    for name, r in (("ljung_box_returns", rho), ("ljung_box_squared", squared)):
        for k in (5, 10, 20, 40):
            if k <= lags:
                q = float(n * (n + 2) * (r[:k] ** 2 / (n - np.arange(1, k + 1))).sum())
                out.append((name, f"lag={k}", q, tails.chi2_sf(q, k)))
    if tier != "C":
        ratios, top, joint = P.variance_ratios(x, per_day, short=tier == "B")
        for days, _, vr, z, p in ratios:
            out += [("variance_ratio", f"horizon={days}d", vr, p), ("variance_ratio_z", f"horizon={days}d", z, None)]
        if ratios:
            out.append(("chow_denning", "", top, joint))
    return out


def volatility(x: np.ndarray, tier: str, bar_type: str) -> list[tuple]:
    """Regime bounds; for time bars of tiers A and B the best GARCH and the tests on its residuals (tier A: GJR, BDS)."""
    out = []
    if len(x) >= 20:
        rv = pd.Series(x).rolling(20).std().dropna()
        out += [("regime_low", "", float(rv.quantile(0.25)), None), ("regime_high", "", float(rv.quantile(0.75)), None)]
    if not bar_type.startswith("time_") or tier == "C" or len(x) < LEAST_GARCH or x.std() == 0:
        return out
    law, fit = P.garch_best(x)
    out += [("garch", k, v, None) for k, v in fit.items()] + [("garch_law", law, fit["aic"], None), ("persistence", "", fit["alpha"] + fit["beta"], None)]
    z = P.std_residuals(x, fit)
    bias = P.sign_bias(z)
    out += [("sign_bias", k, bias[f"{k}_t"], bias[f"{k}_p"]) for k in ("sign", "negative", "positive")]
    out.append(("sign_bias_joint", "joint_f", bias["joint_f"], bias["joint_p"]))
    out.append(("arch_lm", "residuals", *P.arch_lm(z)))
    if tier == "A":
        if min(bias[f"{k}_p"] for k in ("sign", "negative", "positive")) < 0.05:
            out.append(("gjr_gamma", "", P.garch_fit(x, True, law)["gamma"], None))
        out += [("bds", f"dim={m}", s, p) for m, s, p in P.bds(z)]
    return out


def predictability(x: np.ndarray, tier: str, cost: float = 0.002) -> list[tuple]:
    """Entropy and complexity of ordinal patterns, effective size, least detectable and break-even accuracy, ridge on own lags."""
    n = len(x)
    if n < LEAST or tier == "C":
        return []
    out = []
    for d in range(3, 7):
        h, c = entropy_of(x, d)
        out += [("permutation_entropy", f"d={d}", h, None), ("complexity", f"d={d}", c, None)]
    n_eff = P.kish_n_eff(n, list(acf(x, min(40, n // 2 - 1))))
    z = tails.norm_ppf(0.95) + tails.norm_ppf(0.80)
    out += [("n_eff", "", n_eff, None), ("mde_da", "", float(min(1.0, max(0.5, 0.5 + z / (2 * n_eff**0.5)))), None)]
    mean_abs = float(abs(x).mean())
    out.append(("breakeven_da", "", float(min(1.0, 0.5 + cost / (2 * mean_abs))) if mean_abs else 1.0, None))
    lagged = np.column_stack([x[5 - k : n - k] for k in range(1, 6)])
    real, noise = P.snr_r2(lagged, x[5:])
    return [*out, ("snr_r2", "lags=5", real, None), ("snr_r2_noise", "lags=5", noise, None)]


def entropy_of(x: np.ndarray, d: int) -> tuple[float, float]:
    """Normalised permutation entropy and Jensen-Shannon complexity of the ordinal patterns of length d."""
    from math import factorial, log

    k = factorial(d)
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(x, d), axis=1, kind="stable")
    n = np.unique(order @ d ** np.arange(d), return_counts=True)[1]
    q = n / n.sum()
    entropy = lambda v: float(-(v * np.log(v)).sum())
    h = entropy(q)
    mid = np.concatenate([(q + 1 / k) / 2, np.full(k - len(q), 0.5 / k)])
    most = entropy(np.concatenate([[(1 + 1 / k) / 2], np.full(k - 1, 0.5 / k)])) - log(k) / 2
    norm = min(1.0, max(0.0, h / log(k)))
    return norm, max(0.0, entropy(mid) - (h + log(k)) / 2) / most * norm


def profile_single(x: np.ndarray, bar_type: str, per_day: float) -> list[tuple]:
    """(section, name, parameter, value, p) of one series; a section whose analyzer fails has one row `failed` with the kind of error."""
    t = tier_of(len(x))
    out: list[tuple] = []
    parts = {
        "distribution": lambda: distribution(x, t), "serial": lambda: serial(x, t, per_day),
        "volatility": lambda: volatility(x, t, bar_type), "predictability": lambda: predictability(x, t),
        "stationarity": lambda: [(k, "", v, s.get(f"{k}_p")) for s in [P.stationarity(x)] for k, v in s.items() if k in ("adf", "kpss")],
    }
    for section, run in parts.items():
        try:
            out += [(section, name, parameter, float(v), p) for name, parameter, v, p in run()]
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
            out.append((section, "failed", type(e).__name__, None, None))
    return out


def profile_all(df: DataFrame, ret: str = "ret") -> DataFrame:
    """(asset, bar_type, section, name, parameter, value, p) of every series of df(asset, bar_type, timestamp, ret).

    A series is one kernel: its fits are sequential. Series run side by side; one holds all bars of an asset, which time
    bounds (the reference's longest has 27 thousand).
    """

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("timestamp", kind="stable")
        g = g[np.isfinite(g[ret].to_numpy(float))]
        x = g[ret].to_numpy(float)
        days = (g["timestamp"].max() - g["timestamp"].min()).total_seconds() / 86400 if len(g) else 0.0
        rows = profile_single(x, key[1], max(1.0, len(x) / days) if days else 1.0) if len(x) else []
        out = pd.DataFrame(rows, columns=["section", "name", "parameter", "value", "p"])
        out.insert(0, "bar_type", key[1])
        out.insert(0, "asset", key[0])
        return out.astype({"value": float, "p": float})

    slim = df.select("asset", "bar_type", "timestamp", F.col(ret).cast("double").alias(ret))
    return slim.groupBy("asset", "bar_type").applyInPandas(one, f"asset string, bar_type string, {SCHEMA}")


def p_values(profile: DataFrame) -> DataFrame:
    """(asset, bar_type, test, parameter, p) of the inferential tests of a profile."""
    p = F.when(~F.isnan("p"), F.col("p"))
    return profile.filter(F.col("name").isin(*INFERENTIAL)).select("asset", "bar_type", F.col("name").alias("test"), "parameter", p.alias("p")).filter("p IS NOT NULL")


def corrected(profile: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p_values() with p_adj and reject by Benjamini and Hochberg over all pairs at once (one row a test)."""
    return P.benjamini_hochberg(p_values(profile), "p", alpha)
