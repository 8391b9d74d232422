"""Linear models from one aggregate of cross products: ridge, variance inflation, group ablation, Granger tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..functions import tail_columns as TC
from ..functions.windows import ordered
from ..sources.shared import materialize

#: The recommender's columns of each group that an ablation takes away.
GROUPS = {
    "classifier": ("clf_direction", "clf_confidence", "clf_rolling_accuracy", "forecast_agreement", "conviction_score"),
    "regressor": ("reg_predicted_return", "reg_prediction_std", "reg_quantile_spread", "reg_ci_width"),
    "regime": ("vol_regime", "mi_significant_regime", "rolling_perm_entropy"),
}
INFINITE = 1e10


def vif(df: DataFrame, names: Sequence[str], by: Sequence[str] = ("asset",)) -> DataFrame:
    """(by, feature, vif): variance inflation, the diagonal of the inverse correlation matrix of the rows that are finite in all names.

    Infinite for a column without variance, for those of an exact linear relation, above INFINITE, and for all of a group
    with fewer than len(names) + 2 such rows.
    """
    if not names:
        raise ValueError("names must not be empty")
    p = len(names)
    s = M.moments(df, names, by).withColumn("r", M.correlation(F.col("cross"), p))
    s = s.withColumn("m", M.swept(F.col("r"), range(p), M.LEAST))
    # a place that was passed over keeps a non-negative diagonal; it is a combination of the others with these coefficients
    i = F.col("i")
    bound = F.exists(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: (F.col("m")[k][k] >= 0) & ((k == i) | (F.abs(F.col("m")[i][k]) > 1e-5)))
    constant = F.sqrt(F.col("cross")[i][i] / F.col("n")) < 1e-15
    value = -F.col("m")[i][i]
    out = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    infinite = (F.col("n") < p + 2) | constant | bound | (value > INFINITE)
    names_ = F.array(*[F.lit(c) for c in names])
    found = out.select(*by, names_[i].alias("feature"), F.when(infinite, float("inf")).otherwise(value).alias("vif"))
    # groups without any finite row
    every = df.select(*by).distinct().withColumn("feature", F.explode(names_))
    return every.join(found, [*by, "feature"], "left").select(*by, "feature", F.coalesce("vif", F.lit(float("inf"))).alias("vif"))


def ridge_systems(train: DataFrame, names: Sequence[str], y: str, by: Sequence[str], alpha: float) -> DataFrame:
    """(by, n, means, m): the moments of (names, y) with alpha on the features' diagonal, swept at all features."""
    s = M.moments(train, [*names, y], by)
    floor = F.lit(M.LEAST) * F.aggregate(F.sequence(F.lit(0), F.lit(len(names) - 1)), F.lit(0.0), lambda acc, k: F.greatest(acc, F.col("cross")[k][k]))
    return s.withColumn("m", M.swept(M.ridged(F.col("cross"), len(names), alpha), range(len(names)), floor)).drop("cross")


def ablation_models(train: DataFrame, names: Sequence[str], y: str, groups: dict[str, Sequence[str]] = GROUPS, by: Sequence[str] = ("asset",), alpha: float = 1.0) -> DataFrame:
    """(by, models): an array with a struct (grp, removed, b, intercept) for the ridge on all names ("") and on those outside each group.

    All come from one pass over train: sweeping all features fits the full ridge, and sweeping a group's back out of it gives the
    ridge without them.
    """
    p = len(names)
    s = ridge_systems(train, names, y, by, alpha)
    models = []
    for grp, gone in {"": (), **groups}.items():
        out = [k for k, c in enumerate(names) if c in gone]
        m = M.swept(F.col("m"), out, 0.0, back=True) if out else F.col("m")
        kept = [k not in out for k in range(p)]
        b = TC.once(m, lambda m: F.array(*[m[k][p] if kept[k] else F.lit(0.0) for k in range(p)]))  # noqa: B023  called at once
        models.append(F.struct(F.lit(grp).alias("grp"), F.lit(len(out)).alias("removed"), b.alias("b")))
    s = s.withColumn("models", F.array(*models))
    centred = lambda b: F.col("means")[p] - F.aggregate(F.zip_with(b, F.slice("means", 1, p), lambda w, v: w * v), F.lit(0.0), lambda acc, v: acc + v)
    return s.select(*by, F.transform("models", lambda z: F.struct(z["grp"].alias("grp"), z["removed"].alias("removed"), z["b"].alias("b"), centred(z["b"]).alias("intercept"))).alias("models"))


def predictions(test: DataFrame, models: DataFrame, names: Sequence[str], by: Sequence[str] = ("asset",)) -> DataFrame:
    """test with `preds`: an array (grp, removed, pred) of each model's prediction. models has one row a key."""
    x = F.array(*[F.col(c).cast("double") for c in names])
    dot = lambda z: F.aggregate(F.zip_with(z["b"], x, lambda w, v: w * v), z["intercept"], lambda acc, v: acc + v)
    preds = F.transform("models", lambda z: F.struct(z["grp"].alias("grp"), z["removed"].alias("removed"), dot(z).alias("pred")))
    return test.filter(M.finite(names)).join(models, list(by)).withColumn("preds", preds).drop("models")


def diebold_mariano(df: DataFrame, a: str, b: str, by: Sequence[str], at: str = "timestamp") -> DataFrame:
    """(by, n, mean_a, mean_b, dm, p): the mean loss difference by its Newey-West deviation with n^(1/3) lags, t(n - 1) on both sides.

    Positive: a has the larger loss. Null where the variance is not positive or a series has fewer than two rows.
    """
    x = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__x", F.col(a) - F.col(b))
    s = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("__x").alias("__m"))
    # the float root that a plain n ** (1 / 3) gives, floored
    s = s.withColumn("__h", F.floor(F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))).cast("int"))
    most = s.agg(F.max("__h")).first()[0] or 0
    d = x.join(s.select(*by, "__m", "__h"), list(by)).withColumn("__d", F.col("__x") - F.col("__m"))
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-most, 0)
    back = F.reverse(F.collect_list("__d").over(w))  # own, then one row before, ...
    lagged = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size("__back") - 1, F.col("__h"))), F.lit(0.0),
        lambda acc, k: acc + F.col("__back")[k] * F.when(k == 0, 1.0).otherwise(2.0 * (1.0 - k / (F.col("__h") + 1))),
    )
    var = d.withColumn("__back", back).groupBy(*by).agg(F.sum(F.col("__d") * lagged).alias("__v"))
    out = s.join(var, list(by))
    lrv = F.col("__v") / F.col("n") / F.col("n")
    dm = F.when((F.col("n") >= 2) & (lrv > 0), F.col("__m") / F.sqrt(lrv))
    out = out.withColumn("dm", dm)
    p = F.when(F.col("dm").isNotNull(), 2 * TC.t_sf(F.abs("dm"), F.greatest(F.col("n") - 1, F.lit(1))))
    return out.select(*by, "n", "mean_a", "mean_b", "dm", p.alias("p"))


def ablation(train: DataFrame, test: DataFrame, names: Sequence[str], y: str = "actual", groups: dict[str, Sequence[str]] = GROUPS, alpha: float = 1.0) -> DataFrame:
    """(asset, grp, n_removed, n_remaining, n, rmse_full, rmse, rmse_change, mean_loss_full, mean_loss, dm, p) of each group left out.

    A ridge is fitted to all names and without each group's, from one pass over train (ablation_models()); losses are squared
    errors on test(asset, timestamp, names, y). dm is negative where the group helps. A group that holds no name changes
    nothing, so its dm is null; one that holds them all has no model and null results.
    """
    models = materialize(ablation_models(train, names, y, groups, alpha=alpha))
    got = predictions(test.filter(M.finite([y])), models, names)
    full = (F.col(y) - F.col("preds")[0]["pred"]) ** 2
    each = got.select("asset", "timestamp", full.alias("full"), F.col(y).alias("__y"), F.explode(F.slice("preds", 2, len(groups))).alias("z"))
    each = each.select("asset", "timestamp", F.col("z.grp").alias("grp"), F.col("z.removed").alias("n_removed"), "full", ((F.col("__y") - F.col("z.pred")) ** 2).alias("loss"))
    # read by several plans below
    each = materialize(each.withColumn("loss", F.when(F.col("n_removed") < len(names), F.col("loss"))))
    size = each.groupBy("asset", "grp").agg(F.first("n_removed").alias("n_removed"), F.avg("full").alias("__full"))
    dm = diebold_mariano(each, "full", "loss", ["asset", "grp"])
    out = size.join(dm, ["asset", "grp"], "left")
    return out.select(
        "asset", "grp", "n_removed", (F.lit(len(names)) - F.col("n_removed")).alias("n_remaining"), "n", F.sqrt("__full").alias("rmse_full"), F.sqrt("mean_b").alias("rmse"),
        (F.sqrt("mean_b") - F.sqrt("__full")).alias("rmse_change"), F.col("mean_a").alias("mean_loss_full"), F.col("mean_b").alias("mean_loss"), "dm", "p",
    )


def granger(df: DataFrame, cause: str, effect: str, lags: Sequence[int], by: Sequence[str] = ("asset",), at: str = "timestamp") -> DataFrame:
    """(by, lag, n, f, p): the F test that `lag` lags of cause add to those of effect, for each of lags.

    One aggregate a lag: the effect, its own lags and the cause's are swept in this order, so the residual sum of squares stands
    in the matrix before and after the cause's lags. The series' rows are those without a null in either.
    """
    w = Window.partitionBy(*by).orderBy(at)
    x = df.filter(M.finite([cause, effect])).select(*by, at, F.col(cause).alias("__x"), F.col(effect).alias("__y"))
    most = max(lags)
    x = x.select(*by, "__y", *[F.lag("__y", k).over(w).alias(f"__y{k}") for k in range(1, most + 1)], *[F.lag("__x", k).over(w).alias(f"__x{k}") for k in range(1, most + 1)])
    out = None
    for k in lags:
        names = [*[f"__y{j}" for j in range(1, k + 1)], *[f"__x{j}" for j in range(1, k + 1)], "__y"]
        s = M.moments(x, names, by)
        floor = F.lit(M.LEAST) * F.greatest(*[F.col("cross")[i][i] for i in range(2 * k)])
        s = s.withColumn("own", M.swept(F.col("cross"), range(k), floor))
        s = s.withColumn("all", M.swept(F.col("own"), range(k, 2 * k), floor))
        df2 = F.col("n") - 2 * k - 1
        r0, r1 = F.col("own")[2 * k][2 * k], F.col("all")[2 * k][2 * k]
        f = F.when((F.col("n") > 2 * k + 1) & (r1 > 0), (r0 - r1) / k / (r1 / df2))
        one = s.select(*by, F.lit(k).alias("lag"), "n", f.alias("f"), F.when(f.isNotNull(), TC.f_sf(f, F.lit(k), df2)).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


def har(df: DataFrame, rv: str = "rv", spans: Sequence[int] = (1, 5, 22), train_share: float = 0.7) -> DataFrame:
    """(asset, timestamp, predicted_vol) of each asset's last rows: least squares of rv on the means of its last 1, 5 and 22 values,
    fitted to the first rows; the prediction is read as a variance, 1e-12 at least, and its root is returned."""
    mean = lambda n: F.when(F.count(rv).over(ordered().rowsBetween(-n, -1)) >= n, F.avg(rv).over(ordered().rowsBetween(-n, -1)))
    names = [f"__m{n}" for n in spans]
    x = df.select("asset", "timestamp", F.col(rv).alias("__y"), *[mean(n).alias(c) for n, c in zip(spans, names)]).dropna()
    n = x.groupBy("asset").agg(F.floor(F.count(F.lit(1)) * F.lit(train_share)).alias("__cut"))
    x = x.withColumn("__pos", F.row_number().over(ordered()) - 1).join(n, "asset")
    models = ablation_models(x.filter(F.col("__pos") < F.col("__cut")), names, "__y", {}, alpha=0.0)
    got = predictions(x.filter(F.col("__pos") >= F.col("__cut")), models, names)
    return got.select("asset", "timestamp", F.sqrt(F.greatest(F.col("preds")[0]["pred"], F.lit(1e-12))).alias("predicted_vol"))


def arch_lm(df: DataFrame, c: str = "ret", lags: int = 10, by: Sequence[str] = ("asset",), at: str = "timestamp") -> DataFrame:
    """(by, lm, p): n R^2 of c^2 on its own lags, and its chi-square tail. Null without a deviation or with too few rows."""
    w = Window.partitionBy(*by).orderBy(at)
    x = df.filter(M.finite([c])).select(*by, at, (F.col(c) * F.col(c)).alias("__y"))
    names = [f"__l{k}" for k in range(1, lags + 1)]
    s = M.moments(x.select(*by, "__y", *[F.lag("__y", k).over(w).alias(n) for k, n in enumerate(names, 1)]), [*names, "__y"], by)
    total = F.col("cross")[lags][lags]
    s = s.withColumn("m", M.swept(F.col("cross"), range(lags), F.lit(M.LEAST) * total))
    lm = F.when((F.col("n") > lags + 1) & (total > 0), F.col("n") * (1 - F.col("m")[lags][lags] / total))
    every = df.select(*by).distinct()
    out = every.join(s.select(*by, lm.alias("lm")), list(by), "left")
    return out.withColumn("p", F.when(F.col("lm").isNotNull(), TC.chi2_sf(F.greatest(F.col("lm"), F.lit(0.0)), F.lit(lags))))


def sign_bias(df: DataFrame, c: str = "ret", by: Sequence[str] = ("asset",), at: str = "timestamp") -> DataFrame:
    """(by, sign_t, sign_p, negative_t, ..., joint_f, joint_p): Engle and Ng's regression of z^2 on S, S z and (1 - S) z of the row before,
    z = c by its deviation, S = [z < 0]; two-sided t tails and the joint F."""
    w = Window.partitionBy(*by).orderBy(at)
    z = df.filter(M.finite([c])).select(*by, at, (F.col(c) / F.nullif(F.stddev_pop(c).over(Window.partitionBy(*by)), F.lit(0.0))).alias("__z"))
    before = F.lag("__z").over(w)
    down = F.when(before.isNotNull(), (before < 0).cast("double"))
    names = ["sign", "negative", "positive"]
    x = z.select(*by, down.alias("sign"), (down * before).alias("negative"), ((1 - down) * before).alias("positive"), (F.col("__z") * F.col("__z")).alias("__y"))
    s = M.moments(x, [*names, "__y"], by)
    s = s.withColumn("m", M.swept(F.col("cross"), range(3), F.lit(M.LEAST) * F.greatest(*[F.col("cross")[k][k] for k in range(3)])))
    dof, rss, total = F.greatest(F.col("n") - 4, F.lit(1)), F.col("m")[3][3], F.col("cross")[3][3]
    t = [F.col("m")[k][3] / F.greatest(F.sqrt(F.greatest(rss / dof * -F.col("m")[k][k], F.lit(0.0))), F.lit(1e-15)) for k in range(3)]
    s = s.select(*by, dof.alias("__dof"), *[v.alias(f"{name}_t") for name, v in zip(names, t)], F.try_divide((total - rss) / 3, rss / dof).alias("joint_f"))
    p = {f"{name}_p": 2 * TC.t_sf(F.abs(f"{name}_t"), F.col("__dof")) for name in names}
    s = s.withColumns({**p, "joint_p": TC.f_sf(F.col("joint_f"), F.lit(3), F.col("__dof"))})
    return s.select(*by, *[f"{name}_{k}" for name in names for k in "tp"], "joint_f", "joint_p")
