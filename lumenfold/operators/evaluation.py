"""Benchmark results over time: strata, growth, forecasts and bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log_growth
from .ordering import null_safe_left, quantiles
from .stats import correlation, spearman


def growth_intervals(df: DataFrame, family: str, when: str, value: str, low: int = 90, high: int = 730) -> DataFrame:
    """family, start, days, growth of adjacent pairs low..high days apart."""
    w = Window.partitionBy(family).orderBy(when, value)
    x = df.select(family, F.col(when).alias("start"), F.col(value).cast("double").alias("_a"), F.lead(when).over(w).alias("_n"), F.lead(value).over(w).cast("double").alias("_b"))
    x = x.withColumn("days", F.datediff("_n", "start")).where(F.col("days").between(low, high))
    return x.select(family, "start", "days", log_growth(F.col("_a"), F.col("_b"), F.col("days").cast("double")).alias("growth")).where(F.col("growth").isNotNull())


def growth_rate(intervals: DataFrame, family: str, families: int = 3, least: int = 10, assumed: float | None = None) -> DataFrame:
    """status, rate, low, high: family-equal quantiles of family medians, or NOT_IDENTIFIABLE with the assumed rate."""
    per = intervals.groupBy(family).agg(F.percentile("growth", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    x = per.agg(
        F.count("*").alias("n_families"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_intervals"),
        *[F.percentile("m", F.lit(q)).alias(k) for q, k in ((0.5, "rate"), (0.1, "low"), (0.9, "high"))],
    )
    ok = (F.col("n_families") >= families) & (F.col("n_intervals") >= least)
    return x.select(
        "n_families", "n_intervals", F.when(ok, "IDENTIFIED").otherwise("NOT_IDENTIFIABLE").alias("status"),
        F.when(ok, F.col("rate")).otherwise(F.lit(assumed)).alias("rate"), F.when(ok, F.col("low")).alias("low"), F.when(ok, F.col("high")).alias("high"),
    )


def strata(df: DataFrame, by: list[str], value: str, least: int = 5) -> DataFrame:
    """n, status and quantiles; a stratum of fewer rows is labelled, not dropped."""
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    g = null_safe_left(df.groupBy(*by).agg(F.count(value).alias("n")), quantiles(df, by, value, shares), by)
    ok = F.col("n") >= least
    return g.select(*by, "n", F.when(ok, "DESCRIBED").otherwise("TOO_FEW").alias("status"), *[F.when(ok, F.col(k)).alias(k) for k in shares])


def monthly_frontier(df: DataFrame, by: list[str], when: str, value: str) -> DataFrame:
    """month, best of the month and the running best: months are few per series, rows are not."""
    m = df.groupBy(*by, F.date_format(when, "yyyy-MM").alias("month")).agg(F.max(value).alias("best"))
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("frontier", F.max("best").over(w))


def contribution(b_compute: Column, d_log_compute: Column, b_time: Column, d_time: Column) -> list[Column]:
    """Signed parts and absolute shares of a change."""
    c, t = b_compute * d_log_compute, b_time * d_time
    whole = F.abs(c) + F.abs(t)
    share = lambda x: F.when(whole > 0, F.abs(x) / F.when(whole > 0, whole))
    return [c.alias("from_compute"), t.alias("from_time"), share(c).alias("share_compute"), share(t).alias("share_time")]


def forecast(rows: DataFrame, months: list[int], when: str, value: Column, rate: Column, low: float, high: float) -> DataFrame:
    """A row per horizon: target date, raw value, clipped value and whether the raw one was in range."""
    h = F.explode(F.array(*[F.lit(m) for m in months]))
    x = rows.withColumn("horizon_months", h).withColumn("target_date", F.add_months(when, F.col("horizon_months")))
    x = x.withColumn("raw", value + rate * F.col("horizon_months") / 12.0)
    return x.withColumn("clipped", F.least(F.greatest("raw", F.lit(low)), F.lit(high))).withColumn("in_range", F.col("raw").between(low, high))


def loss_sensitivities(n: Column, d: Column, law: dict) -> list[Column]:
    """Partials, elasticities and the equal-loss substitution dlnN/dlnD."""
    dn = -law["alpha"] * law["a"] * F.pow(n, F.lit(-law["alpha"] - 1))
    dd = -law["beta"] * law["b"] * F.pow(d, F.lit(-law["beta"] - 1))
    loss = law["e"] + law["a"] * F.pow(n, F.lit(-law["alpha"])) + law["b"] * F.pow(d, F.lit(-law["beta"]))
    return [loss.alias("loss"), dn.alias("d_n"), dd.alias("d_d"), (dn * n / loss).alias("e_n"), (dd * d / loss).alias("e_d"), (-(dd * d) / (dn * n)).alias("substitution")]


def upgrade_gate(gains: DataFrame, by: list[str]) -> DataFrame:
    """gains: protocol, mean_gain, q90_gain, sign_share.  Two protocols gain 5 % on both, none is worse than -10 %."""
    g = gains.groupBy(*by).agg(
        F.count_if((F.col("mean_gain") >= 0.05) & (F.col("q90_gain") >= 0.05)).alias("_k"),
        F.min(F.least("mean_gain", "q90_gain")).alias("_w"),
        F.min("sign_share").alias("_s"),
    )
    ok = (F.col("_k") >= 2) & (F.col("_w") >= -0.10) & (F.col("_s") >= 0.8)
    return g.select(*by, F.when(F.col("_w").isNull(), "INSUFFICIENT").when(ok, "UPGRADE").otherwise("KEEP").alias("decision"))


def qualification(df: DataFrame, by: list[str], actual: str, predicted: str, cluster: str) -> DataFrame:
    """External validation: normalised RMSE and bias at most 0.25, rank correlation at least 0.5, 5 rows and 2 clusters.

    A rank correlation that is not defined does not count against a source.
    """
    x = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(predicted) - F.col(actual)
    g = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct(cluster).alias("clusters"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.stddev_samp(actual).alias("sd"),
    )
    g = null_safe_left(g, spearman(x, by, actual, predicted).drop("n"), by)
    enough = (F.col("n") >= 5) & (F.col("clusters") >= 2)
    ok = (F.col("sd") > 0) & (F.col("rmse") <= 0.25 * F.col("sd")) & (F.abs("bias") <= 0.25 * F.col("sd")) & F.coalesce(F.col("rho") >= 0.5, F.lit(True))
    return g.withColumn("status", F.when(~enough, "STRESS_ONLY").when(F.coalesce(ok, F.lit(False)), "SUPPORTED").otherwise("FAILED"))


def bias_direction(mean: Column) -> Column:
    return F.when(mean > 0, "OVER").when(mean < 0, "UNDER").otherwise("NONE")


def bias_audit(df: DataFrame, error: str, variable: str, cluster: str, least: int = 5) -> DataFrame:
    """audit, stratum, n, mean_error, rmse, positive_share, rho, direction: overall, the trend over a variable, its quarters, and clusters of `least` rows.

    Quarters are those of the variable's quantiles, closed on the right; equal breaks make fewer of them.
    """
    x = df.where(F.col(error).isNotNull()).select(F.col(error).alias("_e"), F.col(variable).alias("_v"), F.col(cluster).cast("string").alias("_c"))
    described = [F.count("*").alias("n"), F.avg("_e").alias("mean_error"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg((F.col("_e") > 0).cast("int")).alias("positive_share")]
    none = F.lit(None).cast("double").alias("rho")
    full = lambda g, audit, stratum: g.select(F.lit(audit).alias("audit"), stratum.alias("stratum"), "n", "mean_error", "rmse", "positive_share", none, bias_direction(F.col("mean_error")).alias("direction"))  # noqa: E731,E501
    overall = full(x.agg(*described), "OVERALL", F.lit("all"))
    breaks = quantiles(x, [], "_v", {"b1": 0.25, "b2": 0.5, "b3": 0.75})
    quarter = F.when(F.col("_v") <= F.col("b1"), 1).when(F.col("_v") <= F.col("b2"), 2).when(F.col("_v") <= F.col("b3"), 3).otherwise(4)
    q = x.where(F.col("_v").isNotNull()).crossJoin(F.broadcast(breaks)).groupBy(quarter.cast("string").alias("_q")).agg(*described)  # one row of breaks
    c = x.groupBy("_c").agg(*described).where(F.col("n") >= least)
    t = spearman(x, [], "_v", "_e").where(F.col("n") >= least)
    lean = F.when(F.col("rho") > 0.1, "RISES").when(F.col("rho") < -0.1, "FALLS").otherwise("WEAK")
    null = lambda k: F.lit(None).cast("double").alias(k)
    t = t.where(F.col("rho").isNotNull()).select(F.lit("TREND").alias("audit"), F.lit("all").alias("stratum"), "n", null("mean_error"), null("rmse"), null("positive_share"), "rho", lean.alias("direction"))
    return overall.unionByName(t).unionByName(full(q, "QUARTER", F.col("_q"))).unionByName(full(c, "CLUSTER", F.col("_c")))


def bridge(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Per stratum and for ALL: n, pearson, spearman, slope, intercept, and leave-one-out errors of y ~ x against the mean.

    Sums first, then one pass with the closed form e / (1 - h); a row without x or y is left out.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.explode(F.array(F.col(by).cast("string"), F.lit("ALL"))).alias("stratum"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    s = d.groupBy("stratum").agg(
        F.count("*").alias("n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), (F.var_pop("_x") * F.count("*")).alias("_sxx"),
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), correlation("_x", "_y").alias("pearson"),
    )
    r = null_safe_left(d, F.broadcast(s), ["stratum"])  # a row per stratum
    h = 1 / F.col("n") + F.pow(F.col("_x") - F.col("_mx"), F.lit(2.0)) / F.col("_sxx")
    r = r.withColumn("_e", (F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")) / (1 - h))
    r = r.withColumn("_m", (F.col("_y") - F.col("_my")) * F.col("n") / (F.col("n") - 1)).withColumn("_p", F.col("_y") - F.col("_e"))
    sq = lambda c: F.col(c) * F.col(c)
    loo = r.groupBy("stratum").agg(
        F.sqrt(F.avg(sq("_e"))).alias("loo_rmse"), F.avg(F.abs("_e")).alias("loo_mae"), (1 - F.sum(sq("_e")) / F.sum(F.pow(F.col("_y") - F.col("_my"), F.lit(2.0)))).alias("loo_r2"),
        F.sqrt(F.avg(sq("_m"))).alias("mean_rmse"), F.count_if((F.col("_p") < 0) | (F.col("_p") > 100)).alias("n_outside"),
    )
    out = null_safe_left(s.drop("_mx", "_my", "_sxx"), loo, ["stratum"])
    return null_safe_left(out, spearman(d, ["stratum"], "_x", "_y").select("stratum", F.col("rho").alias("spearman")), ["stratum"])


def transport(df: DataFrame, scale: str, row: str, domain: str, actual: str, predicted: str, train_mean: str) -> DataFrame:
    """Per scale, of a fixed model's predictions (a row per case and domain): errors over all, of the mean over domains, and the gain on the training means."""
    e = F.col(predicted) - F.col(actual)
    b = F.col(train_mean) - F.col(actual)
    per = df.groupBy(scale, domain).agg(F.avg(e * e).alias("_mse"), F.avg(b * b).alias("_base"), F.var_pop(actual).alias("_v"), F.avg(F.abs(e)).alias("_mae"), F.count("*").alias("_n"))
    a = per.groupBy(scale).agg(
        F.sqrt(F.sum(F.col("_mse") * F.col("_n")) / F.sum("_n")).alias("rmse_all"), (F.sum(F.col("_mae") * F.col("_n")) / F.sum("_n")).alias("mae_all"),
        F.avg(F.when(F.col("_v") > 0, 1 - F.col("_mse") / F.when(F.col("_v") > 0, F.col("_v")))).alias("r2_domains"), F.avg("_mse").alias("mse"), F.avg("_base").alias("base_mse"),
    )
    m = df.groupBy(scale, row).agg(F.avg(actual).alias("_a"), F.avg(predicted).alias("_p"))
    g = F.col("_p") - F.col("_a")
    c = m.groupBy(scale).agg(F.count("*").alias("n"), F.sqrt(F.avg(g * g)).alias("rmse_mean"), F.avg(F.abs(g)).alias("mae_mean"))
    out = null_safe_left(a, c, [scale])
    out = null_safe_left(out, spearman(m, [scale], "_a", "_p").select(scale, F.col("rho").alias("spearman")), [scale])
    return out.withColumn("gain", 1 - F.col("mse") / F.when(F.col("base_mse") > 0, F.col("base_mse")))


def fit_gates(folds: DataFrame, split: str, null: str, candidate: str, slope: str, full_rank: bool = True) -> DataFrame:
    """Per split, of a row per fold: macro gain of at least 5 %, at least 80 % of folds within 1.10 of the null model and with a negative slope, and a Jacobian of full rank."""
    good = F.col(null).isNotNull() & F.col(candidate).isNotNull()
    g = folds.where(good).groupBy(split).agg(
        F.count("*").alias("n_folds"), F.avg(null).alias("macro_null"), F.avg(candidate).alias("macro_candidate"),
        F.count_if(F.col(candidate) <= 1.10 * F.col(null)).alias("n_ratio"), F.count_if(F.col(slope) < 0).alias("n_negative"),
    )
    g = g.withColumn("gain", F.when(F.col("macro_null") > 0, 1 - F.col("macro_candidate") / F.col("macro_null")))
    need = F.ceil(F.lit(0.8) * F.col("n_folds"))
    ok = (F.col("gain") >= 0.05) & (F.col("n_ratio") >= need) & (F.col("n_negative") >= need) & F.lit(full_rank)
    return g.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL"))


def near_tie(df: DataFrame, by: list[str], name: str, score: str, priority: list[str], tolerance: float = 0.01) -> DataFrame:
    """by, chosen, best: of the configurations within 1 % of the least score, the first in the order of priority; others follow by name."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(name))
    best = df.groupBy(*by).agg(F.min(score).alias("best"))
    x = null_safe_left(df, F.broadcast(best), by) if by else df.crossJoin(F.broadcast(best))  # a row per group
    x = x.where(F.col(score) <= (1 + tolerance) * F.col("best"))
    order = F.struct(F.when(rank > 0, rank).otherwise(len(priority) + 1), F.col(name))
    return x.groupBy(*by).agg(F.min_by(name, order).alias("chosen"), F.min("best").alias("best"), F.count("*").alias("n_near"))
