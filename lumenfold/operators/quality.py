"""Quality scores of documents: features, bounds from calibration rows, strict groups and penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.hashing import role
from .bootstrap import poisson_weight
from .ordering import null_safe_left, quantiles
from .stats import rank_grid, spearman, weighted_quantiles
from .summary import with_all

FEATURES = ("n_words", "mean_word_length", "unique_share", "no_alpha_share", "n_sentences")
BOUNDED = ("mean_word_length", "unique_share", "no_alpha_share")


def text_features(docs: DataFrame, key: str = "doc_id", body: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Cheap features of a text; shares are NULL for a text without words."""
    t = F.coalesce(F.col(body), F.lit(""))
    x = docs.select(key, *keep, t.alias("_t"))
    # counts by patterns: no array of words but the distinct ones
    n = F.regexp_count("_t", F.lit("[^ \t\n\r]+"))
    some = F.when(n > 0, n)
    plain = F.regexp_count("_t", F.lit("(?<![^ \t\n\r])[^A-Za-z \t\n\r]+(?![^ \t\n\r])"))
    return x.select(
        key,
        *keep,
        n.cast("long").alias("n_words"),
        (F.length(F.translate("_t", " \t\n\r", "")) / some).alias("mean_word_length"),
        (F.size(F.array_remove(F.array_distinct(F.split("_t", "[ \t\n\r]+")), "")) / some).alias("unique_share"),
        (plain / some).alias("no_alpha_share"),
        F.regexp_count("_t", F.lit("[.!?]")).cast("long").alias("n_sentences"),
        role(F.col(key).cast("string")).alias("role"),
    )


def calibration_bounds(features: DataFrame, values: tuple[str, ...], domain: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row of <value>_lo and <value>_hi: weighted quantiles of calibration rows, each domain of equal total weight.

    All values are bounded in one pass, in long form.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("v")) for v in values]))
    x = features.where(F.col("role") == "calibration").select(domain, rows.alias("_x")).select(domain, "_x.*")
    # distinct values with their rows: what is left to weigh and to sort
    x = x.where(F.col("v").isNotNull()).groupBy("feature", domain, "v").agg(F.count("*").alias("_c"))
    sizes = x.groupBy("feature", domain).agg(F.sum("_c").alias("_n"))
    k = sizes.groupBy("feature").agg(F.count("*").alias("_k"))
    sizes = sizes.join(k, "feature")  # a row per feature and domain
    x = x.join(sizes, ["feature", domain]).withColumn("_u", 1.0 / (F.col("_k") * F.col("_n"))).withColumn("_w", F.col("_c") * F.col("_u"))
    q = weighted_quantiles(x, ["feature"], "v", "_w", {"_lo": low, "_hi": high}, "_u")
    pick = lambda v, k: F.max(F.when(F.col("feature") == v, F.col(k))).alias(f"{v}{k}")
    return q.agg(*[pick(v, k) for v in values for k in ("_lo", "_hi")])


def scored(features: DataFrame, domain: str = "lang") -> DataFrame:
    """Normalised features and q: the strict mean, missing if one is missing.

    The bounds, one row, are taken first; `features` is read twice and had better be a written table.
    """
    limits = calibration_bounds(features, BOUNDED, domain).first()
    at = lambda v, k: F.lit(limits[f"{v}_{k}"]).cast("double")
    x = features.withColumns({f"z_{v}": numeric.clipped(F.col(v), at(v, "lo"), at(v, "hi")) for v in BOUNDED})
    return x.withColumn("q", numeric.strict_mean(*[F.col(f"z_{v}") for v in BOUNDED]))


def imputed(scores: DataFrame, value: str, domain: str, least: int = 100, coverage: float = 0.95) -> DataFrame:
    """value_imputed beside value: the domain's calibration median, where the gate allows it; no fallback."""
    x = scores.where(F.col("role") == "calibration")
    g = x.groupBy(domain).agg(F.count("*").alias("_n"), F.count(value).alias("_v"), (F.min(value) < F.max(value)).alias("_d"))
    m = quantiles(x, [domain], value, {"_m": 0.5})
    open_ = (F.col("_n") >= least) & (F.col("_v") >= F.lit(coverage) * F.col("_n")) & F.col("_d")
    g = null_safe_left(g, m, [domain]).select(domain, F.when(open_, F.col("_m")).alias("_m"))
    x = null_safe_left(scores, g, [domain])
    return x.withColumn(f"{value}_imputed", F.coalesce(F.col(value), F.col("_m"))).drop("_m")


def thresholds(features: DataFrame, values: tuple[str, ...], domain: str, least: int = 30) -> DataFrame:
    """Per domain and value: <v>_n, <v>_q95, <v>_q99 of calibration rows; <v>_active where rows suffice and q99 > q95."""
    x = features.where(F.col("role") == "calibration")
    g = x.groupBy(domain).agg(*[F.count(v).alias(f"{v}_n") for v in values])
    long = x.select(domain, F.inline(F.array(*[F.struct(F.lit(v).alias("_f"), F.col(v).cast("double").alias("_v")) for v in values])))
    q = quantiles(long, [domain, "_f"], "_v", {"q95": 0.95, "q99": 0.99})
    q = q.groupBy(domain).agg(*[F.max(F.when(F.col("_f") == v, F.col(k))).alias(f"{v}_{k}") for v in values for k in ("q95", "q99")])
    g = null_safe_left(g, q, [domain])
    active = lambda v: F.coalesce((F.col(f"{v}_n") >= least) & (F.col(f"{v}_q99") > F.col(f"{v}_q95")), F.lit(False))
    return g.withColumns({f"{v}_active": active(v) for v in values})


def candidate(q: Column, p2: Column, p3: Column, rate: float) -> Column:
    """q (1 - rate (p2 + p3) / 2)"""
    return q * (1 - F.lit(rate) * (p2 + p3) / 2)


def support_status(q: Column, active: Column, penalty: Column) -> Column:
    return F.when(q.isNull(), "MISSING_Q").when(~F.coalesce(active, F.lit(False)), "DOMAIN_INACTIVE").when(penalty.isNull(), "MISSING_INDICATOR").otherwise("SUPPORTED")


def penalised(scores: DataFrame, indicators: tuple[str, str], domain: str, rate: float = 0.02) -> DataFrame:
    """p2, p3, q_c and status against the domain's frozen thresholds."""
    x = null_safe_left(scores, F.broadcast(thresholds(scores, indicators, domain)), [domain])  # a row per domain
    for name, v in zip(("p2", "p3"), indicators, strict=True):
        low, high = F.col(f"{v}_q95"), F.col(f"{v}_q99")
        x = x.withColumn(name, F.when(F.col(f"{v}_active"), numeric.ramp(F.col(v), low, F.when(high > low, high).otherwise(low + 1))))
    ok = F.col(f"{indicators[0]}_active") & F.col(f"{indicators[1]}_active")
    x = x.withColumn("q_c", candidate(F.col("q"), F.col("p2"), F.col("p3"), rate))
    x = x.withColumn("status", support_status(F.col("q"), ok, F.col("p2") + F.col("p3")))
    return x.drop(*[f"{v}_{k}" for v in indicators for k in ("n", "q95", "q99", "active")])


def conflict_direction(a: Column, b: Column, c: Column, names: tuple[str, str, str]) -> Column:
    """The pair of the largest gap as high>low; the first pair on ties."""
    pairs = [(a, b, names[0], names[1]), (a, c, names[0], names[2]), (b, c, names[1], names[2])]
    best = F.greatest(*[F.abs(x - y) for x, y, _, _ in pairs])
    out = None
    for x, y, m, n in pairs:
        label = F.when(x >= y, f"{m}>{n}").otherwise(f"{n}>{m}")
        hit = F.abs(x - y) == best
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(a.isNull() | b.isNull() | c.isNull(), F.lit(None)).otherwise(out)


def stability(ratio: Column, jaccard: Column, rho: Column) -> Column:
    return (
        F.when((rho >= 0.95) & (jaccard >= 0.8) & (ratio <= 0.05), "STABLE").when((rho >= 0.8) & (jaccard >= 0.5), "PARTIALLY_STABLE").otherwise("NOT_STABLE")
    )


def stability_bootstrap(scores: DataFrame, indicators: tuple[str, str], domain: str, key: str, reps: int, seed: str, rate: float = 0.02) -> DataFrame:
    """domain, replicate, mae, rho, jaccard: each replicate refits the thresholds on rows drawn with replacement and scores all rows by them.

    The draws are Poisson(1) weights from digests.  A replicate whose thresholds do not part is
    NULL throughout.  `scores` has q and the indicators of each row; rows that lack one are left out.
    """
    x = scores.where(F.col("q").isNotNull() & F.col(indicators[0]).isNotNull() & F.col(indicators[1]).isNotNull())
    x = x.select(F.col(domain).alias("_dom"), F.col(key).alias("_key"), "q", *[F.col(v).cast("double").alias(f"_x{i}") for i, v in enumerate(indicators)])
    drawn = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps))).alias("_rep"))
    # replicate 0 is the sample itself
    drawn = drawn.withColumn("_w", F.when(F.col("_rep") == 0, 1).otherwise(poisson_weight(F.lit(seed), F.col("_rep"), F.col("_key"))))
    long = drawn.select("_dom", "_rep", "_w", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_x{i}").alias("_v")) for i in range(2)])))
    t = quantiles(long, ["_dom", "_rep", "_i"], "_v", {"a": 0.95, "b": 0.99}, "_w")
    t = t.groupBy("_dom", "_rep").agg(*[F.max(F.when(F.col("_i") == i, F.col(k))).alias(f"_{k}{i}") for i in range(2) for k in ("a", "b")])
    penalty = lambda i: numeric.ramp(F.col(f"_x{i}"), F.col(f"_a{i}"), F.when(F.col(f"_b{i}") > F.col(f"_a{i}"), F.col(f"_b{i}")).otherwise(F.col(f"_a{i}") + 1))  # noqa: E731,E501
    y = null_safe_left(drawn.select("_dom", "_rep", "_key", "q", "_x0", "_x1"), F.broadcast(t), ["_dom", "_rep"])  # a row per domain and replicate
    y = y.withColumn("_ok", (F.col("_b0") > F.col("_a0")) & (F.col("_b1") > F.col("_a1"))).withColumn("_p", (penalty(0) + penalty(1)) / 2)
    base = y.where("_rep = 0").select("_dom", "_key", F.col("_p").alias("_p0"))
    y = null_safe_left(y.where("_rep > 0"), base, ["_dom", "_key"])
    score = lambda p: F.round(F.col("q") * (1 - F.lit(rate) * F.col(p)), 9)
    y = y.withColumns({"_s0": score("_p0"), "_s1": score("_p")})
    g = rank_grid(y, ["_dom", "_rep"], "_key", "_s0", {"b": "_s1"}).drop("variant", "n")
    mae = y.groupBy("_dom", "_rep").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("_p") - F.col("_p0"))).alias("mae"), F.min("_ok").alias("_ok"))
    out = null_safe_left(mae, g, ["_dom", "_rep"])
    return out.select(F.col("_dom").alias(domain), F.col("_rep").alias("replicate"), "n", *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in ("mae", "rho", "jaccard")])


def stability_summary(replicates: DataFrame, domain: str, share: float = 0.95) -> DataFrame:
    """domain, n_replicates, n_joint, status and label: the label of the median replicate, PASS where enough replicates meet all three limits."""
    joint = F.coalesce((F.col("mae") <= 0.05) & (F.col("rho") >= 0.95) & (F.col("jaccard") >= 0.8), F.lit(False))
    g = replicates.groupBy(domain).agg(
        F.count("*").alias("n_replicates"), F.count_if(joint).alias("n_joint"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in ("mae", "rho", "jaccard")]
    )  # replicates are few
    status = F.when(F.col("n_joint") >= F.ceil(F.lit(share) * F.col("n_replicates")), "PASS").otherwise("FAIL")
    return g.select(domain, "n_replicates", "n_joint", "mae", "rho", "jaccard", status.alias("status"), stability(F.col("mae"), F.col("jaccard"), F.col("rho")).alias("label"))


def feature_coverage(df: DataFrame, by: list[str], level: str, features: dict[str, Column]) -> DataFrame:
    """by, level (or ALL), feature, n_rows, n_finite, n_nan, n_posinf, n_neginf, coverage; one pass."""
    aggs = [F.count("*").alias("_n")]
    x = df.withColumns({f"_f_{k}": c.cast("double") for k, c in features.items()})
    for k in features:
        v = F.col(f"_f_{k}")
        kinds = {"n_finite": numeric.finite(v).isNotNull(), "n_nan": F.isnan(v), "n_posinf": v == float("inf"), "n_neginf": v == -float("inf")}
        aggs += [F.count_if(c).alias(f"_{k}_{n}") for n, c in kinds.items()]
    g = with_all(x, by, level, aggs)
    names = ("n_finite", "n_nan", "n_posinf", "n_neginf")
    rows = [
        F.struct(F.lit(k).alias("feature"), F.col("_n").alias("n_rows"), *[F.col(f"_{k}_{n}").alias(n) for n in names], (F.col(f"_{k}_n_finite") / F.col("_n")).alias("coverage"))
        for k in features
    ]
    return g.select(*by, level, F.inline(F.array(*rows)))


def indicator_correlations(df: DataFrame, domain: str, indicators: list[str], q: str = "q") -> DataFrame:
    """scope, domain, feature, n, rho: rank correlation of each indicator with q within each domain, between domain means, and pooled.

    All indicators are ranked in one pass of long rows; fewer than 3 rows or no spread give NULL.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_x")) for c in indicators]))
    long = df.select(F.col(domain).alias("_d"), F.col(q).alias("_q"), pairs).where(F.col("_x").isNotNull() & F.col("_q").isNotNull())
    means = df.groupBy(F.col(domain).alias("_d")).agg(F.avg(q).alias("_q"), *[F.avg(c).alias(c) for c in indicators]).select("_d", "_q", pairs)  # a row per domain
    three = F.when(F.col("n") > 2, F.col("rho")).alias("rho")
    within = spearman(long, ["_d", "feature"], "_x", "_q").select(F.lit("within").alias("scope"), F.col("_d").alias("domain"), "feature", "n", three)
    between = spearman(means, ["feature"], "_x", "_q").select(F.lit("between"), F.lit("means"), "feature", "n", three)
    pooled = spearman(long, ["feature"], "_x", "_q").select(F.lit("pooled"), F.lit("pooled"), "feature", "n", three)
    return within.unionAll(between).unionAll(pooled)


def overlap_reproduction(base: DataFrame, extension: DataFrame, key: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """n_extension, n_present, n_reproduced, n_violations, max_gap, status: extension rows whose key the base holds must reproduce its value.

    Two missing values agree, one does not.  A key that the base holds twice counts as present once.
    """
    b = base.groupBy(*key).agg(F.first(value).alias("_b"), F.lit(True).alias("_has"))
    x = extension.select(*key, F.col(value).alias("_e")).join(b, key, "left")
    gap = F.abs(F.col("_e") - F.col("_b"))
    same = F.when(F.col("_e").isNull() | F.col("_b").isNull(), F.col("_e").isNull() & F.col("_b").isNull()).otherwise(gap <= tolerance)
    has = F.coalesce("_has", F.lit(False))
    g = x.agg(
        F.count("*").alias("n_extension"), F.count_if(has).alias("n_present"), F.count_if(has & same).alias("n_reproduced"), F.count_if(has & ~same).alias("n_violations"), F.max(F.when(has, gap)).alias("max_gap")
    )
    return g.withColumn("status", F.when(F.col("n_present") == 0, "NO_OVERLAP").when(F.col("n_violations") == 0, "REPRODUCED").otherwise("VIOLATED"))


def domain_means(scores: DataFrame, domain: str, value: str) -> DataFrame:
    """rank_in of domain means (missing last), domain-equal mean and document-weighted mean."""
    g = scores.groupBy(domain).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    r = F.row_number().over(Window.orderBy(F.col("mean").desc_nulls_last(), domain))  # a row per domain
    return g.withColumn("rank_in", r)


def sensitivity(df: DataFrame, domain: str, primary: str, variants: list[str]) -> DataFrame:
    """domain, variant, primary_mean, variant_mean, difference and rank_change of domain means (missing last, ties by name)."""
    g = df.groupBy(domain).agg(*[F.avg(c).alias(c) for c in (primary, *variants)])
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc_nulls_last(), domain))  # a row per domain
    g = g.withColumns({f"_r_{c}": rank(c) for c in (primary, *variants)})
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("variant"), F.col(c).alias("variant_mean"), F.col(f"_r_{c}").alias("_rv")) for c in variants]))
    x = g.select(domain, F.col(primary).alias("primary_mean"), F.col(f"_r_{primary}").alias("_rp"), rows)
    return x.select(domain, "variant", "primary_mean", "variant_mean", (F.col("variant_mean") - F.col("primary_mean")).alias("difference"), (F.col("_rv") - F.col("_rp")).cast("long").alias("rank_change"))


def of_roles(df: DataFrame, column: str, roles: list[str]) -> DataFrame:
    """The rows of these roles; an error if one of another role comes through the pushed filter."""
    x = df.where(F.col(column).isin(*roles))
    if x.where(~F.col(column).isin(*roles) | F.col(column).isNull()).take(1):
        raise ValueError("rows of another role")
    return x
