"""Audits of reported values, dates, definitions, coverage and parameter draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import short_id
from . import allocation
from .ordering import null_safe_left, quantiles


def reported_against_derived(df: DataFrame, by: list[str], reported: str, derived: Column, tolerance: float) -> DataFrame:
    """Ratio of a reported to a derived quantity: n, median and extremes, and rows inside the rounding tolerance."""
    ratio = F.when(derived > 0, F.col(reported) / F.when(derived > 0, derived))
    x = df.withColumn("_r", ratio)
    g = x.groupBy(*by).agg(
        F.count("_r").alias("n"), F.min("_r").alias("low"), F.max("_r").alias("high"), F.count_if(F.abs(F.col("_r") - 1) <= tolerance).alias("n_close")
    )
    return null_safe_left(g, quantiles(x, by, "_r", {"median": 0.5}), by)


def date_fields(df: DataFrame, fields: list[str], today: str) -> DataFrame:
    """field, n_valid, n_missing, n_future, n_distinct, earliest, latest; one pass."""
    aggs = []
    for f in fields:
        d = F.to_date(f)
        aggs += [
            F.count(d).alias(f"{f}_v"), F.count_if(d.isNull()).alias(f"{f}_m"), F.count_if(d > F.lit(today).cast("date")).alias(f"{f}_f"),
            F.countDistinct(d).alias(f"{f}_d"), F.min(d).alias(f"{f}_a"), F.max(d).alias(f"{f}_b"),
        ]
    names = (("v", "n_valid"), ("m", "n_missing"), ("f", "n_future"), ("d", "n_distinct"), ("a", "earliest"), ("b", "latest"))
    rows = [F.struct(F.lit(f).alias("field"), *[F.col(f"{f}_{k}").alias(n) for k, n in names]) for f in fields]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def definitions(df: DataFrame, text: str, entity: str, rules: list[tuple[str, str]], eligible: list[str]) -> DataFrame:
    """definition_id, kind, n_rows, n_entities, is_eligible: texts classed by ordered rules, named by digest."""
    from ..functions.text import classify

    x = df.withColumn("kind", F.when(F.col(text).isNull(), "missing").otherwise(classify(F.col(text), rules, "other")))
    x = x.withColumn("definition_id", short_id(F.coalesce(F.lower(F.trim(text)), F.lit(""))))
    g = x.groupBy("definition_id", "kind").agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"))
    return g.withColumn("is_eligible", F.col("kind").isin(eligible))


def coverage(df: DataFrame, by: list[str], slots: list[str]) -> DataFrame:
    """n_rows, n_complete, n_partial, n_empty, valid_slots, missing_slots of the named slots."""
    held = sum(F.col(s).isNotNull().cast("int") for s in slots)
    x = df.withColumn("_h", held)
    k = len(slots)
    return x.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_h") == k).alias("n_complete"), F.count_if(F.col("_h").between(1, k - 1)).alias("n_partial"),
        F.count_if(F.col("_h") == 0).alias("n_empty"), F.sum("_h").cast("long").alias("valid_slots"), F.sum(k - F.col("_h")).cast("long").alias("missing_slots"),
    )


def usage(entities: DataFrame, key: str, analyses: dict[str, DataFrame]) -> DataFrame:
    """key, analysis, role: used or unused, for every entity in every analysis."""
    out = None
    for name, df in analyses.items():
        u = df.select(F.col(key)).distinct().withColumn("_u", F.lit(True))
        x = entities.select(key).join(u, key, "left").select(key, F.lit(name).alias("analysis"), F.when(F.col("_u"), "used").otherwise("unused").alias("role"))
        out = x if out is None else out.unionByName(x)
    return out


def propagated(draws: DataFrame, budget: float, context: float) -> DataFrame:
    """Quantiles of the optimal N over whole parameter draws (e, a, alpha, b, beta), and how often a bound holds."""
    unit = F.lit(1e18 * (6 + allocation.ETA * context))
    s = F.col("alpha") + F.col("beta")
    n = F.pow(F.col("alpha") * F.col("a") / (F.col("beta") * F.col("b")), 1 / s) * F.pow(F.lit(budget) / unit, F.col("beta") / s)
    low, high = allocation.N_RANGE
    x = draws.withColumn("_n", F.least(F.greatest(n, F.lit(low)), F.lit(high)))
    qs = [F.percentile("_n", F.lit(q)).alias(k) for q, k in ((0.025, "p2_5"), (0.5, "p50"), (0.975, "p97_5"))]
    return x.agg(F.count("*").alias("draws"), *qs, F.avg(((F.col("_n") <= low) | (F.col("_n") >= high)).cast("double")).alias("at_bound"))
