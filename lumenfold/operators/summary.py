"""Summaries with explicit denominators, profiles, ledgers and flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """A row per scope it belongs to: overlapping scopes are expanded once and aggregated once."""
    names = F.array(*[F.when(c, F.lit(k)) for k, c in scopes.items()])
    return df.withColumn("scope", F.explode(F.filter(names, lambda x: x.isNotNull())))


def with_all(df: DataFrame, by: list[str], level: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates by (by, level) and by alone, the latter under the level ALL."""
    sets = [[F.col(c) for c in [*by, level]], [F.col(c) for c in by]]
    out = df.groupingSets(sets, *[F.col(c) for c in [*by, level]]).agg(F.grouping(level).alias("_g"), *aggregates)
    return out.withColumn(level, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(level))).drop("_g")


def denominators(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by, statistic, n_total, n_effective, ddof, divisor: what each mean and deviation divides by."""
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"), *[F.count(v).alias(f"_{v}") for v in values])
    rows = [
        F.struct(
            F.lit(f"{stat}_{v}").alias("statistic"),
            F.col("_n").alias("n_total"),
            F.col(f"_{v}").alias("n_effective"),
            F.lit(ddof).cast("long").alias("ddof"),
            (F.col(f"_{v}") - ddof).alias("divisor"),
        )
        for v in values
        for stat, ddof in (("mean", 0), ("std", 1))
    ]
    return counts.select(*by, F.inline(F.array(*rows)))


def column_profile(df: DataFrame, numeric: list[str], texts: list[str]) -> DataFrame:
    """One pass, then a row per column: type, missing, n_distinct, low, high, mean, zeros, negatives, and an example (the least text)."""
    aggs = []
    for c in [*numeric, *texts]:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_m"), F.countDistinct(c).alias(f"{c}_d")]
    kinds = dict(df.dtypes)
    aggs += [F.min(F.col(c).cast("string")).alias(f"{c}_e") for c in texts]
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}_lo"), F.max(x).alias(f"{c}_hi"), F.avg(x).alias(f"{c}_mean"), F.count_if(x == 0).alias(f"{c}_z"), F.count_if(x < 0).alias(f"{c}_n")]
    one = df.agg(*aggs)
    rows = []
    for c in [*numeric, *texts]:
        num = c in numeric
        get = lambda k, t: (F.col(f"{c}_{k}") if num else F.lit(None)).cast(t)  # noqa: B023,E731
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"), F.col(f"{c}_m").alias("missing"), F.col(f"{c}_d").alias("n_distinct"), get("lo", "double").alias("low"),
                get("hi", "double").alias("high"), get("mean", "double").alias("mean"), get("z", "long").alias("zeros"), get("n", "long").alias("negatives"),
                (F.lit(None) if num else F.col(f"{c}_e")).cast("string").alias("example"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def flow(df: DataFrame, gates: list[tuple[str, Column]], entity: str) -> DataFrame:
    """step, gate, n_rows, n_entities after each gate and all before it; one pass."""
    passed, aggs = F.lit(True), []
    for i, (_, gate) in enumerate(gates):
        passed = passed & F.coalesce(gate, F.lit(False))
        aggs += [F.count_if(passed).alias(f"r{i}"), F.countDistinct(F.when(passed, F.col(entity))).alias(f"e{i}")]
    one = df.agg(*aggs)
    rows = [
        F.struct(F.lit(i).cast("long").alias("step"), F.lit(n).alias("gate"), F.col(f"r{i}").alias("n_rows"), F.col(f"e{i}").alias("n_entities"))
        for i, (n, _) in enumerate(gates)
    ]
    return one.select(F.inline(F.array(*rows)))


def gate_status(*gates: Column) -> Column:
    """PASS if all hold, INSUFFICIENT if one cannot be judged, else FAIL."""
    unknown = reduce(lambda a, b: a | b, [g.isNull() for g in gates])
    every = reduce(lambda a, b: a & b, [F.coalesce(g, F.lit(False)) for g in gates])
    failed = reduce(lambda a, b: a | b, [~F.coalesce(g, F.lit(True)) for g in gates])
    return F.when(every, "PASS").when(failed, "FAIL").when(unknown, "INSUFFICIENT").otherwise("FAIL")


def pivot_counts(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Named values only, so no extra pass finds them; missing cells are 0."""
    return df.groupBy(*by).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def mask_of(columns: list[Column]) -> Column:
    """Bit i is set where column i is missing."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns)])


def mask_patterns(df: DataFrame, mask: str) -> DataFrame:
    return df.groupBy(mask).agg(F.count("*").alias("n")).withColumn("n_missing", F.bit_count(mask).cast("long"))


def co_missing(patterns: DataFrame, mask: str, names: list[str]) -> DataFrame:
    """column_a <= column_b and how many rows lack both: from the distinct masks, weighted by their rows."""
    bit = lambda i: F.shiftright(F.col(mask), i).bitwiseAND(F.lit(1))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = patterns.agg(*[F.coalesce(F.sum(bit(i) * bit(j) * F.col("n")), F.lit(0)).cast("long").alias(f"p{i}_{j}") for i, j in pairs])
    rows = [F.struct(F.lit(names[i]).alias("column_a"), F.lit(names[j]).alias("column_b"), F.col(f"p{i}_{j}").alias("n_both")) for i, j in pairs]
    return one.select(F.inline(F.array(*rows)))


def ledger(components: dict[str, DataFrame], value: str) -> DataFrame:
    """Components of uncertainty side by side, never merged: component, name, value."""
    out = None
    for name, df in components.items():
        x = df.select(F.lit(name).alias("component"), F.col("name"), F.col(value).cast("double").alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def union_all(*frames: DataFrame) -> DataFrame:
    """Schema-aligned UNION ALL; what a frame lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_leaks(df: DataFrame, key: list[str], split: str) -> DataFrame:
    """Keys that are in more than one split."""
    return df.groupBy(*key).agg(F.countDistinct(split).alias("n_splits")).where(F.col("n_splits") > 1)


def eligibility(df: DataFrame, gates: dict[str, Column], side: dict[str, Column], key: list[str]) -> DataFrame:
    """key, eligible, side_eligible, n_failed, first_failed: a conjunction of named gates, and a side cohort that swaps some of them; an unknown gate fails."""
    holds = {k: F.coalesce(c, F.lit(False)) for k, c in gates.items()}
    swapped = holds | {k: F.coalesce(c, F.lit(False)) for k, c in side.items()}
    every = lambda g: reduce(lambda a, b: a & b, g.values())
    failed = F.filter(F.array(*[F.when(~c, F.lit(k)) for k, c in holds.items()]), lambda x: x.isNotNull())
    return df.select(*key, every(holds).alias("eligible"), every(swapped).alias("side_eligible"), F.size(failed).cast("long").alias("n_failed"), F.get(failed, F.lit(0)).alias("first_failed"))


ANOMALY = "map<string,struct<reasons:array<string>,nan:int,posinf:int,neginf:int,non_numeric:int,`null`:int,wrong_length:int,elements:int>>"


def anomalies(df: DataFrame, by: list[str], entries: str) -> DataFrame:
    """by, field, n_records, n_elements, n_seen, reasons, n_reasons: read back from a JSON map field -> counts; a bad or empty text has none."""
    x = df.select(*by, F.explode(F.from_json(entries, ANOMALY)).alias("field", "_e"))
    kinds = ("nan", "posinf", "neginf", "non_numeric", "null", "wrong_length")
    bad = reduce(lambda a, b: a + b, [F.coalesce(F.col("_e")[k], F.lit(0)) for k in kinds])
    x = x.withColumn("_bad", bad).withColumn("_r", F.coalesce(F.col("_e.reasons"), F.array().cast("array<string>")))
    g = x.groupBy(*by, "field").agg(
        F.count("*").alias("n_records"), F.sum("_bad").cast("long").alias("n_elements"), F.sum(F.coalesce("_e.elements", F.lit(0))).cast("long").alias("n_seen"), F.sum(F.size("_r")).cast("long").alias("n_reasons")
    )
    # reasons are few words
    names = x.select(*by, "field", F.explode("_r").alias("_w")).distinct().groupBy(*by, "field").agg(F.array_join(F.array_sort(F.collect_list("_w")), "|").alias("reasons"))
    return g.join(names, [*by, "field"], "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))


def wide(df: DataFrame, by: list[str], level: str, values: list[str]) -> DataFrame:
    """One wide row by (by, level) and by alone (level ALL): n_total, and of each value its valid and missing counts, mean, deviation, extremes and five quantiles.

    `by` and `level` must have no NULL.  The quantiles of all values and groups are one pass of long rows.
    """
    from .ordering import null_safe_left, quantiles

    shares = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    aggs = [F.count("*").alias("n_total")]
    for v in values:
        x = F.col(v).cast("double")
        aggs += [
            F.count(x).alias(f"{v}_n"), F.count_if(x.isNull()).alias(f"{v}_missing"), F.avg(x).alias(f"{v}_mean"), F.stddev_samp(x).alias(f"{v}_std"),
            F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max"),
        ]
    g = with_all(df, by, level, aggs)
    rows = F.inline(F.array(*[F.struct(F.lit(v).alias("_f"), F.col(v).cast("double").alias("_v")) for v in values]))
    long = df.select(*by, F.explode(F.array(level, F.lit("ALL"))).alias(level), *values).select(*by, level, rows)
    q = quantiles(long, [*by, level, "_f"], "_v", shares)
    q = q.groupBy(*by, level).agg(*[F.max(F.when(F.col("_f") == v, F.col(k))).alias(f"{v}_{k}") for v in values for k in shares])
    return null_safe_left(g, q, [*by, level])
