"""Order without one task that sees all rows: running totals, ranks, neighbours and quantiles.

Quantile cuts deal the values to buckets; what an order needs inside a bucket is a window
over that bucket, and the buckets' totals or last values, a row per bucket, carry it on
from one to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def bucket_count(df: DataFrame) -> int:
    """As many buckets as shuffle partitions, within what a cut sketch holds exactly enough."""
    return max(8, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2000))


def running(df: DataFrame, by: list[str], value: str, weight: str, buckets: int | None = None, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Distinct values with w (weight at the value), before (weight below), total (of the group) and extra aggregates."""
    buckets = buckets or bucket_count(df)
    each = df.groupBy(*by, value).agg(F.sum(weight).alias("w"), *extra)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = each.groupBy(*by).agg(
        F.percentile_approx(F.col(value).cast("double"), shares, F.lit(10 * buckets)).alias("_cuts"), F.sum("w").alias("total")
    )
    cuts = written(cuts, "cuts")  # a sketch differs from one evaluation to the next, and rows and offsets must agree
    x = null_safe_left(each, cuts, by) if by else each.crossJoin(F.broadcast(cuts))  # a row per group
    x = x.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    inside = Window.partitionBy(*by, "_b").orderBy(value)
    x = x.withColumn("_in", F.sum("w").over(inside) - F.col("w"))
    totals = x.groupBy(*by, "_b").agg(F.sum("w").alias("_t"))
    # at most `buckets` rows of a group
    offsets = totals.withColumn("_off", F.sum("_t").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_t")).drop("_t")
    x = null_safe_left(x, offsets, [*by, "_b"])
    return x.withColumn("before", F.col("_in") + F.col("_off")).drop("_in", "_off", "_b")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], times: str | None = None) -> DataFrame:
    """by and a column per share: exact linear quantiles of the values that are not NULL, as doubles.  times: how often a row stands (0 is not at all)."""
    x = df.where(F.col(value).isNotNull())
    if times:
        x = x.where(F.col(times) > 0)
    x = x.select(*by, F.col(value).cast("double").alias("_v"), (F.col(times) if times else F.lit(1)).cast("long").alias("_one"))
    r = running(x, by, "_v", "_one")
    last = F.col("total") - 1
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("w"))
    aggs = [F.max("total").alias("_n")]
    for k, q in shares.items():
        low, high = F.floor(last * F.lit(q)), F.ceil(last * F.lit(q))
        aggs += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_{k}_a"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_{k}_b")]
    g = r.groupBy(*by).agg(*aggs)
    at = lambda q: (F.col("_n") - 1) * F.lit(q)
    return g.select(
        *by, *[(F.col(f"_{k}_a") + (F.col(f"_{k}_b") - F.col(f"_{k}_a")) * (at(q) - F.floor(at(q)))).alias(k) for k, q in shares.items()]
    )


def _dealt(df: DataFrame, by: list[str], value: Column, key: Column | None) -> DataFrame:
    """df with _at: the bucket by ascending value.  A value that fills a cut is a bucket of its own, dealt by the key if that is a number."""
    n = bucket_count(df)
    shares = [i / n for i in range(1, n)]
    if df.select(value.alias("v")).schema["v"].dataType.typeName() in ("date", "timestamp_ntz"):
        value = value.cast("timestamp")
    sketch = lambda c: F.percentile_approx(c.cast("double"), shares, F.lit(10 * n))
    cuts = df.groupBy(*by).agg(F.array_distinct(sketch(value)).alias("_cuts"), *([F.array_distinct(sketch(key)).alias("_keys")] if key is not None else []))
    cuts = written(cuts, "cuts")  # as in `running`
    x = null_safe_left(df, cuts, by) if by else df.crossJoin(F.broadcast(cuts))  # a row per group
    v = value.cast("double")
    below = F.size(F.filter("_cuts", lambda c: c < v))
    alone = F.array_contains("_cuts", v)
    sub = F.when(alone, F.size(F.filter("_keys", lambda c: c < key.cast("double")))).otherwise(0) if key is not None else F.lit(0)
    # NULL values come first
    at = F.when(v.isNull(), F.struct(F.lit(-1).alias("b"), F.lit(0).alias("s"))).otherwise(F.struct((2 * below + alone.cast("int")).alias("b"), sub.alias("s")))
    return x.withColumn("_at", at).drop("_cuts", "_keys")


def row_ranks(df: DataFrame, by: list[str], value: str, key: str, name: str, descending: bool = False) -> DataFrame:
    """df with `name`: the place, from 1, by (value, key ascending) in its group; key must be unique and a number there."""
    sign = -1 if descending else 1
    x = _dealt(df.withColumn("_v", F.lit(sign) * F.col(value)), by, F.col("_v"), F.col(key))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_at").orderBy("_v", key)))
    sums = x.groupBy(*by, "_at").agg(F.count("*").alias("_t"))
    sums = sums.withColumn("_off", F.sum("_t").over(Window.partitionBy(*by).orderBy("_at")) - F.col("_t")).drop("_t")  # a row per bucket
    return null_safe_left(x, sums, [*by, "_at"]).withColumn(name, (F.col("_in") + F.col("_off")).cast("long")).drop("_at", "_in", "_off", "_v")


def carried(df: DataFrame, by: list[str], order: Column, ties: list[str], key: str | None, value: str, name: str, before: bool) -> DataFrame:
    """df with `name`: the last value that is not NULL at or, if `before`, above the row, by (order, ties)."""
    x = _dealt(df.withColumn("_o", order), by, F.col("_o"), F.col(key) if key else None)
    w = Window.partitionBy(*by, "_at").orderBy("_o", *ties).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    x = x.withColumn("_in", F.last(value, ignorenulls=True).over(w))
    ends = x.where(F.col(value).isNotNull()).groupBy(*by, "_at").agg(F.max_by(value, F.struct("_o", *ties)).alias("_end"))
    every = null_safe_left(x.select(*by, "_at").distinct(), ends, [*by, "_at"])
    up = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_from", F.last("_end", ignorenulls=True).over(up)).drop("_end")  # a row per bucket
    x = null_safe_left(x, every, [*by, "_at"])
    return x.withColumn(name, F.coalesce("_in", "_from")).drop("_o", "_at", "_in", "_from")


def null_safe_left(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys of which NULLs are equal."""
    y = y.withColumnsRenamed({k: f"_y_{k}" for k in keys})
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_y_{k}"))
        same = one if same is None else same & one
    return x.join(y, same, "left").drop(*[f"_y_{k}" for k in keys])
