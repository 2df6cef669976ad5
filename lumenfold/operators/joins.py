"""Joins: guarded, presence, bag equality, as-of steps, intervals, entity cascades and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import assert_unique
from .ordering import carried, row_ranks


def guarded(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """An equi-join whose cardinality is checked first."""
    if validate in ("one_to_one", "one_to_many"):
        assert_unique(left, keys)
    if validate in ("one_to_one", "many_to_one"):
        assert_unique(right, keys)
    return left.join(right, keys, how)


def presence(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """side and n: both, left_only or right_only, over distinct keys."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def bag_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number of copies differs: the columns, n_left, n_right.  NULL equals NULL."""
    a = left.groupBy(*columns).agg(F.count("*").alias("n"))
    b = right.groupBy(*columns).agg(F.count("*").alias("n"))
    both = a.select(*columns, F.col("n").alias("x"), F.lit(0).alias("y")).unionByName(
        b.select(*columns, F.lit(0).alias("x"), F.col("n").alias("y"))
    )
    out = both.groupBy(*columns).agg(F.sum("x").cast("long").alias("n_left"), F.sum("y").cast("long").alias("n_right"))
    return out.where(F.col("n_left") != F.col("n_right"))


def value_agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """n_common, n_exact, n_close, max_abs, mean_abs of a value of two tables at equal keys."""
    x = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys)
    gap = F.abs(F.col("_a") - F.col("_b"))
    return x.agg(
        F.count("*").alias("n_common"),
        F.count_if(F.col("_a") == F.col("_b")).alias("n_exact"),
        F.count_if(gap <= tolerance).alias("n_close"),
        F.max(gap).alias("max_abs"),
        F.avg(gap).alias("mean_abs"),
    )


def as_of(rows: DataFrame, by: list[str], at: str, steps: DataFrame, step_at: str, value: str) -> DataFrame:
    """The value of the last step at or before each row; before the first step, the first step's.

    Both sides share one order, in buckets: steps stand before rows of the same place and
    are carried forward, from one bucket to the next too, so nothing is matched pair by
    pair and no key is one task.
    """
    a = steps.select(*by, F.col(step_at).alias("_when"), F.col(value).alias("_v"), F.lit(0).alias("_kind"))
    first = steps.groupBy(*by).agg(F.min_by(value, step_at).alias("_first"))
    b = rows.withColumn("_when", F.col(at)).withColumn("_kind", F.lit(1))
    x = carried(b.unionByName(a, allowMissingColumns=True), by, F.col("_when"), ["_kind"], None, "_v", "_last", before=False)
    x = x.where(F.col("_kind") == 1).join(first, by, "left")
    return x.withColumn(value, F.coalesce("_last", "_first")).drop("_v", "_last", "_first", "_when", "_kind")


def step_lookup(x: Column, grid: list[tuple[float, float]]) -> Column:
    """As-of against a short literal grid: the last step at or below x, clamped to the ends."""
    grid = sorted(grid)
    out = F.lit(float(grid[0][1]))
    for place, value in grid[1:]:
        out = F.when(x >= F.lit(float(place)), F.lit(float(value))).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def around(df: DataFrame, when: str, centre: str, days: int, nearest: int, tie: str) -> DataFrame:
    """The rows within `days` of a date; if there are none, the nearest few."""
    c = F.lit(centre).cast("timestamp")
    gap = F.abs(F.unix_timestamp(F.col(when).cast("timestamp")) - F.unix_timestamp(c))
    x = df.withColumn("_gap", gap)
    inside = x.where(F.col("_gap") <= days * 86400)
    return (inside if inside.take(1) else x.orderBy("_gap", tie).limit(nearest)).drop("_gap")


def cascade(left: DataFrame, key: str, right: DataFrame, target: str, rules: list[tuple[str, str]]) -> DataFrame:
    """key, target, rule, status: the first rule with a candidate decides.

    rules: (name, match column of both sides).  Two targets for one key are ambiguous;
    a target that several keys matched is shared.
    """
    tries = None
    for rank, (name, column) in enumerate(rules):
        b = right.where(F.col(column).isNotNull()).select(F.col(column).alias("_m"), F.col(target).alias("_t"))
        # candidates of a match value before the join: a common value is one row
        b = b.groupBy("_m").agg(F.min("_t").alias("_low"), F.countDistinct("_t").alias("_n"))
        one = left.join(b, left[column] == F.col("_m")).select(
            key, F.lit(rank).alias("_rank"), F.lit(name).alias("rule"), "_low", "_n"
        )
        tries = one if tries is None else tries.unionAll(one)
    best = tries.groupBy(key).agg(F.min_by(F.struct("rule", "_low", "_n"), "_rank").alias("_x"))
    x = left.select(key).distinct().join(best, key, "left")
    found = x.select(
        key,
        F.when(F.col("_x._n") == 1, F.col("_x._low")).alias(target),
        F.col("_x.rule").alias("rule"),
        F.when(F.col("_x").isNull(), "unmatched").when(F.col("_x._n") > 1, "ambiguous").otherwise("matched").alias("status"),
    )
    shared = found.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("_k")).where(F.col("_k") > 1)
    return found.join(shared, target, "left").select(
        key, target, "rule", F.when(F.col("_k").isNotNull(), "shared").otherwise(F.col("status")).alias("status")
    )


def content_classes(left: DataFrame, right: DataFrame, text: str = "text") -> DataFrame:
    """relation and n_hashes: 1:1, 1:n, n:1, n:n, left_only, right_only, by digest of the text."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h")
    a = left.groupBy(h).agg(F.count("*").alias("_a"))
    b = right.groupBy(h).agg(F.count("*").alias("_b"))
    one = lambda c: F.when(F.col(c) == 1, "1").otherwise("n")
    kind = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise(F.concat(one("_a"), F.lit(":"), one("_b")))
    return a.join(b, "_h", "full").groupBy(kind.alias("relation")).agg(F.count("*").alias("n_hashes"))


def pairwise_intersections(df: DataFrame, key: list[str], source: str, sources: list[str]) -> DataFrame:
    """source_a < source_b and the number of distinct keys both hold; sources are few and named."""
    flags = [F.max(F.when(F.col(source) == s, 1).otherwise(0)).alias(f"_{i}") for i, s in enumerate(sources)]
    held = df.groupBy(*key).agg(*flags)
    pairs = [(i, j) for i in range(len(sources)) for j in range(i + 1, len(sources))]
    sums = held.agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).cast("long").alias(f"p{i}_{j}") for i, j in pairs])
    rows = F.array(
        *[
            F.struct(F.lit(sources[i]).alias("source_a"), F.lit(sources[j]).alias("source_b"), F.col(f"p{i}_{j}").alias("n_common"))
            for i, j in pairs
        ]
    )
    return sums.select(F.inline(rows))


def adjacent_pairs(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the next one of its key as next_<column>; the last has none."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = df
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.where(F.lead(F.lit(True)).over(w).isNotNull()) if not columns else out


def positional(left: DataFrame, right: DataFrame, order: str, same: list[str]) -> DataFrame:
    """The rows of both at equal places in the order of a unique number, with `place`; an error unless they agree in number and in `same`.

    The left's columns and those of the right that it lacks.
    """
    a, b = row_ranks(left, [], order, order, "place"), row_ranks(right, [], order, order, "place")
    extra = [c for c in right.columns if c not in left.columns]
    b = b.select("place", F.lit(True).alias("_there"), *[F.col(c).alias(f"_same_{c}") for c in same], *extra)
    x = a.withColumn("_here", F.lit(True)).join(b, "place", "full")
    bad = ~(F.col("_here").isNotNull() & F.col("_there").isNotNull())
    for c in same:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    if n := x.where(bad).count():
        raise ValueError(f"{n} rows are not aligned")
    return x.select("place", *left.columns, *extra)
