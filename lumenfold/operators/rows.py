"""Row selection: first seen, latest, consensus, folds, cuts and top shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import null_safe_left, row_ranks


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """is_first: the row of its key that comes first; `order` must end in a unique key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("is_first", F.row_number().over(w) == 1)


def overlap_flags(df: DataFrame, key: list[str], source_rank: str) -> DataFrame:
    """overlap_any: an earlier source holds the key; overlap_base: the first of all sources does."""
    w = Window.partitionBy(*key)
    earliest = F.min(source_rank).over(w)
    return df.withColumn("overlap_any", earliest < F.col(source_rank)).withColumn(
        "overlap_base", (earliest == 0) & (F.col(source_rank) > 0)
    )


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`; pre-aggregated, so a hot key costs a row per task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def latest_by(df: DataFrame, key: list[str], rank: Column, columns: list[str]) -> DataFrame:
    """As latest, by the largest `rank` struct, with map-side combination."""
    found = df.groupBy(*key).agg(F.max_by(F.struct(*columns), rank).alias("_x"))
    return found.select(*key, "_x.*")


def resolved_runs(df: DataFrame, key: list[str], when: str, run: str) -> DataFrame:
    """Duplicate runs of a key: the latest if all times differ, else all of them in one group."""
    g = df.groupBy(*key).agg(F.count("*").alias("_n"), F.countDistinct(when).alias("_t"), F.max(when).alias("_last"))
    x = df.join(g, key)
    distinct = F.col("_n") == F.col("_t")
    kept = x.where(~distinct | (F.col(when) == F.col("_last")))
    return kept.withColumn("resolution", F.when(F.col("_n") == 1, "single").when(distinct, "latest").otherwise("all_runs")).drop("_n", "_t", "_last")


def consensus(value: str, missing: str = "MISSING", conflict: str = "CONFLICT") -> Column:
    """An aggregate: the only value, or a label; bounded, as it holds the two extremes only."""
    low, high = F.min(value), F.max(value)
    return F.when(low.isNull(), F.lit(missing)).when(low == high, low.cast("string")).otherwise(F.lit(conflict))


def conflicts(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(*key).agg(F.countDistinct(value).alias("n_values")).where(F.col("n_values") > 1)


def ordinal(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def early_part(df: DataFrame, key: list[str], order: list[str], share: str = "0.8") -> DataFrame:
    """in_train: the first floor(share * n) rows of a key."""
    n = F.count("*").over(Window.partitionBy(*key))
    r = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("in_train", r <= F.floor(F.lit(share).cast("decimal(10,4)") * n))


def fold_count(n: Column, most: int = 5) -> Column:
    """min(most, max(2, n // 3))"""
    return F.least(F.lit(most), F.greatest(F.lit(2), F.floor(n / 3).cast("int")))


def round_robin(df: DataFrame, key: list[str], order: str, most: int = 5) -> DataFrame:
    """fold: places by a unique number, dealt in turn; a group is ordered in buckets, not in one task."""
    n = df.groupBy(*key).agg(F.count("*").alias("_n"))  # a row per group
    x = row_ranks(df, key, order, order, "_r").join(n, key)
    return x.withColumn("fold", ((F.col("_r") - 1) % fold_count(F.col("_n"), most)).cast("long")).drop("_r", "_n")


def late_dates(df: DataFrame, when: str, share: float = 0.8) -> DataFrame:
    """is_late: at or after the cut, the distinct date at place floor(share * (dates - 1)); dates are few, rows are not."""
    dates = df.where(F.col(when).isNotNull()).select(F.to_date(when).alias("_d")).distinct()
    cut = dates.agg(F.sort_array(F.collect_list("_d")).alias("_ds"))
    at = F.floor(F.lit(share) * (F.size("_ds") - 1)).cast("int")
    cut = cut.select(F.get("_ds", at).alias("cut_date"))
    return df.crossJoin(F.broadcast(cut)).withColumn("is_late", F.to_date(when) >= F.col("cut_date"))  # one row


def group_fold(group: Column, folds: int, seed: str = "fold") -> Column:
    """A whole group is in one fold, by its digest."""
    from ..functions.hashing import split_remainder

    return split_remainder(group.cast("string"), seed, folds)


def transitions(df: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """The rows at which the state differs from the row before, with that state."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("previous_state", F.lag(state).over(w)).where(F.col("previous_state") != F.col(state))


def running_max(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("frontier", F.max(value).over(w))


def stratified_quota(
    df: DataFrame, key: str, stratum: str, domain: str, quotas: dict[str, int], seed: str, domain_share: float = 0.2
) -> DataFrame:
    """Quota rows of each stratum, round robin over domains in digest order.

    No domain gets more than ceil(domain_share * quota) rows of a stratum.  Within a
    domain only that many rows are ranked, so the order over domains sees few rows.
    """
    wanted = F.create_map(*[F.lit(x) for k, v in quotas.items() for x in (k, v)])
    x = df.withColumn("_q", wanted[F.col(stratum)]).where(F.col("_q").isNotNull())
    x = x.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), stratum, domain, F.col(key).cast("string")), 256))
    most = max(math.ceil(domain_share * q) for q in quotas.values())
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, domain).orderBy("_h", key)))
    # a limit known to the planner: each task passes on that many rows of a group at most
    x = x.where(F.col("_r") <= most).where(F.col("_r") <= F.ceil(F.lit(domain_share) * F.col("_q")))
    x = x.withColumn("pick", F.row_number().over(Window.partitionBy(stratum).orderBy("_r", domain, key)))
    return x.where(F.col("pick") <= F.col("_q")).drop("_q", "_h", "_r")


def with_group(df: DataFrame, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Each row with aggregates of its group: aggregated first and joined, so a hot group costs a row per task."""
    g = df.groupBy(*by).agg(*aggregates)
    return null_safe_left(df, g, by)


def leave_out_folds(df: DataFrame, split: str, group: str, key: list[str]) -> DataFrame:
    """split, heldout, n_train, n_test, train_keys, test_keys: the folds that leave each value of a group out, with order-free digests of their keys.

    Candidates fitted on the same folds show the same digests.
    """
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256), 1, 15), 16, 10).cast("long")
    g = df.groupBy(F.col(group).cast("string").alias("heldout")).agg(F.count("*").alias("n_test"), F.bit_xor(digest).alias("test_keys"))
    whole = df.agg(F.count("*").alias("_n"), F.bit_xor(digest).alias("_k"))
    x = g.crossJoin(F.broadcast(whole))  # one row
    return x.select(
        F.lit(split).alias("split"), "heldout", (F.col("_n") - F.col("n_test")).alias("n_train"), "n_test", F.col("_k").bitwiseXOR(F.col("test_keys")).alias("train_keys"), "test_keys"
    )
