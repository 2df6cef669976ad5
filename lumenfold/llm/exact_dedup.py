"""Exact duplicates by a content sort.

The texts are range-partitioned by sampled splitters (their first bytes, then a hash
for texts that begin alike: the sample that Spark draws holds no whole text), sorted
externally inside each range so that equal texts are adjacent, and neighbours are
compared in full (the window's group change compares whole texts, not digests).  A
text that the sample shows to be hot is dealt over several ranges by a salt of its row
id; the few hot texts' totals come from a small pre-aggregated table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written


def _runs(docs: DataFrame, id_col: str, text_col: str, keep: str, samples_per_partition: int, splitter_chars: int, carry: list[str]):
    """The rows in sorted runs: _id, _sha, _rank in its run, group totals, and carried columns as a struct."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    best = F.min if keep == "smallest" else F.max
    text = F.col(text_col)
    # the text travels once
    row = F.struct(text.isNull().alias("none"), *[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(carry) if c != text_col])
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"), row.alias("_row"))
    rows = rows.withColumn("_sha", F.sha2("_text", 256))

    n = partitions(spark)
    total = docs.count()
    fraction = min(1.0, n * samples_per_partition / max(total, 1))
    taken = rows.select("_sha").sample(fraction, seed=11)
    # at most 4n texts can have so many samples
    least = samples_per_partition // 4
    many = taken.groupBy("_sha").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    hot = written(many.select(F.col("_sha").alias("_hot"), F.ceil(4 * F.col("n") / samples_per_partition).cast("int").alias("_wide")), "hot-texts")
    any_hot = bool(hot.take(1))

    placed = rows.withColumn("_start", F.substring("_text", 1, splitter_chars)).withColumn("_hash", F.xxhash64("_text"))
    keys = ["_start", "_hash"]
    if any_hot:
        placed = placed.join(F.broadcast(hot), F.col("_sha") == F.col("_hot"), "left").drop("_hot")
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.coalesce("_wide", F.lit(1)).cast("long")).cast("int")).drop("_wide")
        keys.append("_salt")
    # a range partitioning by the keys already clusters (keys, text): the window adds no exchange
    placed = placed.repartitionByRange(n, *keys)
    group = Window.partitionBy(*keys, "_text")
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    runs = placed.select(
        "_id",
        "_sha",
        "_row",
        *(["_text"] if carry else []),
        F.row_number().over(group.orderBy(order)).alias("_rank"),
        F.count("*").over(group).alias("_n"),
        best("_id").over(group).alias("_best"),
    )
    if any_hot:
        # a row per hot text: no more rows than `hot` has
        whole = (
            rows.join(F.broadcast(hot), F.col("_sha") == F.col("_hot"), "left_semi")
            .groupBy("_sha")
            .agg(F.count("*").alias("_all_n"), best("_id").alias("_all_best"))
        )
        runs = runs.join(F.broadcast(whole), "_sha", "left")
        size, kept_id = F.coalesce("_all_n", "_n"), F.when(F.col("_all_n").isNull(), F.col("_best")).otherwise(F.col("_all_best"))
    else:
        size, kept_id = F.col("_n"), F.col("_best")
    # null ids share one salt, so a group of null ids only has one first row
    first = (F.col("_rank") == 1) & F.col("_id").eqNullSafe(kept_id)
    return runs.select(
        "_id", "_sha", kept_id.alias("_keep"), size.cast("long").alias("_size"), first.alias("_kept"), *(["_row", "_text"] if carry else [])
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    samples_per_partition: int = 64,
    splitter_chars: int = 128,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group stays.  Null text counts as empty.
    A null id ranks behind every other id; in a group of null ids one row stays.
    Repeated rows (same id and text) are one group, of which exactly one is kept.
    An empty table gives an empty result; extra columns are ignored.
    """
    runs = _runs(docs, id_col, text_col, keep, samples_per_partition, splitter_chars, [])
    return runs.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of `docs`, which may have any names.

    Null texts count as empty; a null id ranks last; of rows that tie in id and text one stays; an
    empty table stays empty.
    """
    runs = _runs(docs, id_col, text_col, keep, 64, 128, docs.columns)
    said = F.when(~F.col("_row.none"), F.col("_text"))
    back = [said if c == text_col else F.col(f"_row.c{i}") for i, c in enumerate(docs.columns)]
    return runs.where("_kept").select(*[c.alias(f"c{i}") for i, c in enumerate(back)]).toDF(*docs.columns)
