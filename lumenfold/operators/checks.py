"""Contracts as rows: cardinality guards, comparisons, manifests and seals."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    pass


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    found = repeated_keys(df, keys).take(3)
    if found:
        raise CardinalityError(f"keys {keys} repeat: {[r.asDict() for r in found]}")
    return df


def check_rows(df: DataFrame, checks: dict[str, tuple[Column, object]]) -> DataFrame:
    """One pass over df: check_id, status, actual, expected.  A NULL actual is NOT_CHECKED."""
    values = [c.cast("string").alias(f"c{i}") for i, (c, _) in enumerate(checks.values())]
    one = df.agg(*values)
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("check_id"), F.col(f"c{i}").alias("actual"), F.lit(str(e)).alias("expected"))
            for i, (k, (_, e)) in enumerate(checks.items())
        ]
    )
    return one.select(F.inline(rows)).withColumn(
        "status", F.when(F.col("actual").isNull(), "NOT_CHECKED").when(F.col("actual") == F.col("expected"), "PASS").otherwise("FAIL")
    )


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within a tolerance; two missing or two NaN values are equal."""
    both_nan = F.isnan(a) & F.isnan(b)
    return F.coalesce(a.eqNullSafe(b) | both_nan | (F.abs(a - b) <= tolerance), F.lit(False))


def compare_columns(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """A row per column of either side: both types, whether they agree, rows at equal keys, and how many are equal, by type.

    Numbers compare within the tolerance (NaN equals NaN, NULL equals NULL), all else exactly; columns of one side have no counts.
    """
    types = [dict(left.dtypes), dict(right.dtypes)]
    number = ("double", "float", "int", "bigint", "smallint", "tinyint")
    names = [c for c in [*left.columns, *[c for c in right.columns if c not in types[0]]] if c not in keys]
    both = [c for c in names if all(c in t for t in types)]
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_a{i}") for i, c in enumerate(both)])
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_b{i}") for i, c in enumerate(both)])
    x = a.join(b, [f"_k{i}" for i in range(len(keys))])
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(both):
        p, q = F.col(f"_a{i}"), F.col(f"_b{i}")
        if all(t[c] in number or t[c].startswith("decimal") for t in types):
            p, q = p.cast("double"), q.cast("double")
            aggs += [F.count_if(close(p, q, tolerance)).alias(f"e{i}"), F.max(F.abs(p - q)).alias(f"m{i}")]
        else:
            same = p.eqNullSafe(q) if types[0][c] == types[1][c] else p.cast("string").eqNullSafe(q.cast("string"))
            aggs += [F.count_if(same).alias(f"e{i}"), F.lit(None).cast("double").alias(f"m{i}")]
    none = F.lit(None)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(types[0].get(c)).alias("type_left"), F.lit(types[1].get(c)).alias("type_right"),
            F.lit(types[0].get(c) == types[1].get(c)).alias("same_type"),
            (F.col("n") if c in both else none).cast("long").alias("n_rows"), (F.col(f"e{both.index(c)}") if c in both else none).cast("long").alias("n_equal"),
            (F.col(f"m{both.index(c)}") if c in both else none).cast("double").alias("max_abs"),
        )
        for c in names
    ]
    return x.agg(*aggs).select(F.inline(F.array(*rows)))


def duplicate_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct_keys, duplicate_rows of candidate keys; NaN equals NaN, NULL equals NULL."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(
        F.sum("n").cast("long").alias("rows"),
        F.count("*").alias("distinct_keys"),
        F.sum(F.col("n") - 1).cast("long").alias("duplicate_rows"),
    )


def manifest_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and what differs: missing, extra, changed; equal files are left out."""
    e = expected.select("path", F.col("sha256").alias("was"))
    a = actual.select("path", F.col("sha256").alias("now"))
    return e.join(a, "path", "full").select(
        "path",
        F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("was") != F.col("now"), "changed").alias("difference"),
    ).where(F.col("difference").isNotNull())


class Seal:
    """Frozen bytes whose digest must match before later partitions may be read."""

    ORDER = ("calibration", "seal", "holdout", "extension")

    def __init__(self):
        self.done: list[str] = []
        self.digest: str | None = None

    def freeze(self, content: bytes) -> str:
        self.step("seal")
        self.digest = hashlib.sha256(content).hexdigest()
        return self.digest

    def check(self, content: bytes) -> None:
        if hashlib.sha256(content).hexdigest() != self.digest:
            raise ValueError("the sealed content has changed")

    def check_file(self, path: str) -> None:
        self.check(Path(path).read_bytes())

    def step(self, name: str) -> None:
        """Phases run in ORDER; none may be skipped or repeated."""
        if self.ORDER.index(name) != len(self.done):
            raise ValueError(f"{name} cannot follow {self.done}")
        self.done.append(name)
