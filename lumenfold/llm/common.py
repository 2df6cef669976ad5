"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import discard, new_path, scratch, written  # noqa: F401
from ..sources.readers import spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are work: dealt over all cores where it has fewer splits than they are."""
    return spread(table(spark, sf_dir, name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; a text of ASCII only takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def values(column, size: int = 256):
    """A column of an Arrow batch as Python values, a few at a time: long texts are not all held at once."""
    for i in range(0, len(column), size):
        yield from column.slice(i, size).to_pylist()


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, to be taken apart again: no helper column can clash with them, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def releasing(run):
    """A function over Arrow batches that gives freed memory back to the system at its end: workers live on between stages."""

    def inner(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return inner
