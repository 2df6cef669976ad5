"""Sinks: explicit column order, JSON without NaN, manifests written last."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from .readers import manifest


def parquet(df: DataFrame, path: str, columns: list[str], partition_by: list[str] | None = None) -> None:
    """zstd Parquet; the commit protocol makes a run's files appear at once."""
    w = df.select(*columns).write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def report_csv(df: DataFrame, path: str, columns: list[str], gzip: bool = False, byte_order_mark: bool = False) -> None:
    """A small report as one file; doubles keep 17 digits.  The mark, if asked for, stands before the header."""
    x = df.select(*[F.format_string("%.17g", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.select(*columns).dtypes])
    if byte_order_mark:
        names = df.sparkSession.createDataFrame([tuple(columns)], ", ".join(f"`{c}` string" for c in columns))
        line = lambda y, mark="": y.select(F.concat(F.lit(mark), F.to_csv(F.struct(*columns))).alias("value"))
        # one task writes the parts in their order: the header's first
        w = line(names, "\ufeff").coalesce(1).unionAll(line(x).coalesce(1)).coalesce(1).write
        (w.option("compression", "gzip") if gzip else w).text(path)
        return
    w = x.coalesce(1).write.option("header", "true")
    (w.option("compression", "gzip") if gzip else w).csv(path)


def markdown(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A small report as a Markdown table, in the order of its rows; an error where it is not small."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *[[cell(v) for v in r] for r in rows]]
    return "".join("| " + " | ".join(x) + " |\n" for x in lines)


def without_nan(x: Column, kind: DataType) -> Column:
    """NULL for NaN and infinities, inside arrays, structs and maps too."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda v: without_nan(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, v: without_nan(v, kind.valueType))
    if isinstance(kind, StructType):
        parts = F.struct(*[without_nan(x[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(x.isNotNull(), parts)
    return x


def json_rows(df: DataFrame, path: str) -> None:
    """NaN and infinities are null, at any depth."""
    x = df.select(*[without_nan(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    x.write.option("ignoreNullFields", "false").json(path)


def run_manifest(spark, folder: str, path: str) -> None:
    """path, bytes and digest of every file of a run; written last, so its presence seals the run."""
    manifest(spark, folder).orderBy("path").coalesce(1).write.option("header", "true").csv(path)


class EventLog:
    """Append-only JSON lines of stage events, written by the driver."""

    def __init__(self, path: str):
        self.path = path

    def add(self, stage: str, **fields) -> None:
        line = json.dumps({"at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "stage": stage, **fields}, allow_nan=False)
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(line + "\n")
            f.flush()
            os.fsync(f.fileno())
