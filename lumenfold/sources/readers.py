"""Scans: CSV, JSON lines (also xz), JSON documents, manifests, fixtures."""

from __future__ import annotations

import io
import json
import lzma

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.quality import of_roles


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer splits than they are (a file of one row group is one split), else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def csv(spark: SparkSession, paths: str | list[str], schema: StructType | str, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV by an explicit schema; a byte-order mark does not reach the first name."""
    df = spark.read.csv(paths, schema=schema, header=True, encoding=encoding, enforceSchema=True, mode="PERMISSIVE")
    return df.select(*columns) if columns else df


def csv_union(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """Files of one schema with file_name."""
    return csv(spark, glob, schema).select("*", F.col("_metadata.file_name").alias("file_name"))


def json_lines(spark: SparkSession, paths: str | list[str], schema: StructType, strict: bool = False) -> DataFrame:
    """Plain or gzip JSON lines; strict: a bad line stops the read, else it is in _corrupt."""
    if strict:
        return spark.read.json(paths, schema=schema, mode="FAILFAST")
    wide = StructType([*schema.fields]).add("_corrupt", "string")
    return spark.read.json(paths, schema=wide, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_no, line) of .xz files: a task holds a compressed file (2 GB at most) and a block of its text.

    XzSource streams files of a mounted folder of any size.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(it):
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                names, numbers, lines = [], [], []
                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8") as f:
                    for i, line in enumerate(f, 1):
                        names.append(p.rsplit("/", 1)[-1])
                        numbers.append(i)
                        lines.append(line.rstrip("\n"))
                        if len(lines) >= 20_000:
                            yield pd.DataFrame({"file_name": names, "line_no": numbers, "line": lines})
                            names, numbers, lines = [], [], []
                yield pd.DataFrame({"file_name": names, "line_no": numbers, "line": lines})

    return files.mapInPandas(run, "file_name string, line_no long, line string")


class XzSource(DataSource):
    """spark.read.format("xzlines").load(path): one partition per file of a local or mounted folder."""

    @classmethod
    def name(cls):
        return "xzlines"

    def schema(self):
        return "file_name string, line_no long, line string"

    def reader(self, schema):
        return XzReader(self.options["path"])


class XzReader(DataSourceReader):
    def __init__(self, path):
        self.path = path

    def partitions(self):
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        with lzma.open(partition.value, "rt", encoding="utf-8") as f:
            for i, line in enumerate(f, 1):
                yield partition.value.rsplit("/", 1)[-1], i, line.rstrip("\n")


def parsed(lines: DataFrame, schema: StructType, strict: bool = False) -> DataFrame:
    """Decoded lines as columns; strict fails on a bad line, else `bad` marks it."""
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "allowNonNumericNumbers": "true"}
    x = lines.withColumn("_r", F.from_json("line", schema, options))
    good = F.col("_r").isNotNull() & F.expr("try_parse_json(line)").isNotNull()
    return x.select("file_name", "line_no", (~good).alias("bad"), "_r.*")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """file_name, n_bytes, text, status, error, error_at: a parse log with a document per file."""
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"), F.col("content").cast("string").alias("text")
    )

    @F.pandas_udf("struct<status:string,error:string,error_at:long>")
    def tried(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            try:
                json.loads(t)
                rows.append(("ok", None, None))
            except json.JSONDecodeError as e:
                cut = e.pos >= len(t.rstrip()) - 1 or not t.rstrip().endswith(("}", "]"))
                rows.append(("truncated" if cut else "malformed", e.msg, e.pos))
        return pd.DataFrame(rows, columns=["status", "error", "error_at"])

    return files.withColumn("_t", tried("text")).select("file_name", "n_bytes", "text", "_t.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def parquet_role(spark: SparkSession, path: str, roles: list[str], column: str = "evaluation_role") -> DataFrame:
    """Rows of the named roles: the filter reaches the scan, and on a partitioned table other roles are not read.

    An error if a row of another role, or of none, comes through.
    """
    return of_roles(spark.read.parquet(path), column, roles)


def config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def legacy_table(spark: SparkSession, path: str, pattern: str, names: list[str], encoding: str = "gb18030") -> DataFrame:
    """Irregular delimited text in an old encoding: each line's fields by one pattern, anchored at its tail."""

    def decoded(it):
        # Spark decodes a few standard encodings only
        for pdf in it:
            for content in pdf["content"]:
                yield pd.DataFrame({"line": bytes(content).decode(encoding, "replace").splitlines()})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decoded, "line string")
    return lines.where(F.col("line").rlike(pattern)).select(*[F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(names)])
