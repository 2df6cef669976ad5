"""Tables written between steps: they cut the lineage, and lost executors don't take them along."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The rows' shuffles are of no use once they are written; batches for Python workers hold long texts, so few.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_scratch: contextvars.ContextVar = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of this machine only where the session runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lumenfold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    was = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if (made := _scratch.get()) is not None:
        made.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    delete(df.sparkSession, df._written_to)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those given to the function that it yields."""
    kept: list[str] = []
    token = _scratch.set([])
    try:
        yield lambda df: kept.append(df._written_to) or df
    finally:
        made = _scratch.get()
        _scratch.reset(token)
        outer = _scratch.get()
        for path in made:
            if path not in kept:
                delete(spark, path)
            elif outer is not None:
                outer.append(path)
