"""Named materialised tables with a marker that says what they were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """A stage is reused only if its inputs, configuration and code digests are those of its marker."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def identity(self, name: str, inputs: list[str], config: dict, code: str) -> str:
        text = json.dumps([name, inputs, config, hashlib.sha256(code.encode()).hexdigest()], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()

    def verdict(self, name: str, identity: str) -> str:
        """REUSABLE, NOT_STARTED or INVALID."""
        fs, marker = self._fs(f"{self.folder}/{name}.marker")
        if not fs.exists(marker):
            return "NOT_STARTED"
        held = self.spark.read.text(f"{self.folder}/{name}.marker").first()[0]
        return "REUSABLE" if held == identity else "INVALID"

    def run(self, name: str, identity: str, build) -> DataFrame:
        """The table of a stage, built unless reusable; payload first, marker last."""
        state = self.verdict(name, identity)
        path = f"{self.folder}/{name}"
        if state == "INVALID":
            raise ValueError(f"{name} was made from other inputs; use a new folder")
        if state == "NOT_STARTED":
            build().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(identity,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.marker")
        return self.spark.read.parquet(path)
