"""Nested evaluation documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULTS = "map<string,map<string,string>>"


def results_of(text: Column) -> Column:
    """results of a document as task -> metric -> text; NULL where it cannot be parsed."""
    return F.from_json(F.get_json_object(text, "$.results"), RESULTS)


def long_metrics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, task, metric, value, stderr): metric names may hold commas, values may be strings."""
    tasks = docs.select(key, F.explode(results_of(F.col(text))).alias("task", "_m"))
    every = tasks.select(key, "task", F.explode("_m").alias("metric", "_v"))
    every = every.withColumn("value", F.col("_v").try_cast("double")).drop("_v")
    error = r"^(.*)_stderr(,.*)?$"
    errors = every.where(F.col("metric").rlike(error)).select(
        key, "task", F.concat(F.regexp_extract("metric", error, 1), F.regexp_extract("metric", error, 2)).alias("metric"), F.col("value").alias("stderr")
    )
    values = every.where(~F.col("metric").rlike(error) & (F.col("metric") != "alias"))
    return values.join(errors, [key, "task", "metric"], "left")
