"""Text Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
URL = r"https?://[^\s<>\"]+"


def folded(x: Column) -> Column:
    """Lower case, letters and digits of ASCII only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def base_name(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))


def repository_of(url: Column) -> Column:
    """owner/name of a repository address, NULL if it isn't one."""
    found = F.lower(F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+/[^/?#]+)", 1))
    return F.nullif(found, F.lit(""))


def argument(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"{name}=([^,]+)", 1), F.lit(""))


def redacted(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, EMAIL, "[EMAIL]"), URL, "[URL]")


def redactions(x: Column) -> Column:
    return F.regexp_count(x, F.lit(EMAIL)) + F.regexp_count(F.regexp_replace(x, EMAIL, " "), F.lit(URL))


def excerpt(x: Column, size: int = 240) -> Column:
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, size)


def words(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), "[ \t\n\r]+"), lambda w: w != "")


def classify(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose text is contained; the order of rules matters."""
    out, low = None, F.lower(x)
    for needle, label in rules:
        hit = low.contains(needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """NFKC normal form; Spark has no built-in for it."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))
