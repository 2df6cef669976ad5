"""Date Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def midpoint(a: Column, b: Column) -> Column:
    return F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))


def local_date(seconds: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone))


def calendar_window(d: Column, ends: list[tuple[str, str]], after: str) -> Column:
    """The label of the first end that d does not pass; ends are inclusive."""
    out = None
    for end, label in ends:
        hit = d <= F.lit(end).cast("date")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(d.isNull(), F.lit(None)).otherwise(out.otherwise(after))


def bin_open_right(x: Column, edges: list[float], labels: list[str]) -> Column:
    """[edge, next): a value on an edge falls into the upper bin."""
    out = None
    for e, label in zip(edges, labels, strict=False):
        out = F.when(x < e, label) if out is None else out.when(x < e, label)
    return F.when(x.isNull(), F.lit(None)).otherwise(out.otherwise(labels[-1]))


def bin_closed_right(x: Column, edges: list[float], labels: list[str]) -> Column:
    """(edge, next]: a value on an edge falls into the lower bin."""
    out = None
    for e, label in zip(edges, labels, strict=False):
        out = F.when(x <= e, label) if out is None else out.when(x <= e, label)
    return F.when(x.isNull(), F.lit(None)).otherwise(out.otherwise(labels[-1]))
