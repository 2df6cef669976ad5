"""A registry of named queries, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are work: dealt over all cores."""
    return spread(table(spark, sf_dir, name))


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


# the document features in SQL, for the oracles that start from them
DOC_FEATURES = """
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
        CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) END AS mean_word_length,
        CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / len(w) END AS unique_share,
        CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]')))::DOUBLE / len(w) END AS no_alpha_share,
        len(regexp_extract_all(t, '[.!?]'))::BIGINT AS n_sentences,
        CASE WHEN ('0x' || substr(sha256('20260924' || doc_id::VARCHAR), 1, 16))::UBIGINT % 5 = 0 THEN 'holdout' ELSE 'calibration' END AS role
      FROM w)"""


def weighted_quantile_sql(source: str, by: list[str], value: str, weight: str, share: float, name: str) -> str:
    """Midpoint-position quantile over the rows of `source`."""
    keys = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""(SELECT {keys}CASE WHEN lo IS NULL THEN hi_v WHEN hi IS NULL THEN lo_v WHEN hi = lo THEN lo_v
        ELSE lo_v + (hi_v - lo_v) * ({share} - lo) / (hi - lo) END AS {name} FROM (
      SELECT {keys}max(p) FILTER (p <= {share}) AS lo, arg_max(v, p) FILTER (p <= {share}) AS lo_v,
             min(p) FILTER (p >= {share}) AS hi, arg_min(v, p) FILTER (p >= {share}) AS hi_v FROM (
        SELECT {keys}v, (sum(wt) OVER ({part} ORDER BY v, wt ROWS UNBOUNDED PRECEDING) - wt / 2) / sum(wt) OVER ({part}) AS p FROM (
          SELECT {keys}{value} AS v, {weight} AS wt FROM {source} WHERE {value} IS NOT NULL)) {group}))"""


def bounds_sql() -> str:
    """CTEs cal and one-row bounds of the three bounded features."""
    parts = []
    for v in ("mean_word_length", "unique_share", "no_alpha_share"):
        for s, k in ((0.01, "lo"), (0.99, "hi")):
            parts.append(weighted_quantile_sql("cal", [], v, f"w_{v}", s, f"{v}_{k}"))
    weights = ", ".join(
        f"CASE WHEN {v} IS NOT NULL THEN 1.0::DOUBLE / (count({v}) OVER (PARTITION BY lang) * (SELECT count(DISTINCT lang) FROM f WHERE role = 'calibration' AND {v} IS NOT NULL)) END AS w_{v}"
        for v in ("mean_word_length", "unique_share", "no_alpha_share")
    )
    cross = " CROSS JOIN ".join(parts)
    return f"cal AS (SELECT *, {weights} FROM f WHERE role = 'calibration'),\nbnd AS (SELECT * FROM {cross})"


def scored_sql() -> str:
    z = ", ".join(
        f"CASE WHEN {v} IS NULL OR {v}_hi <= {v}_lo THEN NULL ELSE least(greatest(({v} - {v}_lo) / ({v}_hi - {v}_lo), 0.0), 1.0) END AS z_{v}"
        for v in ("mean_word_length", "unique_share", "no_alpha_share")
    )
    return f"""WITH {DOC_FEATURES},
{bounds_sql()},
z AS (SELECT f.*, {z} FROM f CROSS JOIN bnd),
s AS (SELECT *, (z_mean_word_length + z_unique_share + z_no_alpha_share) / 3.0 AS q FROM z)"""
