"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_windows, read_back
from .common import table, texts
from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .html_blocks import extract_main_text
from .jaccard import jaccard_components
from .lm import lm_scores
from .packing import pack
from .pii import find_personal_data
from .quality import resample
from .tokens import token_counts


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(texts(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(texts(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(texts(spark, sf_dir), keep="largest")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(texts(spark, sf_dir), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select(
        "doc_id", F.col("_n").alias("n_features"), F.col("_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), F.col("_kept").alias("kept")
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(texts(spark, sf_dir))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(texts(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(texts(spark, sf_dir))


def with_probe(conversations: DataFrame) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
                F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")),
            )
        ).alias("t"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionAll(extra.select("conv_id", "t.*"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(chat_windows(with_probe(texts(spark, sf_dir, "conversations"))))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(texts(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_html_extraction": op2_html_extraction,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality": op4_quality,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_personal_data": op7_personal_data,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_token_counts": op9_token_counts,
        "op10_decontamination": op10_decontamination,
    }


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (g, n)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(x, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.x = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON d.doc_id = m.x
"""

OP8_SQL = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, len(regexp_extract_all(coalesce(text, ''), '\\S+')) + 4 AS k,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM c),
u AS (SELECT *, pos = 1 AND r = 'system' AS sys, sum(k) OVER (PARTITION BY conv_id ORDER BY pos) - k AS bef FROM t),
v AS (SELECT *, max(CASE WHEN sys THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS sk,
  max(CASE WHEN NOT sys THEN k ELSE 1 END) OVER (PARTITION BY conv_id) AS most FROM u),
w AS (SELECT *, CASE WHEN sys THEN 0 ELSE floor((bef - sk) / greatest(1024 - 256 - sk - most, 1)) END AS span FROM v),
d AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY span) - 1 AS win FROM w),
e AS (SELECT *, max(win) OVER (PARTITION BY conv_id) AS last, row_number() OVER q AS rk, sum(k) OVER q AS tl FROM d
  WINDOW q AS (PARTITION BY conv_id, win ORDER BY pos DESC)),
f AS (SELECT *, CASE WHEN sys THEN last + 1 WHEN rk <= 2 AND tl <= 256 AND win < last THEN 2 ELSE 1 END AS copies,
  length('<|im_start|>' || url_encode(r) || chr(10) || regexp_replace(replace(x, chr(92), chr(92) || chr(92)),
    '([<\\[])(\\|im_start\\|>|\\|im_end\\|>|/?s>|/?INST\\]|</?SYS>>)', '\\1' || chr(92) || chr(92) || '\\2', 'g') || '<|im_end|>' || chr(10)) AS size FROM e),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY pos) AS said,
  coalesce(string_agg(x, '' ORDER BY pos) FILTER (r = 'assistant'), '') AS loss, sum(copies * size) AS chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3_SQL,
        "op6_ngram_jaccard": OP6_SQL,
        "op8_chat_formatting": OP8_SQL,
        "op10_decontamination": OP10_SQL,
    }
