"""Quality signals of corpus records: typed features, calibration bounds, groups and their score.

A record has scalar rule and relevance fields and short lists; a list of the wrong
length or with one element that is not finite is missing as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists, numeric
from ..functions.hashing import role
from .stats import weighted_quantiles

# The field names of the signal records, the features made of them, and the groups.
RULES = [
    "rps_doc_frac_no_alph_words", "rps_doc_mean_word_length", "rps_doc_frac_unique_words", "rps_doc_unigram_entropy",
    "rps_doc_word_count", "rps_lines_ending_with_terminal_punctution_mark", "rps_lines_numerical_chars_fraction",
    "rps_lines_uppercase_letter_fraction", "rps_doc_num_sentences", "rps_doc_frac_chars_top_2gram", "rps_doc_frac_chars_top_3gram",
]
RELEVANCE = ["dsir_books", "dsir_wiki", "dsir_math"]
ORDINAL = ["modernbert_professionalism", "modernbert_readability", "modernbert_reasoning", "modernbert_cleanliness"]
BINARY = ["ad_en", "fluency_en"]
RATED = ["qurater_writing_style", "qurater_required_expertise", "qurater_facts_trivia", "qurater_educational_value"]
MODEL = ["fineweb_edu", "ad_en", "fluency_en", *RATED, *ORDINAL]
USABILITY = ["ad_en", "fluency_en", "modernbert_readability", "modernbert_cleanliness", "qurater_writing_style"]
KNOWLEDGE = ["modernbert_professionalism", "qurater_required_expertise", "qurater_facts_trivia"]
REASONING = ["modernbert_reasoning", "fineweb_edu", "qurater_educational_value"]
GROUPS = {"usability": USABILITY, "knowledge": KNOWLEDGE, "education_reasoning": REASONING}

LISTS = {"fineweb_edu": 1, "ad_en": 2, "fluency_en": 2, "qurater": 4} | {k: 6 for k in ORDINAL}
SCHEMA = (
    "id string, sub_path string, _source_domain string, "
    + ", ".join(f"{c} double" for c in [*RULES, *RELEVANCE])
    + ", "
    + ", ".join(f"{c} array<double>" for c in LISTS)
)


def identified(records: DataFrame, code: str, line: str, fallback: str) -> DataFrame:
    """domain and where it came from, key, is_unique_first, overlap_a1 and role.

    The first file (code 0) is the calibration source; a repeat of a key in any later
    place is not its first.  An empty domain counts as missing.
    """
    raw = F.nullif(F.col("_source_domain"), F.lit(""))
    x = records.withColumn("domain", F.coalesce(raw, F.col(fallback), F.lit("unknown"))).withColumn(
        "domain_source", F.when(raw.isNotNull(), "record").when(F.col(fallback).isNotNull(), "file").otherwise("none")
    )
    x = x.withColumn("key", F.concat(F.lit('["'), F.col("id"), F.lit('","'), F.col("sub_path"), F.lit('"]')))
    w = Window.partitionBy("key")
    x = x.withColumn("is_unique_first", F.row_number().over(w.orderBy(code, line)) == 1)
    x = x.withColumn("overlap_a1", (F.min(code).over(w) == 0) & (F.col(code) > 0))
    return x.withColumn("role", F.when(F.col(code) == 0, role(F.col("key"))).otherwise("extension"))


def features(records: DataFrame) -> DataFrame:
    """The 25 scalar features; class lists give the index of their largest element."""
    cols = {c: numeric.finite(F.col(c)) for c in [*RULES, *RELEVANCE]}
    ok = {c: lists.is_valid(F.col(c), n) for c, n in LISTS.items()}
    cols["fineweb_edu"] = F.when(ok["fineweb_edu"], F.col("fineweb_edu")[0])
    for c in [*BINARY, *ORDINAL]:
        cols[c] = F.when(ok[c], lists.argmax(F.col(c))).cast("double")
    for i, c in enumerate(RATED):
        cols[c] = F.when(ok["qurater"], F.col("qurater")[i])
    keep = [c for c in records.columns if c not in cols and c != "qurater"]
    return records.select(*keep, *[v.alias(k) for k, v in cols.items()])


def bounds(x: DataFrame) -> dict[str, tuple[float, float]]:
    """Low and high of each model feature: fixed ranges, or the equal-domain 1-99 % of calibration rows."""
    out = {c: (0.0, 5.0) for c in ORDINAL} | {c: (0.0, 1.0) for c in BINARY}
    rated = [c for c in MODEL if c not in out]
    cal = x.where((F.col("role") == "calibration") & F.col("is_unique_first"))
    sizes = cal.groupBy("domain").agg(F.count("*").alias("_n"))
    k = sizes.agg(F.count("*").alias("_k"))
    sizes = sizes.crossJoin(F.broadcast(k))  # one row
    long = cal.select("domain", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in rated])).alias("_x"))
    long = long.select("domain", "_x.*").join(sizes, "domain").withColumn("_w", 1.0 / (F.col("_k") * F.col("_n")))
    # a row per rated feature
    for r in weighted_quantiles(long, ["feature"], "v", "_w", {"lo": 0.01, "hi": 0.99}).collect():
        out[r["feature"]] = (r["lo"], r["hi"])
    for c, (low, high) in out.items():
        if low is None or high is None or not high > low:
            raise ValueError(f"no usable bounds for {c}: {low}, {high}")
    return out


def scored(x: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """norm_*, group_*, q (strict), n_missing, disagreement and two alternates."""
    x = x.withColumns({f"norm_{c}": numeric.clipped(F.col(c), F.lit(a), F.lit(b)) for c, (a, b) in limits.items()})
    x = x.withColumns({f"group_{g}": numeric.strict_mean(*[F.col(f"norm_{c}") for c in cs]) for g, cs in GROUPS.items()})
    groups = [F.col(f"group_{g}") for g in GROUPS]
    norms = [F.col(f"norm_{c}") for c in MODEL]
    missing = [F.when(F.col(f"norm_{c}").isNull(), F.lit(c)) for c in MODEL]
    return x.withColumns(
        {
            "missing_features": F.concat_ws("|", *missing),
            "n_missing": sum(n.isNull().cast("int") for n in norms),
            "q": numeric.strict_mean(*groups),
            "n_groups_valid": sum(g.isNotNull().cast("int") for g in groups),
            "disagreement_range": F.when(F.coalesce(*groups).isNotNull(), F.coalesce(numeric.skipping_range(*groups), F.lit(0.0))),
            "disagreement_std": F.when(F.coalesce(*groups).isNotNull(), F.coalesce(numeric.skipping_std(*groups), F.lit(0.0))),
            "q_equal_indicator": numeric.strict_mean(*norms),
            "q_without_knowledge": numeric.strict_mean(groups[0], groups[2]),
        }
    )
