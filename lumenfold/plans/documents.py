"""Queries over documents, labels, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..functions.hashing import canonical_key, fingerprint, role, split_remainder
from ..operators import bootstrap, joins, ordering, quality, rows, stats, summary
from ..operators.store import written
from .base import DOC_FEATURES, query, r6, rounded, scored_sql, table, texts, weighted_quantile_sql


def _features(spark, d) -> DataFrame:
    """The narrow columns of all texts, cut once and written: what follows reads them as often as it needs."""
    return written(quality.text_features(texts(spark, d)), "text-features")


def _scored(spark, d) -> DataFrame:
    return quality.scored(_features(spark, d))


@query("""SELECT doc_id, (('0x' || substr(sha256('20260924' || doc_id::VARCHAR), 1, 16))::UBIGINT % 5)::INTEGER AS remainder,
  sha256('["' || doc_id::VARCHAR || '","' || source || '"]') AS key FROM documents""")
def doc_hash_split(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", split_remainder(F.col("doc_id").cast("string")).alias("remainder"), canonical_key(F.col("doc_id"), F.col("source")).alias("key"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY source, doc_id) = 1 AS is_first FROM documents""")
def doc_first_seen_dedup(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"))
    return rows.first_seen(x, ["k"], ["source", "doc_id"]).select("doc_id", "is_first")


@query("""SELECT n_conflicting::BIGINT AS n_conflicting FROM (SELECT count(*) AS n_conflicting FROM (
  SELECT sha256(coalesce(text, '')) AS k FROM documents GROUP BY k HAVING count(DISTINCT lang) > 1))""")
def doc_domain_conflicts(spark, d):
    x = table(spark, d, "documents").select("lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"))
    return rows.conflicts(x, ["k"], "lang").agg(F.count("*").alias("n_conflicting"))


@query("""WITH x AS (SELECT doc_id, sha256(coalesce(text, '')) AS k, CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END AS r FROM documents)
SELECT doc_id, min(r) OVER (PARTITION BY k) < r AS overlap_any, min(r) OVER (PARTITION BY k) = 0 AND r > 0 AS overlap_base FROM x""")
def doc_overlap_flags(spark, d):
    rank = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(2)
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"), rank.alias("r"))
    return rows.overlap_flags(x, ["k"], "r").select("doc_id", "overlap_any", "overlap_base")


@query(f"""WITH {DOC_FEATURES} SELECT doc_id, lang, source, n_words, round(mean_word_length, 6) AS mean_word_length,
  round(unique_share, 6) AS unique_share, round(no_alpha_share, 6) AS no_alpha_share, n_sentences, role FROM f""")
def doc_text_features(spark, d):
    return rounded(quality.text_features(texts(spark, d)), "mean_word_length", "unique_share", "no_alpha_share")


@query("""WITH x AS (SELECT d.source, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, count(*)::BIGINT AS n_total, count(quality)::BIGINT AS n_labelled,
  round(count(quality)::DOUBLE / count(*), 6) AS coverage, round(avg(quality), 6) AS mean_quality, sum(toxic)::BIGINT AS n_toxic
FROM x GROUP BY GROUPING SETS ((source, lang), (source))""")
def label_coverage_by_source(spark, d):
    x = joins.guarded(table(spark, d, "documents").select("doc_id", "source", "lang"), table(spark, d, "labels"), ["doc_id"], "left")
    n = F.count("*")
    return summary.with_all(x, ["source"], "lang", [
        n.alias("n_total"), F.count("quality").alias("n_labelled"), r6(F.count("quality") / n).alias("coverage"),
        r6(F.avg("quality")).alias("mean_quality"), F.sum("toxic").alias("n_toxic")])


@query("""WITH x AS (SELECT source, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, statistic, n_total::BIGINT AS n_total, n_effective::BIGINT AS n_effective, ddof::BIGINT AS ddof, (n_effective - ddof)::BIGINT AS divisor FROM (
  SELECT source, 'mean_quality' AS statistic, count(*) AS n_total, count(quality) AS n_effective, 0 AS ddof FROM x GROUP BY source
  UNION ALL SELECT source, 'std_quality', count(*), count(quality), 1 FROM x GROUP BY source)""")
def denominator_ledger(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return summary.denominators(x, ["source"], ["quality"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def label_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT lang, round(count(l.doc_id)::DOUBLE / count(*), 6) AS member_rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def label_membership_rate(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.lit(1).alias("m"))
    return table(spark, d, "documents").select("doc_id", "lang").join(l, "doc_id", "left").groupBy("lang").agg(r6(F.count("m") / F.count("*")).alias("member_rate"))


def _bounds_oracle():
    w = "SELECT f.*, 1.0::DOUBLE / (count(*) OVER (PARTITION BY lang) * (SELECT count(DISTINCT lang) FROM f WHERE role = 'calibration' AND mean_word_length IS NOT NULL)) AS wt0 FROM f WHERE role = 'calibration' AND mean_word_length IS NOT NULL"
    lo = weighted_quantile_sql("cal", [], "mean_word_length", "wt0", 0.01, "lo")
    hi = weighted_quantile_sql("cal", [], "mean_word_length", "wt0", 0.99, "hi")
    return f"WITH {DOC_FEATURES}, cal AS ({w}) SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM {lo} CROSS JOIN {hi}"


@query(_bounds_oracle())
def robust_bounds_weighted(spark, d):
    b = quality.calibration_bounds(_features(spark, d), ("mean_word_length",), "lang")
    return b.select(r6("mean_word_length_lo").alias("lo"), r6("mean_word_length_hi").alias("hi"))


@query(scored_sql() + " SELECT doc_id, round(q, 6) AS q FROM s")
def quality_score_strict(spark, d):
    return _scored(spark, d).select("doc_id", r6("q").alias("q"))


@query(scored_sql() + """ SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, role, count(*)::BIGINT AS n_total, count(q)::BIGINT AS n_valid,
  round(avg(q), 6) AS mean_q, round(stddev_samp(q), 6) AS std_q, round(quantile_cont(q, 0.1), 6) AS p10, round(quantile_cont(q, 0.5), 6) AS p50,
  round(quantile_cont(q, 0.9), 6) AS p90 FROM s GROUP BY GROUPING SETS ((role, lang), (role))""")
def quality_summary(spark, d):
    q = F.col("q")
    x = _scored(spark, d)
    g = summary.with_all(x, ["role"], "lang", [
        F.count("*").alias("n_total"), F.count(q).alias("n_valid"), r6(F.avg(q)).alias("mean_q"), r6(F.stddev_samp(q)).alias("std_q")])
    each = x.select("role", F.explode(F.array("lang", F.lit("ALL"))).alias("lang"), "q")
    pct = rounded(ordering.quantiles(each, ["role", "lang"], "q", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "p10", "p50", "p90")
    return ordering.null_safe_left(g, pct, ["role", "lang"])


@query(scored_sql() + """ SELECT doc_id, round(CASE WHEN (z_mean_word_length IS NOT NULL)::INT + (z_unique_share IS NOT NULL)::INT + (z_no_alpha_share IS NOT NULL)::INT > 1
  THEN greatest(z_mean_word_length, z_unique_share, z_no_alpha_share) - least(z_mean_word_length, z_unique_share, z_no_alpha_share) END, 6) AS spread FROM s""")
def disagreement_skipna(spark, d):
    z = [F.col(f"z_{v}") for v in quality.BOUNDED]
    return _scored(spark, d).select("doc_id", r6(numeric.skipping_range(*z)).alias("spread"))


@query(f"""WITH {DOC_FEATURES}, x AS (SELECT f.doc_id, lang, role, quality::DOUBLE AS v FROM f LEFT JOIN labels USING (doc_id)),
g AS (SELECT lang, count(*) FILTER (role = 'calibration') AS n, count(v) FILTER (role = 'calibration') AS k,
  count(DISTINCT CASE WHEN role = 'calibration' THEN v END) AS dd, quantile_cont(CASE WHEN role = 'calibration' THEN v END, 0.5) AS m FROM x GROUP BY lang)
SELECT doc_id, coalesce(v, CASE WHEN n >= 20 AND k >= 0.3 * n AND dd >= 2 THEN m END) AS v_imputed FROM x JOIN g USING (lang)""")
def gated_median_imputation(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", role(F.col("doc_id").cast("string")).alias("role"))
    x = x.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("v")), "doc_id", "left")
    return quality.imputed(x, "v", "lang", 20, 0.3).select("doc_id", "v_imputed")


@query(scored_sql() + """, m AS (SELECT source, avg(q) AS a, avg((z_mean_word_length + z_unique_share) / 2.0) AS b FROM s GROUP BY source)
SELECT source, (row_number() OVER (ORDER BY a DESC NULLS LAST, source))::BIGINT AS rank_primary, (row_number() OVER (ORDER BY b DESC NULLS LAST, source))::BIGINT AS rank_alternate FROM m""")
def sensitivity_rank_change(spark, d):
    x = _scored(spark, d).withColumn("alt", numeric.strict_mean(F.col("z_mean_word_length"), F.col("z_unique_share")))
    a = quality.domain_means(x, "source", "q").select("source", F.col("rank_in").cast("long").alias("rank_primary"))
    b = quality.domain_means(x, "source", "alt").select("source", F.col("rank_in").cast("long").alias("rank_alternate"))
    return a.join(b, "source")


PENALTY = """, t AS (SELECT lang, count(n_words) AS n2, quantile_cont(n_words, 0.95) AS a2, quantile_cont(n_words, 0.99) AS b2,
  count(n_sentences) AS n3, quantile_cont(n_sentences, 0.95) AS a3, quantile_cont(n_sentences, 0.99) AS b3 FROM f WHERE role = 'calibration' GROUP BY lang),
pen AS (SELECT s.*, n2 >= 30 AND b2 > a2 AS ok2, n3 >= 30 AND b3 > a3 AS ok3,
  CASE WHEN n2 >= 30 AND b2 > a2 THEN CASE WHEN n_words <= a2 THEN 0.0 WHEN n_words >= b2 THEN 1.0 ELSE (n_words - a2) / (b2 - a2) END END AS p2,
  CASE WHEN n3 >= 30 AND b3 > a3 THEN CASE WHEN n_sentences <= a3 THEN 0.0 WHEN n_sentences >= b3 THEN 1.0 ELSE (n_sentences - a3) / (b3 - a3) END END AS p3
  FROM s LEFT JOIN t USING (lang)),
c AS (SELECT *, q * (1 - 0.02 * (p2 + p3) / 2) AS q_c FROM pen)"""


@query(scored_sql() + PENALTY + """ SELECT doc_id, round(p2, 6) AS p2, round(p3, 6) AS p3, round(q_c, 6) AS q_c,
  CASE WHEN q IS NULL THEN 'MISSING_Q' WHEN NOT coalesce(ok2 AND ok3, false) THEN 'DOMAIN_INACTIVE' ELSE 'SUPPORTED' END AS status FROM c""")
def penalty_candidate(spark, d):
    x = quality.penalised(_scored(spark, d), ("n_words", "n_sentences"), "lang")
    return rounded(x.select("doc_id", "p2", "p3", "q_c", "status"), "p2", "p3", "q_c")


def _grid_oracle():
    parts = []
    for rate in (0.0, 0.01, 0.02, 0.05):
        parts.append(f"""SELECT {rate}::DOUBLE AS rate, lang, count(*)::BIGINT AS n, round(CASE WHEN count(*) > 1 THEN 1 - 6 * sum((ra - rb) * (ra - rb))::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END, 6) AS rho,
          round(count(*) FILTER (ra <= k AND rb <= k)::DOUBLE / count(*) FILTER (ra <= k OR rb <= k), 6) AS jaccard FROM (
          SELECT lang, greatest(1, ceil(0.1::DECIMAL(10,4) * count(*) OVER (PARTITION BY lang))) AS k, row_number() OVER (PARTITION BY lang ORDER BY qa DESC, doc_id) AS ra,
          row_number() OVER (PARTITION BY lang ORDER BY qb DESC, doc_id) AS rb FROM (SELECT lang, doc_id, round(q, 9) AS qa, round(q * (1 - {rate}::DOUBLE * (p2 + p3) / 2), 9) AS qb FROM pen WHERE q IS NOT NULL AND p2 + p3 IS NOT NULL)) GROUP BY lang""")
    return scored_sql() + PENALTY + " " + " UNION ALL ".join(parts)


@query(_grid_oracle())
def lambda_grid(spark, d):
    x = quality.penalised(_scored(spark, d), ("n_words", "n_sentences"), "lang").where(F.col("q").isNotNull() & (F.col("p2") + F.col("p3")).isNotNull())
    rates = {"r0": 0.0, "r1": 0.01, "r2": 0.02, "r5": 0.05}
    y = x.select("lang", "doc_id", F.round("q", 9).alias("qa"), *[
        F.round(quality.candidate(F.col("q"), F.col("p2"), F.col("p3"), v), 9).alias(k) for k, v in rates.items()])
    g = stats.rank_grid(y, ["lang"], "doc_id", "qa", {k: k for k in rates})
    rate = F.create_map(*[F.lit(z) for kv in rates.items() for z in kv])[F.col("variant")]
    return rounded(g.select(rate.alias("rate"), "lang", "n", "rho", "jaccard"), "rho", "jaccard")


@query(scored_sql() + """, h AS (SELECT lang, count(q) AS n, avg(q) FILTER (role = 'holdout') AS mh, avg(q) FILTER (role = 'calibration') AS mc, count(q) FILTER (role = 'holdout') AS nh FROM s GROUP BY lang)
SELECT lang, nh::BIGINT AS n_holdout, round(abs(mh - mc), 6) AS gap, CASE WHEN coalesce(nh >= 10, false) AND coalesce(abs(mh - mc) <= 0.05, false) THEN 'PASS'
  WHEN nh < 10 OR abs(mh - mc) > 0.05 THEN 'FAIL' ELSE 'INSUFFICIENT' END AS status FROM h""")
def holdout_gate(spark, d):
    h = F.col("role") == "holdout"
    g = _scored(spark, d).groupBy("lang").agg(F.count(F.when(h, F.col("q"))).alias("n_holdout"), F.abs(F.avg(F.when(h, F.col("q"))) - F.avg(F.when(~h, F.col("q")))).alias("gap"))
    return g.select("lang", "n_holdout", r6("gap").alias("gap"), summary.gate_status(F.col("n_holdout") >= 10, F.col("gap") <= 0.05).alias("status"))


@query("""WITH x AS (SELECT n_chars::DOUBLE AS v, CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END AS a, CASE WHEN lang = 'fr' THEN 1.0 ELSE 0 END AS b FROM documents WHERE lang IN ('en', 'fr') AND n_chars IS NOT NULL),
g AS (SELECT v, sum(a)::DOUBLE / (SELECT sum(a) FROM x)::DOUBLE - sum(b)::DOUBLE / (SELECT sum(b) FROM x)::DOUBLE AS g FROM x GROUP BY v),
c AS (SELECT v, sum(g) OVER (ORDER BY v) AS gap, lead(v) OVER (ORDER BY v) AS nv FROM g)
SELECT round(max(abs(gap)), 6) AS ks, round(coalesce(sum(abs(gap) * (nv - v)), 0), 6) AS w1 FROM c""")
def scope_distance_ks_w1(spark, d):
    return rounded(stats.two_sample(table(spark, d, "documents"), "lang", "en", "fr", "n_chars"), "ks", "w1")


@query("""WITH x AS (SELECT lang, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars IS NOT NULL),
r AS (SELECT lang, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM x),
s AS (SELECT sum(r) FILTER (lang = 'en') AS ra, count(*) FILTER (lang = 'en') AS na, count(*) FILTER (lang = 'fr') AS nb FROM r)
SELECT na::BIGINT AS na, nb::BIGINT AS nb, round((ra - na * (na + 1) / 2.0)::DOUBLE, 6) AS u, round((2 * (ra - na * (na + 1) / 2.0) / (na * nb) - 1)::DOUBLE, 6) AS cliffs_delta FROM s""")
def mann_whitney_lengths(spark, d):
    return rounded(stats.mann_whitney(table(spark, d, "documents"), "lang", "en", "fr", "n_chars"), "u", "cliffs_delta")


@query(scored_sql() + """, z3 AS (SELECT doc_id, round(z_mean_word_length, 9) AS a, round(z_unique_share, 9) AS b, round(z_no_alpha_share, 9) AS c FROM s)
SELECT doc_id, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL
  WHEN abs(a - b) = greatest(abs(a - b), abs(a - c), abs(b - c)) THEN CASE WHEN a >= b THEN 'length>unique' ELSE 'unique>length' END
  WHEN abs(a - c) = greatest(abs(a - b), abs(a - c), abs(b - c)) THEN CASE WHEN a >= c THEN 'length>plain' ELSE 'plain>length' END
  ELSE CASE WHEN b >= c THEN 'unique>plain' ELSE 'plain>unique' END END AS direction FROM z3""")
def conflict_direction(spark, d):
    z = [F.round(F.col(f"z_{v}"), 9) for v in quality.BOUNDED]
    return _scored(spark, d).select("doc_id", quality.conflict_direction(*z, ("length", "unique", "plain")).alias("direction"))


@query("""WITH x AS (SELECT (CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END + CASE WHEN l.toxic IS NULL THEN 2 ELSE 0 END + CASE WHEN d.n_chars > 2000 THEN 0 ELSE 4 END)::BIGINT AS mask FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT mask, count(*)::BIGINT AS n, bit_count(mask)::BIGINT AS n_missing FROM x GROUP BY mask""")
def missing_mask_patterns(spark, d):
    return summary.mask_patterns(_masked(spark, d), "mask")


def _masked(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return x.select(summary.mask_of([F.col("quality"), F.col("toxic"), F.when(F.col("n_chars") > 2000, 1)]).alias("mask"))


@query("""WITH x AS (SELECT l.quality IS NULL AS a, l.toxic IS NULL AS b, NOT d.n_chars > 2000 AS c FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'quality' AS column_a, 'quality' AS column_b, count(*) FILTER (a)::BIGINT AS n_both FROM x UNION ALL SELECT 'quality', 'toxic', count(*) FILTER (a AND b) FROM x
UNION ALL SELECT 'quality', 'long', count(*) FILTER (a AND c) FROM x UNION ALL SELECT 'toxic', 'toxic', count(*) FILTER (b) FROM x
UNION ALL SELECT 'toxic', 'long', count(*) FILTER (b AND c) FROM x UNION ALL SELECT 'long', 'long', count(*) FILTER (c) FROM x""")
def co_missing_matrix(spark, d):
    return summary.co_missing(summary.mask_patterns(_masked(spark, d), "mask"), "mask", ["quality", "toxic", "long"])


@query("""WITH g AS (SELECT sha256(coalesce(text, '')) AS k, max((source = 'src0')::INT) AS a, max((source = 'src1')::INT) AS b, max((source = 'src2')::INT) AS c FROM documents GROUP BY k)
SELECT 'src0' AS source_a, 'src1' AS source_b, sum(a * b)::BIGINT AS n_common FROM g UNION ALL SELECT 'src0', 'src2', sum(a * c)::BIGINT FROM g UNION ALL SELECT 'src1', 'src2', sum(b * c)::BIGINT FROM g""")
def pairwise_intersections(spark, d):
    x = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"), "source")
    return joins.pairwise_intersections(x, ["k"], "source", ["src0", "src1", "src2"])


HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1))"


@query(f"""WITH p AS (SELECT page_id, {HOST} AS host, regexp_extract(url, '([^/]*)$', 1) AS tail FROM pages),
r AS (SELECT page_id AS t, host AS h, tail AS b FROM p WHERE page_id % 3 = 0),
l AS (SELECT page_id, host, tail FROM p WHERE page_id % 3 <> 0),
a AS (SELECT h, min(t) AS t, count(DISTINCT t) AS n FROM r GROUP BY h), b AS (SELECT b, min(t) AS t, count(DISTINCT t) AS n FROM r GROUP BY b),
m AS (SELECT page_id, CASE WHEN b.n IS NOT NULL THEN 'tail' WHEN a.n IS NOT NULL THEN 'host' END AS rule, coalesce(b.n, a.n) AS n, CASE WHEN b.n IS NOT NULL THEN b.t ELSE a.t END AS t
  FROM l LEFT JOIN b ON l.tail = b.b LEFT JOIN a ON l.host = a.h),
f AS (SELECT page_id, CASE WHEN n = 1 THEN t END AS target, rule, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM m)
SELECT page_id, target, rule, CASE WHEN target IS NOT NULL AND count(*) OVER (PARTITION BY target) > 1 THEN 'shared' ELSE status END AS status FROM f""")
def url_entity_cascade(spark, d):
    p = table(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.base_name(F.col("url")).alias("tail"))
    known = p.where(F.col("page_id") % 3 == 0).select(F.col("page_id").alias("target"), "host", "tail")
    return joins.cascade(p.where(F.col("page_id") % 3 != 0), "page_id", known, "target", [("tail", "tail"), ("host", "host")])


@query("""WITH a AS (SELECT sha256(coalesce(text, '')) AS h, count(*) AS n FROM documents GROUP BY h), b AS (SELECT sha256(coalesce(text, '')) AS h, count(*) AS n FROM benchmark GROUP BY h)
SELECT CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' ELSE (CASE WHEN a.n = 1 THEN '1' ELSE 'n' END) || ':' || (CASE WHEN b.n = 1 THEN '1' ELSE 'n' END) END AS relation,
  count(*)::BIGINT AS n_hashes FROM a FULL JOIN b USING (h) GROUP BY relation""")
def content_hash_join_classes(spark, d):
    return joins.content_classes(table(spark, d, "documents").select("text"), table(spark, d, "benchmark").select("text"))


@query("""SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % least(5, greatest(2, count(*) OVER (PARTITION BY lang) // 3)))::BIGINT AS fold FROM documents""")
def roundrobin_folds(spark, d):
    return rows.round_robin(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id").select("doc_id", "fold")


@query(f"""WITH {DOC_FEATURES}, x AS (SELECT lang, doc_id, n_words AS a, n_sentences AS b FROM f),
r AS (SELECT lang, greatest(1, ceil(0.1::DECIMAL(10,4) * count(*) OVER (PARTITION BY lang))) AS k, row_number() OVER (PARTITION BY lang ORDER BY a DESC, doc_id) AS ra, row_number() OVER (PARTITION BY lang ORDER BY b DESC, doc_id) AS rb FROM x)
SELECT lang, count(*) FILTER (ra <= k)::BIGINT AS n_top, count(*) FILTER (ra <= k AND rb <= k)::BIGINT AS n_both, round(count(*) FILTER (ra <= k AND rb <= k)::DOUBLE / count(*) FILTER (ra <= k OR rb <= k), 6) AS jaccard FROM r GROUP BY lang""")
def top10_jaccard(spark, d):
    x = _features(spark, d)
    return rounded(stats.top_share_jaccard(x, ["lang"], "doc_id", "n_words", "n_sentences"), "jaccard")


@query(f"""WITH {DOC_FEATURES}, k AS (SELECT sha256(coalesce(d.text, '')) AS k, f.role FROM f JOIN documents d USING (doc_id))
SELECT k, count(DISTINCT role)::BIGINT AS n_splits FROM k GROUP BY k HAVING count(DISTINCT role) > 1""")
def split_leakage(spark, d):
    x = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"), (split_remainder(F.col("doc_id").cast("string")) == 0).alias("role"))
    return summary.split_leaks(x, ["k"], "role")


EMAIL_SQL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+"


@query(f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '{EMAIL_SQL}', '[EMAIL]', 'g'), 'https?://[^\\s<>"]+', '[URL]', 'g')) AS redacted,
  (len(regexp_extract_all(coalesce(text, ''), '{EMAIL_SQL}')) + len(regexp_extract_all(regexp_replace(coalesce(text, ''), '{EMAIL_SQL}', ' ', 'g'), 'https?://[^\\s<>"]+')))::BIGINT AS n_redactions FROM documents""")
def redact_text(spark, d):
    t = F.coalesce("text", F.lit(""))
    return texts(spark, d).select("doc_id", F.sha2(text.redacted(t), 256).alias("redacted"), text.redactions(t).cast("long").alias("n_redactions"))


@query("""SELECT source, mode, n::BIGINT AS n, round(share, 6) AS share FROM (SELECT source, lang AS mode, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) AS share,
  row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1""")
def mode_language(spark, d):
    return rounded(stats.mode(table(spark, d, "documents"), ["source"], "lang"), "share")


@query("""SELECT count(*)::BIGINT AS rows_, count(DISTINCT k)::BIGINT AS n_prints FROM (SELECT concat_ws('|', coalesce(lang, '?'), coalesce(source, '?'), coalesce(n_chars::VARCHAR, '?')) AS k FROM documents)""")
def content_fingerprint(spark, d):
    x = table(spark, d, "documents").select(fingerprint("lang", "source", "n_chars").alias("k"))
    return x.agg(F.count("*").alias("rows_"), F.countDistinct("k").alias("n_prints"))


@query("""SELECT doc_id, lower(regexp_replace(lower(source), '[^a-z0-9]+', '', 'g')) AS folded, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 60) AS excerpt,
  CASE WHEN contains(lower(source), 'src1') THEN 'group1' WHEN contains(lower(source), 'src') THEN 'other' ELSE 'none' END AS family FROM documents""")
def text_functions(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", text.folded(F.col("source")).alias("folded"), text.excerpt(F.coalesce("text", F.lit("")), 60).alias("excerpt"),
                    text.classify(F.col("source"), [("src1", "group1"), ("src", "other")], "none").alias("family"))


@query("""WITH x AS (SELECT source, quality::DOUBLE AS q, toxic::DOUBLE AS t, doc_id % 5 AS fold FROM documents JOIN labels USING (doc_id)),
g AS (SELECT a.fold, a.q, (SELECT avg(q) FROM x b WHERE b.fold <> a.fold) AS p FROM x a)
SELECT fold::BIGINT AS fold, count(*)::BIGINT AS n, round(sqrt(avg((p - q) * (p - q))), 6) AS rmse, round(avg(p - q), 6) AS bias FROM g GROUP BY fold""")
def group_kfold_cv(spark, d):
    x = table(spark, d, "labels").select((F.col("doc_id") % 5).alias("fold"), F.col("quality").cast("double").alias("q"))
    sums = x.groupBy("fold").agg(F.sum("q").alias("s"), F.count("*").alias("n"))
    whole = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    p = sums.crossJoin(F.broadcast(whole)).select("fold", ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("p"))  # a row per fold
    e = x.join(F.broadcast(p), "fold").groupBy("fold").agg(F.count("*").alias("n"), *stats.errors(F.col("q"), F.col("p"))[:3:2])
    return rounded(e, "rmse", "bias")


POISSON = " + ".join(f"(u >= {int(s * (1 << 52))})::INT" for s in bootstrap.STEPS)


@query(f"""WITH {DOC_FEATURES}, x AS (SELECT lang, n_words, r, ('0x' || substr(sha256('b1|' || r::VARCHAR || '|' || doc_id::VARCHAR), 1, 13))::UBIGINT AS u FROM f, (SELECT unnest(range(0, 201)) AS r)),
pw AS (SELECT lang, r, n_words, CASE WHEN r = 0 THEN 1 ELSE {POISSON} END AS w FROM x),
m AS (SELECT lang, r, sum(w * n_words)::DOUBLE / nullif(sum(w), 0) AS m FROM pw GROUP BY lang, r)
SELECT lang, round(max(m) FILTER (r = 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (r > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (r > 0), 6) AS high FROM m GROUP BY lang""")
def bootstrap_ci_poisson(spark, d):
    return rounded(bootstrap.bootstrap_mean(_features(spark, d), "doc_id", "n_words", ["lang"], 200, "b1"), "mean", "low", "high")


@query(f"""WITH {DOC_FEATURES}, x AS (SELECT doc_id, source, CASE WHEN n_words > 400 THEN 'long' ELSE 'short' END AS stratum FROM f),
a AS (SELECT *, CASE stratum WHEN 'long' THEN 20 ELSE 10 END AS q, row_number() OVER (PARTITION BY stratum, source ORDER BY sha256('s1|' || stratum || '|' || source || '|' || doc_id::VARCHAR), doc_id) AS r FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY r, source, doc_id) AS pick FROM a WHERE r <= ceil(0.2 * q))
SELECT doc_id, stratum, source, pick::INTEGER AS pick FROM b WHERE pick <= q""")
def stratified_quota(spark, d):
    x = _features(spark, d).withColumn("stratum", F.when(F.col("n_words") > 400, "long").otherwise("short"))
    return rows.stratified_quota(x, "doc_id", "stratum", "source", {"long": 20, "short": 10}, "s1").select("doc_id", "stratum", "source", "pick")
