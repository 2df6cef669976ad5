"""Queries of audits, decompositions and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import derived_seed
from ..operators import allocation, audits, evaluation, joins, quality, summary
from .base import query, r6, rounded, table


@query("""WITH x AS (SELECT l_returnflag AS g, l_extendedprice / (l_quantity * p_retailprice) AS r FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity * p_retailprice > 0)
SELECT g, count(r)::BIGINT AS n, round(quantile_cont(r, 0.5), 6) AS median, round(min(r), 6) AS low, round(max(r), 6) AS high, count(*) FILTER (abs(r - 1) <= 0.05)::BIGINT AS n_close FROM x GROUP BY g""")
def reported_against_derived(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_returnflag", "g")
    return rounded(audits.reported_against_derived(x, ["g"], "l_extendedprice", F.col("l_quantity") * F.col("p_retailprice"), 0.05), "median", "low", "high")


@query("""SELECT 'o_orderdate' AS field, count(o_orderdate)::BIGINT AS n_valid, count(*) FILTER (o_orderdate IS NULL)::BIGINT AS n_missing, count(*) FILTER (o_orderdate::DATE > DATE '1997-01-01')::BIGINT AS n_future,
  count(DISTINCT o_orderdate::DATE)::BIGINT AS n_distinct, min(o_orderdate::DATE) AS earliest, max(o_orderdate::DATE) AS latest FROM orders""")
def date_field_audit(spark, d):
    return audits.date_fields(table(spark, d, "orders"), ["o_orderdate"], "1997-01-01")


@query("""WITH x AS (SELECT o_custkey, CASE WHEN o_orderpriority IS NULL THEN 'missing' WHEN contains(lower(o_orderpriority), 'urgent') THEN 'fast' WHEN contains(lower(o_orderpriority), 'high') THEN 'fast' WHEN contains(lower(o_orderpriority), 'low') THEN 'slow' ELSE 'other' END AS kind,
  substr(sha256(coalesce(lower(trim(o_orderpriority)), '')), 1, 12) AS definition_id FROM orders)
SELECT definition_id, kind, count(*)::BIGINT AS n_rows, count(DISTINCT o_custkey)::BIGINT AS n_entities, kind IN ('fast', 'slow') AS is_eligible FROM x GROUP BY definition_id, kind""")
def definition_catalogue(spark, d):
    rules = [("urgent", "fast"), ("high", "fast"), ("low", "slow")]
    return audits.definitions(table(spark, d, "orders"), "o_orderpriority", "o_custkey", rules, ["fast", "slow"])


@query("""WITH x AS (SELECT source, (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS h FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*)::BIGINT AS n_rows, count(*) FILTER (h = 2)::BIGINT AS n_complete, count(*) FILTER (h = 1)::BIGINT AS n_partial, count(*) FILTER (h = 0)::BIGINT AS n_empty, sum(h)::BIGINT AS valid_slots, sum(2 - h)::BIGINT AS missing_slots FROM x GROUP BY source""")
def coverage_ledger(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return audits.coverage(x, ["source"], ["quality", "toxic"])


@query("""SELECT c_custkey, 'orders' AS analysis, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'used' ELSE 'unused' END AS role FROM customer
UNION ALL SELECT c_custkey, 'large', CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'used' ELSE 'unused' END FROM customer""")
def identity_usage(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return audits.usage(table(spark, d, "customer"), "c_custkey", {"orders": o, "large": o.where("o_totalprice > 200000")})


@query("""WITH d AS (SELECT 0.33998 * (1 + (n_nationkey - 12) / 500.0::DOUBLE) AS alpha, 0.27988 * (1 + (n_regionkey - 2) / 100.0::DOUBLE) AS beta FROM nation),
n AS (SELECT least(greatest(pow(alpha * 0.35398 / (beta * 1.24031), 1 / (alpha + beta)) * pow(1e20 / (1e18 * (6 + 0.0002 * 2048)), beta / (alpha + beta)), 0.070542), 11.965825) AS n FROM d)
SELECT count(*)::BIGINT AS draws, round(quantile_cont(n, 0.025), 6) AS p2_5, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.975), 6) AS p97_5, round(avg((n <= 0.070542 OR n >= 11.965825)::INT)::DOUBLE, 6) AS at_bound FROM n""")
def draw_propagation(spark, d):
    law = allocation.LAW
    x = table(spark, d, "nation").select(
        (law["alpha"] * (1 + (F.col("n_nationkey") - 12) / 500.0)).alias("alpha"), (law["beta"] * (1 + (F.col("n_regionkey") - 2) / 100.0)).alias("beta"),
        F.lit(law["a"]).alias("a"), F.lit(law["b"]).alias("b"))
    return rounded(audits.propagated(x, 1e20, 2048.0), "p2_5", "p50", "p97_5", "at_bound")


@query("""WITH x AS (SELECT s_suppkey, 0.7 * ln(1 + abs(s_acctbal)) AS c, -0.2 * s_nationkey AS t FROM supplier)
SELECT s_suppkey, round(c, 6) AS from_compute, round(t::DOUBLE, 6) AS from_time, round(abs(c) / (abs(c) + abs(t)), 6) AS share_compute, round(abs(t) / (abs(c) + abs(t)), 6) AS share_time FROM x""")
def contribution_split(spark, d):
    parts = evaluation.contribution(F.lit(0.7), F.log1p(F.abs("s_acctbal")), F.lit(-0.2), F.col("s_nationkey").cast("double"))
    return rounded(table(spark, d, "supplier").select("s_suppkey", *parts), "from_compute", "from_time", "share_compute", "share_time")


@query("""WITH f AS (SELECT DISTINCT l_tax AS s, cume_dist() OVER (ORDER BY l_tax) AS f FROM lineitem), e AS (SELECT min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem),
p AS (SELECT DISTINCT l_discount - 0.02 AS v FROM lineitem), x AS (SELECT v, lo, hi, CASE WHEN v < lo THEN 0 ELSE (SELECT max(f) FROM f WHERE s <= v) END AS f FROM p, e)
SELECT v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8][least(greatest(ceil(round(8 * f, 9)), 1), 8)::INT]::DOUBLE AS level,
  CASE WHEN v < lo THEN 'OUT_OF_SUPPORT_LOW' WHEN v > hi THEN 'OUT_OF_SUPPORT_HIGH' ELSE 'IN_SUPPORT' END AS status, v BETWEEN lo AND hi AS usable FROM x""")
def quantile_bridge(spark, d):
    l = table(spark, d, "lineitem")
    points = l.select((F.col("l_discount") - 0.02).alias("v")).distinct()
    return allocation.quantile_bridge(points, "v", l, "l_tax", [i / 10 for i in range(1, 9)]).select("v", "level", "status", "usable")


@query("""SELECT doc_id, substr(sha256('20260924|' || source || '|' || (doc_id % 3)::VARCHAR), 1, 16) AS seed FROM documents""")
def derived_seeds(spark, d):
    return table(spark, d, "documents").select("doc_id", derived_seed("20260924", F.col("source"), (F.col("doc_id") % 3).cast("string")).alias("seed"))


@query("""SELECT o_orderpriority, CASE WHEN count(*) FILTER (g >= 0.05 AND q >= 0.05) >= 2 AND min(least(g, q)) >= -0.1 THEN 'UPGRADE' ELSE 'KEEP' END AS decision
FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) / 140000 - 1 AS g, quantile_cont(o_totalprice, 0.9) / 250000 - 1 AS q FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def upgrade_gate(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("protocol")).agg(
        (F.avg("o_totalprice") / 140000 - 1).alias("mean_gain"), (F.percentile("o_totalprice", F.lit(0.9)) / 250000 - 1).alias("q90_gain"), F.lit(1.0).alias("sign_share"))
    return evaluation.upgrade_gate(g, ["o_orderpriority"])


@query("""SELECT scope, CASE WHEN grouping(l) = 1 THEN 'ALL' ELSE l END AS lang, count(*)::BIGINT AS n, round(avg(n_chars), 4) AS mean_chars FROM (
  SELECT 'all' AS scope, lang AS l, n_chars FROM documents UNION ALL SELECT 'labelled', lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'long', lang, n_chars FROM documents WHERE n_chars > 1000) GROUP BY GROUPING SETS ((scope, l), (scope))""")
def scope_summary(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    s = summary.scoped(x, {"all": F.lit(True), "labelled": F.col("has"), "long": F.col("n_chars") > 1000})
    return summary.with_all(s, ["scope"], "lang", [F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars")])


@query("""SELECT a.r_name AS name, b.n FROM region a LEFT JOIN (SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY n_regionkey) b ON a.r_regionkey = b.n_regionkey""")
def dimension_counts(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return joins.guarded(table(spark, d, "region"), n, ["r_regionkey"], "left", "one_to_one").select(F.col("r_name").alias("name"), "n")


@query("""SELECT c_custkey, round(c_acctbal, 6) AS value FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def complete_cases(spark, d):
    return table(spark, d, "customer").na.drop(subset=["c_acctbal", "c_mktsegment"]).select("c_custkey", r6("c_acctbal").alias("value"))
