"""Queries of model comparison, validation, allocation and stability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lists, numeric
from ..functions.hashing import role
from ..operators import allocation, bootstrap, evaluation, fit, joins, ordering, quality, rows, stats, summary
from ..operators.bootstrap import STEPS
from ..operators.store import written
from .base import DOC_FEATURES, query, r6, rounded, scored_sql, table, texts

POISSON = " + ".join(f"(u >= {int(s * (1 << 52))})::INT" for s in STEPS)


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / max(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS share, max(l_extendedprice) OVER (PARTITION BY l_returnflag) AS top FROM lineitem""")
def group_transform(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    x = rows.with_group(x, ["l_returnflag"], [F.max("l_quantity").alias("m"), F.max("l_extendedprice").alias("top")])
    return x.select("l_orderkey", "l_linenumber", r6(F.col("l_quantity") / F.col("m")).alias("share"), "top")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.8) AS q FROM events GROUP BY event_type) SELECT event_id, value > q AS is_high FROM events JOIN q USING (event_type)""")
def group_quantile_transform(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    x = ordering.null_safe_left(e, F.broadcast(ordering.quantiles(e, ["event_type"], "value", {"q": 0.8})), ["event_type"])  # a row per type
    return x.select("event_id", (F.col("value") > F.col("q")).alias("is_high"))


@query("""WITH c AS (SELECT list_sort(list(DISTINCT o_orderdate::DATE)) AS ds FROM orders) SELECT o_orderkey, ds[floor(0.8 * (len(ds) - 1))::INT + 1] AS cut_date, o_orderdate::DATE >= ds[floor(0.8 * (len(ds) - 1))::INT + 1] AS is_late FROM orders, c""")
def distinct_date_cut(spark, d):
    return rows.late_dates(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "cut_date", "is_late")


@query("""WITH x AS (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dd FROM events)
SELECT event_type, count(*) FILTER (dd > 0)::BIGINT AS n_up, count(*) FILTER (dd < 0)::BIGINT AS n_down, count(*) FILTER (dd = 0)::BIGINT AS n_same FROM x GROUP BY event_type""")
def sign_counts(spark, d):
    return stats.sign_changes(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0.05 THEN l_extendedprice WHEN l_tax > 0 THEN 6.0 * l_quantity * l_tax END, 6) AS compute,
  CASE WHEN l_discount > 0.05 AND l_extendedprice > 0 THEN 'REPORTED' WHEN l_tax > 0 AND l_quantity > 0 THEN 'CONSTRUCTED_6ND' ELSE 'MISSING' END AS origin FROM lineitem""")
def compute_origin(spark, d):
    direct = F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))
    value, origin = numeric.compute_of(direct, F.col("l_quantity").cast("double"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(value).alias("compute"), origin.alias("origin"))


GATES = {
    "labelled": "quality IS NOT NULL", "good": "quality = 1", "not_toxic": "toxic = 0", "english": "lang = 'en'", "has_source": "source IS NOT NULL", "long": "n_chars >= 200",
    "short": "n_chars <= 20000", "has_text": "text IS NOT NULL", "not_blank": "length(trim(text)) > 0", "no_link": "NOT contains(text, 'http')", "known_id": "doc_id >= 0",
}


@query(f"""WITH g AS (SELECT doc_id, lang, [{', '.join(f"CASE WHEN coalesce({v}, FALSE) THEN NULL ELSE '{k}' END" for k, v in GATES.items())}] AS f FROM documents LEFT JOIN labels USING (doc_id)),
x AS (SELECT doc_id, lang, list_filter(f, lambda v: v IS NOT NULL) AS f FROM g)
SELECT doc_id, len(f) = 0 AS eligible, len(list_filter(f, lambda v: v <> 'english')) = 0 AND coalesce(lang <> 'en', FALSE) AS side_eligible, len(f)::BIGINT AS n_failed, f[1] AS first_failed FROM x""")
def eligibility_gate(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return summary.eligibility(x, {k: F.expr(v) for k, v in GATES.items()}, {"english": F.col("lang") != "en"}, ["doc_id"])


@query("""SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_custkey, c_name, c_acctbal FROM customer""")
def positional_join(spark, d):
    c = table(spark, d, "customer")
    return joins.positional(c.select("c_custkey", "c_name"), c.select("c_custkey", "c_acctbal"), "c_custkey", ["c_custkey"])


@query("""WITH x AS (SELECT event_type, event_id % 4 AS k FROM events)
SELECT event_type, 'list' AS field, count(*)::BIGINT AS n_records, sum(k)::BIGINT AS n_elements, (6 * count(*))::BIGINT AS n_seen, count(*)::BIGINT AS n_reasons, 'nan' AS reasons FROM x WHERE k > 0 GROUP BY event_type
UNION ALL SELECT event_type, 'scalar', count(*)::BIGINT, count(*)::BIGINT, count(*)::BIGINT, (2 * count(*))::BIGINT, 'null|type' FROM x WHERE k = 3 GROUP BY event_type""")
def anomaly_readback(spark, d):
    k = F.col("event_id") % 4
    one = F.format_string('"list":{"reasons":["nan"],"nan":%d,"elements":6}', k)
    two = F.lit(',"scalar":{"reasons":["type","null"],"null":1,"elements":1}')
    blob = F.concat(F.lit("{"), F.when(k > 0, one).otherwise(""), F.when(k == 3, two).otherwise(""), F.lit("}"))
    return summary.anomalies(table(spark, d, "events").select("event_type", blob.alias("j")), ["event_type"], "j")


@query("""WITH q AS (SELECT DISTINCT l_discount * 10 AS q FROM lineitem), m AS (
  SELECT q, 'identity' AS kind, q AS b, q BETWEEN 0.15 AND 0.95 AS ina FROM q UNION ALL SELECT q, 'affine', 0.6 + 0.5 * (q - 0.5), q BETWEEN 0.15 AND 0.95 FROM q
  UNION ALL SELECT q, 'step', CASE WHEN q < 0.15 THEN 0.1 WHEN q > 0.95 THEN 1.0 WHEN q >= 0.7 THEN 0.7 WHEN q >= 0.4 THEN 0.3 ELSE 0.2 END::DOUBLE, q BETWEEN 0.15 AND 0.95 FROM q)
SELECT q, kind, round(b, 6) AS mapped, CASE WHEN ina AND b BETWEEN 0.1 AND 0.6 THEN 'IN_SUPPORT' WHEN kind = 'step' AND q < 0.15 THEN 'OUT_OF_SUPPORT_LOW' WHEN kind = 'step' AND q > 0.95 THEN 'OUT_OF_SUPPORT_HIGH'
  WHEN b < 0.1 THEN 'OUT_OF_SUPPORT_LOW' ELSE 'OUT_OF_SUPPORT_HIGH' END AS status, ina AND b BETWEEN 0.1 AND 0.6 AS usable,
  round(-0.5 * 0.8 * 0.2 * (b - 0.6), 6) + 0.0 AS added, round(exp(0.5 * 0.8 * 0.2 * (b - 0.6)), 6) AS factor FROM m""")
def scenario_maps(spark, d):
    q = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("q")).distinct()
    out = None
    for kind in ("identity", "affine", "step"):
        b, status, usable = numeric.quality_map(F.col("q"), kind, 0.5, 0.5, 0.15, 0.95, [(0.15, 0.2), (0.4, 0.3), (0.7, 0.7)])
        x = q.select("q", F.lit(kind).alias("kind"), b.alias("mapped"), status.alias("status"), usable.alias("usable"))
        added, factor = numeric.scenario_effect(F.col("mapped"), "additive", 0.5, 0.8, 0.2)[0], numeric.scenario_effect(F.col("mapped"), "tokens", 0.5, 0.8, 0.2)[1]
        x = x.select("q", "kind", r6("mapped").alias("mapped"), "status", "usable", (r6(added) + 0.0).alias("added"), r6(factor).alias("factor"))
        out = x if out is None else out.unionAll(x)
    return out


def _bias_sql():
    full = "count(*)::BIGINT AS n, round(avg(e), 4) AS mean_error, round(sqrt(avg(e * e)), 4) AS rmse, round(avg((e > 0)::INT), 6) AS positive_share, NULL::DOUBLE AS rho, CASE WHEN avg(e) > 0 THEN 'OVER' WHEN avg(e) < 0 THEN 'UNDER' ELSE 'NONE' END AS direction"
    return f"""WITH x AS (SELECT 1500 * l_quantity - l_extendedprice AS e, l_extendedprice AS v, l_suppkey::VARCHAR AS c FROM lineitem),
b AS (SELECT quantile_cont(v, 0.25) AS b1, quantile_cont(v, 0.5) AS b2, quantile_cont(v, 0.75) AS b3 FROM x),
r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re FROM x),
t AS (SELECT count(*) AS n, corr(rv, re) AS rho FROM r)
SELECT 'OVERALL' AS audit, 'all' AS stratum, {full} FROM x
UNION ALL SELECT 'TREND', 'all', n::BIGINT, NULL, NULL, NULL, round(rho, 6), CASE WHEN rho > 0.1 THEN 'RISES' WHEN rho < -0.1 THEN 'FALLS' ELSE 'WEAK' END FROM t WHERE n >= 5 AND rho IS NOT NULL
UNION ALL SELECT 'QUARTER', CASE WHEN v <= b1 THEN '1' WHEN v <= b2 THEN '2' WHEN v <= b3 THEN '3' ELSE '4' END AS q, {full} FROM x, b GROUP BY q
UNION ALL SELECT 'CLUSTER', c, {full} FROM x GROUP BY c HAVING count(*) >= 5"""


@query(_bias_sql())
def bias_audit(spark, d):
    x = table(spark, d, "lineitem").select((1500 * F.col("l_quantity") - F.col("l_extendedprice")).alias("e"), F.col("l_extendedprice").alias("v"), F.col("l_suppkey").alias("c"))
    x = evaluation.bias_audit(x, "e", "v", "c")
    return rounded(rounded(x, "mean_error", "rmse", digits=4), "positive_share", "rho")


FEATURE_SQL = {
    "value": "value::DOUBLE", "over_k": "CASE WHEN event_id % 7 = 0 THEN 'inf'::DOUBLE WHEN event_id % 7 = 1 THEN '-inf'::DOUBLE ELSE value END",
    "odd": "CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE WHEN event_id % 5 = 1 THEN NULL ELSE value END",
}


@query(" UNION ALL ".join(
    f"""SELECT user_id % 3 AS part, CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type, '{k}' AS feature, count(*)::BIGINT AS n_rows, count(*) FILTER (v IS NOT NULL AND isfinite(v))::BIGINT AS n_finite,
  count(*) FILTER (isnan(v))::BIGINT AS n_nan, count(*) FILTER (v = 'inf'::DOUBLE)::BIGINT AS n_posinf, count(*) FILTER (v = '-inf'::DOUBLE)::BIGINT AS n_neginf, round(count(*) FILTER (v IS NOT NULL AND isfinite(v))::DOUBLE / count(*), 6) AS coverage
  FROM (SELECT user_id, event_type, {sql} AS v FROM events) GROUP BY GROUPING SETS ((part, event_type), (part))""" for k, sql in FEATURE_SQL.items()))  # fmt: skip
def feature_coverage(spark, d):
    i, v = F.col("event_id"), F.col("value").cast("double")
    inf = lambda x: F.lit(float(x))
    features = {
        "value": v, "over_k": F.when(i % 7 == 0, inf("inf")).when(i % 7 == 1, inf("-inf")).otherwise(v),
        "odd": F.when(i % 5 == 0, inf("nan")).when(i % 5 == 1, F.lit(None)).otherwise(v),
    }
    x = table(spark, d, "events").withColumn("part", F.col("user_id") % 3)
    return rounded(quality.feature_coverage(x, ["part"], "event_type", features), "coverage")


def _spearman_sql(source, by, x, y):
    part = f"PARTITION BY {by}"
    return f"""(SELECT {by} AS k, count(*) AS n, corr(a, b) AS rho FROM (SELECT {by}, rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({part}, {x}) - 1) / 2.0 AS a,
      rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({part}, {y}) - 1) / 2.0 AS b FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by})"""


def _correlations_sql():
    parts = []
    rho = "round(CASE WHEN n > 2 AND NOT isnan(rho) THEN rho END, 6) + 0.0 AS rho"
    for f in ("n_words", "n_sentences"):
        parts.append(f"SELECT 'within' AS scope, k AS domain, '{f}' AS feature, n::BIGINT AS n, {rho} FROM {_spearman_sql('s9', 'lang', f, 'q')}")
        parts.append(f"SELECT 'between', 'means', '{f}', n::BIGINT, {rho} FROM {_spearman_sql('m', 'one', f, 'q')}")
        parts.append(f"SELECT 'pooled', 'pooled', '{f}', n::BIGINT, {rho} FROM {_spearman_sql('s9', 'one', f, 'q')}")
    return scored_sql() + """, s9 AS (SELECT lang, n_words, n_sentences, round(q, 9) AS q, 1 AS one FROM s),
m AS (SELECT 1 AS one, lang, round(avg(n_words), 9) AS n_words, round(avg(n_sentences), 9) AS n_sentences, round(avg(q), 9) AS q FROM s9 GROUP BY lang) """ + " UNION ALL ".join(parts)


def _scored(spark, d):
    x = written(quality.text_features(texts(spark, d)), "text-features")
    return quality.scored(x).withColumn("q", F.round("q", 9))


@query(_correlations_sql())
def indicator_correlations(spark, d):
    x = rounded(quality.indicator_correlations(_scored(spark, d), "lang", ["n_words", "n_sentences"]), "rho")
    return x.withColumn("rho", F.col("rho") + 0.0)


@query("""WITH b AS (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer WHERE c_nationkey < 20 GROUP BY k), e AS (SELECT c_nationkey AS k, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal ELSE max(c_acctbal) OVER (PARTITION BY c_nationkey) END AS v FROM customer),
x AS (SELECT e.v AS ev, b.v AS bv, b.k IS NOT NULL AS has FROM e LEFT JOIN b USING (k))
SELECT count(*)::BIGINT AS n_extension, count(*) FILTER (has)::BIGINT AS n_present, count(*) FILTER (has AND abs(ev - bv) <= 1e-12)::BIGINT AS n_reproduced, count(*) FILTER (has AND abs(ev - bv) > 1e-12)::BIGINT AS n_violations,
  round(max(abs(ev - bv)) FILTER (has), 6) AS max_gap, CASE WHEN count(*) FILTER (has) = 0 THEN 'NO_OVERLAP' WHEN count(*) FILTER (has AND abs(ev - bv) > 1e-12) = 0 THEN 'REPRODUCED' ELSE 'VIOLATED' END AS status FROM x""")
def overlap_reproduction(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_acctbal")
    base = c.where("k < 20").groupBy("k").agg(F.max("c_acctbal").alias("v"))
    x = rows.with_group(c, ["k"], [F.max("c_acctbal").alias("m")])
    x = x.select("k", F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal")).otherwise(F.col("m")).alias("v"))
    return rounded(quality.overlap_reproduction(base, x, ["k"], "v"), "max_gap")


REPS = 8


def _stability_sql():
    return scored_sql() + f""", x AS (SELECT lang, doc_id, q, n_words::DOUBLE AS a, n_sentences::DOUBLE AS b FROM s WHERE q IS NOT NULL),
d AS (SELECT *, ('0x' || substr(sha256('st|' || r::VARCHAR || '|' || doc_id::VARCHAR), 1, 13))::UBIGINT AS u FROM x, (SELECT unnest(range(0, {REPS + 1})) AS r)),
pw AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE {POISSON} END AS w FROM d),
t AS (SELECT lang, r, quantile_cont(a, 0.95) AS a0, quantile_cont(a, 0.99) AS b0, quantile_cont(b, 0.95) AS a1, quantile_cont(b, 0.99) AS b1 FROM (SELECT lang, r, a, b, unnest(range(0, w)) FROM pw) GROUP BY lang, r),
p AS (SELECT d.lang, d.r, doc_id, q, b0 > a0 AND b1 > a1 AS ok, (CASE WHEN a <= a0 THEN 0.0 WHEN a >= greatest(b0, CASE WHEN b0 > a0 THEN b0 ELSE a0 + 1 END) THEN 1.0 ELSE (a - a0) / ((CASE WHEN b0 > a0 THEN b0 ELSE a0 + 1 END) - a0) END
  + CASE WHEN b <= a1 THEN 0.0 WHEN b >= (CASE WHEN b1 > a1 THEN b1 ELSE a1 + 1 END) THEN 1.0 ELSE (b - a1) / ((CASE WHEN b1 > a1 THEN b1 ELSE a1 + 1 END) - a1) END) / 2 AS p FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang AND d.r = t.r),
y AS (SELECT p.*, z.p AS p0, round(p.q * (1 - 0.02 * z.p), 9) AS s0, round(p.q * (1 - 0.02 * p.p), 9) AS s1 FROM p JOIN p z ON z.r = 0 AND z.doc_id = p.doc_id WHERE p.r > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, r ORDER BY s0 DESC, doc_id) AS ra, row_number() OVER (PARTITION BY lang, r ORDER BY s1 DESC, doc_id) AS rb,
  greatest(1, ceil(0.1::DECIMAL(10,4) * count(*) OVER (PARTITION BY lang, r))) AS top FROM y)
SELECT lang, r::INTEGER AS replicate, count(*)::BIGINT AS n, round(CASE WHEN bool_and(ok) THEN avg(abs(p - p0)) END, 6) AS mae,
  round(CASE WHEN bool_and(ok) AND count(*) > 1 THEN 1 - 6 * sum((ra - rb) * (ra - rb))::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END, 6) AS rho,
  round(CASE WHEN bool_and(ok) THEN count(*) FILTER (ra <= top AND rb <= top)::DOUBLE / count(*) FILTER (ra <= top OR rb <= top) END, 6) AS jaccard FROM k GROUP BY lang, r"""


def _replicates(spark, d):
    x = quality.scored(written(quality.text_features(texts(spark, d)), "text-features"))
    return quality.stability_bootstrap(x, ("n_words", "n_sentences"), "lang", "doc_id", REPS, "st")


@query(_stability_sql())
def stability_bootstrap(spark, d):
    return rounded(_replicates(spark, d), "mae", "rho", "jaccard")


@query(f"""WITH m AS ({_stability_sql()}), g AS (SELECT lang, count(*) AS n, count(*) FILTER (mae <= 0.05 AND rho >= 0.95 AND jaccard >= 0.8) AS j, quantile_cont(mae, 0.5) AS mae, quantile_cont(rho, 0.5) AS rho, quantile_cont(jaccard, 0.5) AS jaccard FROM m GROUP BY lang)
SELECT lang, n::BIGINT AS n_replicates, j::BIGINT AS n_joint, CASE WHEN j >= ceil(0.95 * n) THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN rho >= 0.95 AND jaccard >= 0.8 AND mae <= 0.05 THEN 'STABLE' WHEN rho >= 0.8 AND jaccard >= 0.5 THEN 'PARTIALLY_STABLE' ELSE 'NOT_STABLE' END AS label FROM g""")
def stability_decision(spark, d):
    x = rounded(_replicates(spark, d), "mae", "rho", "jaccard")
    return quality.stability_summary(x, "lang").drop("mae", "rho", "jaccard")


@query("""WITH x AS (SELECT l_returnflag AS stratum, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem UNION ALL SELECT 'ALL', l_quantity, l_extendedprice / 1000 FROM lineitem),
s AS (SELECT stratum, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, corr(x, y) AS r FROM x GROUP BY stratum),
e AS (SELECT stratum, y, my, n, (y - a - b * x) / (1 - (1 / n::DOUBLE + pow(x - mx, 2) / sxx)) AS e, (y - my) * n / (n - 1) AS m FROM x JOIN s USING (stratum)),
l AS (SELECT stratum, sqrt(avg(e * e)) AS rm, avg(abs(e)) AS ma, 1 - sum(e * e) / sum(pow(y - my, 2)) AS r2, sqrt(avg(m * m)) AS mr, count(*) FILTER (y - e < 0 OR y - e > 100) AS o FROM e GROUP BY stratum),
k AS (SELECT stratum, corr(p, q) AS rho FROM (SELECT stratum, rank() OVER (PARTITION BY stratum ORDER BY x) + (count(*) OVER (PARTITION BY stratum, x) - 1) / 2.0 AS p, rank() OVER (PARTITION BY stratum ORDER BY y) + (count(*) OVER (PARTITION BY stratum, y) - 1) / 2.0 AS q FROM x) GROUP BY stratum)
SELECT stratum, n::BIGINT AS n, round(r, 6) AS pearson, round(rho, 6) AS spearman, round(b, 6) AS slope, round(a, 5) AS intercept, round(rm, 5) AS loo_rmse, round(ma, 5) AS loo_mae, round(r2, 6) AS loo_r2, round(mr, 5) AS mean_rmse, o::BIGINT AS n_outside FROM s JOIN l USING (stratum) JOIN k USING (stratum)""")
def loss_benchmark_bridge(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    x = rounded(evaluation.bridge(x, "l_returnflag", "l_quantity", "y"), "pearson", "spearman", "slope", "loo_r2")
    return rounded(x, "intercept", "loo_rmse", "loo_mae", "mean_rmse", digits=5)


@query("""WITH x AS (SELECT l_returnflag AS scale, l_orderkey AS r, l_linenumber AS d, l_extendedprice AS y, 1500 * l_quantity AS p, avg(l_extendedprice) OVER (PARTITION BY l_linenumber) AS b FROM lineitem),
per AS (SELECT scale, d, avg((p - y) * (p - y)) AS mse, avg((b - y) * (b - y)) AS base, var_pop(y) AS v, avg(abs(p - y)) AS mae, count(*) AS n FROM x GROUP BY scale, d),
a AS (SELECT scale, sqrt(sum(mse * n) / sum(n)) AS rmse_all, sum(mae * n) / sum(n) AS mae_all, avg(CASE WHEN v > 0 THEN 1 - mse / v END) AS r2, avg(mse) AS mse, avg(base) AS base FROM per GROUP BY scale),
m AS (SELECT scale, r, avg(y) AS a, avg(p) AS p FROM x GROUP BY scale, r), c AS (SELECT scale, count(*) AS n, sqrt(avg((p - a) * (p - a))) AS rm, avg(abs(p - a)) AS mm FROM m GROUP BY scale)
SELECT scale, n::BIGINT AS n, round(rmse_all, 3) AS rmse_all, round(mae_all, 3) AS mae_all, round(r2, 5) AS r2_domains, round(rm, 3) AS rmse_mean, round(mm, 3) AS mae_mean, round(1 - mse / base, 5) AS gain FROM a JOIN c USING (scale)""")
def transport_audit(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("scale"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("k"), F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p"))
    x = rows.with_group(x, ["k"], [F.avg("y").alias("b")])
    x = evaluation.transport(x, "scale", "r", "k", "y", "p", "b")
    x = rounded(x.select("scale", "n", "rmse_all", "mae_all", "r2_domains", "rmse_mean", "mae_mean", "gain"), "rmse_all", "mae_all", "rmse_mean", "mae_mean", digits=3)
    return rounded(x, "r2_domains", "gain", digits=5)


def _hash(columns):
    return f"bit_xor(('0x' || substr(sha256({columns}), 1, 15))::BIGINT)"


KEYS = "l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR"


@query(f"""WITH w AS (SELECT count(*) AS n, {_hash(KEYS)} AS k FROM lineitem),
f AS (SELECT 'leave_line' AS split, l_linenumber::VARCHAR AS heldout, count(*) AS t, {_hash(KEYS)} AS h FROM lineitem GROUP BY heldout UNION ALL SELECT 'leave_flag', l_returnflag, count(*), {_hash(KEYS)} FROM lineitem GROUP BY l_returnflag)
SELECT split, heldout, (n - t)::BIGINT AS n_train, t::BIGINT AS n_test, xor(k, h) AS train_keys, h AS test_keys FROM f, w""")
def fold_key_audit(spark, d):
    l, key = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    return rows.leave_out_folds(l, "leave_line", "l_linenumber", key).unionAll(rows.leave_out_folds(l, "leave_flag", "l_returnflag", key))


FOLDS_SQL = """x AS (SELECT 'line' AS split, l_linenumber::VARCHAR AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'month', strftime(l_shipdate, '%m'), l_quantity, l_extendedprice FROM lineitem),
t AS (SELECT split, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM x GROUP BY split),
o AS (SELECT split, f, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM x GROUP BY split, f),
c AS (SELECT split, f, (t.sy - o.sy) / (t.n - o.n) AS m, t.n - o.n AS n, t.sx - o.sx AS sx, t.sy - o.sy AS sy, t.sxx - o.sxx AS sxx, t.sxy - o.sxy AS sxy FROM o JOIN t USING (split)),
p AS (SELECT split, f, m, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS a FROM c),
e AS (SELECT split, f, sqrt(avg((y - m) * (y - m))) AS null_rmse, sqrt(avg((y - a - b * x) * (y - a - b * x))) AS rmse, -any_value(b) AS slope FROM x JOIN p USING (split, f) GROUP BY split, f)"""


def _folds(spark, d):
    """Per split and fold: errors of the mean and of a line, each fitted on the other folds, by sums."""
    l = table(spark, d, "lineitem")
    x, y = F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("y")
    month = F.date_format("l_shipdate", "MM")
    splits = F.explode(F.array(F.struct(F.lit("line").alias("split"), F.col("l_linenumber").cast("string").alias("f")), F.struct(F.lit("month").alias("split"), month.alias("f")))).alias("_s")
    x = l.select(x, y, splits).select("_s.split", "_s.f", "x", "y")
    sums = [F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy")]
    own = x.groupBy("split", "f").agg(*sums)
    whole = own.groupBy("split").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    c = own.join(whole, "split").select("split", "f", *[(F.col(f"t_{k}") - F.col(k)).alias(k) for k in ("n", "sx", "sy", "sxx", "sxy")])
    b = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    c = c.select("split", "f", (F.col("sy") / F.col("n")).alias("m"), b.alias("b"), (F.col("sy") / F.col("n") - b * F.col("sx") / F.col("n")).alias("a"))
    e = x.join(F.broadcast(c), ["split", "f"])  # a row per fold
    root = lambda z: F.sqrt(F.avg(z * z))
    return e.groupBy("split", "f").agg(root(F.col("y") - F.col("m")).alias("null_rmse"), root(F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("rmse"), (-F.first("b")).alias("slope"))


@query(f"""WITH {FOLDS_SQL}, g AS (SELECT split, count(*) AS n, avg(null_rmse) AS mn, avg(rmse) AS mc, count(*) FILTER (rmse <= 1.10 * null_rmse) AS nr, count(*) FILTER (slope < 0) AS nn FROM e GROUP BY split)
SELECT split, n::BIGINT AS n_folds, round(mn, 2) AS macro_null, round(mc, 2) AS macro_candidate, nr::BIGINT AS n_ratio, nn::BIGINT AS n_negative, round(1 - mc / mn, 6) AS gain,
  CASE WHEN 1 - mc / mn >= 0.05 AND nr >= ceil(0.8 * n) AND nn >= ceil(0.8 * n) THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def fit_gates(spark, d):
    g = evaluation.fit_gates(_folds(spark, d), "split", "null_rmse", "rmse", "slope")
    return rounded(rounded(g, "macro_null", "macro_candidate", digits=2), "gain")


@query("""WITH s AS (SELECT l_returnflag AS g, l_linenumber::VARCHAR AS c, avg(l_discount) AS v FROM lineitem GROUP BY ALL), b AS (SELECT g, min(v) AS best FROM s GROUP BY g),
n AS (SELECT g, c, best, coalesce(list_position(['5', '2', '7'], c), 4) AS r FROM s JOIN b USING (g) WHERE v <= 1.01 * best)
SELECT g, arg_min(c, (r, c)) AS chosen, round(min(best), 6) AS best, count(*)::BIGINT AS n_near FROM n GROUP BY g""")
def near_tie_selection(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").cast("string").alias("c")).agg(F.avg("l_discount").alias("v"))
    return rounded(evaluation.near_tie(s, ["g"], "c", "v", ["5", "2", "7"]), "best")


def _cells(spark, d):
    x = table(spark, d, "lineitem").groupBy((F.floor(F.col("l_quantity") / 5) + 1).alias("n"), (F.floor(F.col("l_discount") * 100) + 1).alias("t")).agg(F.count("*").alias("c"))
    law = allocation.LAW
    y = numeric.power_law(F.col("n").cast("double"), F.col("t").cast("double"), law["e"], law["a"], law["alpha"], law["b"], law["beta"])
    return x.withColumn("y", y * (1 + 0.001 * F.sin(F.col("c").cast("double"))))


@query()
def configuration_comparison(spark, d):
    x = fit.compare_configurations(_cells(spark, d), "n", "t", "y")
    return rounded(x, "fit_rmse", "loo_rmse", "late_rmse", "score")


LINEAR_SQL = """WITH x AS (SELECT l_extendedprice / 1000 AS y, ln(l_quantity) AS z, l_discount AS w FROM lineitem),
s AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(z) AS mz, avg(w) AS mw, var_pop(z) * count(*) AS zz, var_pop(w) * count(*) AS ww, covar_pop(z, w) * count(*) AS zw, covar_pop(z, y) * count(*) AS zy, covar_pop(w, y) * count(*) AS wy FROM x),
c AS (SELECT *, zy / zz AS b1, (zy * ww - wy * zw) / (zz * ww - zw * zw) AS c1, (wy * zz - zy * zw) / (zz * ww - zw * zw) AS c2 FROM s),
e AS (SELECT n, y - my AS e0, 1 / n AS h0, y - my - b1 * (z - mz) AS e1, 1 / n + (z - mz) * (z - mz) / zz AS h1,
  y - my - c1 * (z - mz) - c2 * (w - mw) AS e2, 1 / n + ((z - mz) * (z - mz) * ww - 2 * (z - mz) * (w - mw) * zw + (w - mw) * (w - mw) * zz) / (zz * ww - zw * zw) AS h2 FROM x, c),
l AS (SELECT 'CONSTANT' AS candidate, n, e0 AS e, e0 / (1 - h0) AS o FROM e UNION ALL SELECT 'SIZE_LOG_LINEAR', n, e1, e1 / (1 - h1) FROM e UNION ALL SELECT 'LOSS_SIZE_LINEAR', n, e2, e2 / (1 - h2) FROM e)
SELECT candidate, count(*)::BIGINT AS n_fit, round(sqrt(avg(e * e)), 5) AS rmse, round(sqrt(avg(o * o)), 5) AS loo_rmse,
  round(list_sort(list(abs(o)))[(ceil(round(least(1.0, ceil((count(*) + 1) * 0.95) / count(*)) * (count(*) - 1), 9)) + 1)::BIGINT], 5) AS half_width FROM l GROUP BY candidate"""


def _ladder_rows(spark, d):
    l = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    return l.join(o, "l_orderkey").select(
        (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("loss"), F.ln("l_quantity").alias("logN"), F.ln(F.col("l_suppkey") + 1.0).alias("logD"),
        (F.col("year") - 1995).cast("double").alias("time"), F.col("l_returnflag").alias("family"))


@query(LINEAR_SQL)
def candidate_ladder_linear(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.ln("l_quantity").alias("logN"), F.col("l_discount").alias("loss"))
    x = fit.ladder(x, "y", {"CONSTANT": [], "SIZE_LOG_LINEAR": ["logN"], "LOSS_SIZE_LINEAR": ["loss", "logN"]})
    return rounded(x.select("candidate", "n_fit", "rmse", "loo_rmse", "half_width"), "rmse", "loo_rmse", "half_width", digits=5)


@query()
def candidate_ladder(spark, d):
    x = fit.candidate_ladder(_ladder_rows(spark, d), "y", "loss", "logN", "logD", "time", "family", ["A", "N", "R"])
    return rounded(x, "rmse", "loo_rmse", "half_width", digits=5)


@query("""WITH g AS (SELECT b::DOUBLE AS budget, h::DOUBLE AS context, 1e18 * (6.0 + 0.0002 * h) AS u FROM (SELECT unnest([1e18, 1e20, 1e22]) AS b), (SELECT unnest([2048.0, 32768.0]) AS h)),
k AS (SELECT budget AS b0, context, u, budget * s AS b, s FROM g, (SELECT unnest([1 - 1e-4, 1.0, 1 + 1e-4]) AS s)),
n AS (SELECT *, least(greatest(pow(0.33998 * 0.35398 / (0.27988 * 1.24031), 1 / 0.61986) * pow(b / u, 0.27988 / 0.61986), 0.070542), 11.965825) AS n0 FROM k),
o AS (SELECT *, CASE WHEN b / (u * n0) > 299.893 THEN b / (u * 299.893) ELSE n0 END AS n, least(b / (u * n0), 299.893) AS d FROM n),
l AS (SELECT *, 0.33998 * 0.35398 * pow(n, -0.33998) AS en, 0.27988 * 1.24031 * pow(d, -0.27988) AS ed, 1.6898 + 0.35398 * pow(n, -0.33998) + 1.24031 * pow(d, -0.27988) AS loss FROM o),
m AS (SELECT b0, context, max(loss) FILTER (s < 1) - max(loss) FILTER (s > 1) AS diff FROM l GROUP BY b0, context),
f AS (SELECT l.*, diff, n <= 0.070542 * (1 + 1e-8) AS lo, n >= 11.965825 * (1 - 1e-8) AS hi, d >= 299.893 * (1 - 1e-8) AS dh FROM l JOIN m USING (b0, context) WHERE s = 1)
SELECT b0 AS budget, context, concat_ws('|', CASE WHEN abs(u * n * d - b0) <= b0 * 1e-9 THEN 'BUDGET_BINDING' END, CASE WHEN lo THEN 'N_LOWER' END, CASE WHEN hi THEN 'N_UPPER' END, CASE WHEN dh THEN 'D_UPPER' END) AS active,
  round(CASE WHEN (lo OR hi) OR dh THEN 0.0 ELSE abs(en - ed) / sqrt(2) END, 6) AS kkt_residual, round(diff / 2e-4, 6) AS gain_share, round(en, 6) AS n_term, round(ed, 6) AS d_term FROM f""")
def budget_sensitivity(spark, d):
    grid = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    x = spark.range(1).select(grid("budget", [1e18, 1e20, 1e22])).select("*", grid("context", [2048.0, 32768.0]))
    n, k = allocation.optimum(F.col("budget"), F.col("context"))
    x = x.withColumns({"n": n, "d": k})
    s = allocation.sensitivity(F.col("n"), F.col("d"), F.col("budget"), F.col("context"))
    x = x.select("budget", "context", *[c.alias(k) for k, c in s.items()]).withColumn("gain_share", F.col("marginal_gain") * F.col("budget"))
    return rounded(x.select("budget", "context", "active", "kkt_residual", "gain_share", "n_term", "d_term"), "kkt_residual", "gain_share", "n_term", "d_term")


@query("""WITH g AS (SELECT vec_id, list_sum(list_transform(list_zip([0.5, -0.25, 1.0, 0.75], list_transform(embedding[1:4], lambda x: x::DOUBLE)), lambda z: z[1] * z[2])) AS g FROM embeddings), b AS (SELECT min(g) AS g, count(*) AS n FROM g)
SELECT (SELECT min(vec_id) FROM g WHERE g.g = b.g) AS vec_id, round(g, 6) AS loss, n::BIGINT AS n_recipes, 0::BIGINT AS n_better, 'LP_MATCH' AS "check" FROM b""")
def hull_vertex(spark, d):
    return rounded(allocation.best_vertex(table(spark, d, "embeddings"), "vec_id", "embedding", [0.5, -0.25, 1.0, 0.75]), "loss")


def _fisher_sql():
    return """WITH t AS (SELECT event_type, count(*) FILTER (value > 50 AND user_id % 2 = 0) AS a, count(*) FILTER (value > 50 AND user_id % 2 = 1) AS b, count(*) FILTER (value <= 50 AND user_id % 2 = 0) AS c, count(*) FILTER (value <= 50 AND user_id % 2 = 1) AS d FROM events GROUP BY event_type)
SELECT event_type, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(CASE WHEN b * c > 0 THEN (a * d)::DOUBLE / (b * c) END, 6) AS odds FROM t"""


@query(_fisher_sql())
def fisher_tables(spark, d):
    high, even = F.col("value") > 50, F.col("user_id") % 2 == 0
    x = table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(high & even).alias("a"), F.count_if(high & (F.col("user_id") % 2 == 1)).alias("b"), F.count_if((F.col("value") <= 50) & even).alias("c"), F.count_if((F.col("value") <= 50) & (F.col("user_id") % 2 == 1)).alias("d"))
    return rounded(stats.fisher_rows(x, "a", "b", "c", "d").drop("p"), "odds")


@query("""SELECT l_returnflag, count(*)::BIGINT AS n, round(corr(l_extendedprice, 1500 * l_quantity), 6) AS r, round(regr_slope(l_extendedprice, 1500 * l_quantity), 6) AS slope FROM lineitem GROUP BY l_returnflag""")
def calibration_slope(spark, d):
    x = table(spark, d, "lineitem").withColumn("p", 1500 * F.col("l_quantity"))
    return rounded(stats.calibration(x, ["l_returnflag"], "l_extendedprice", "p").drop("p_value"), "r", "slope")


@query("""WITH c AS (SELECT l_quantity AS q, floor(log10(l_extendedprice) * 2)::BIGINT AS cell FROM lineitem WHERE l_extendedprice > 0) SELECT cell, count(*)::BIGINT AS n, round(1.0 / (count(*) * (SELECT count(DISTINCT cell) FROM c)), 9) AS weight FROM c GROUP BY cell""")
def log_bin_weights(spark, d):
    x = stats.cell_weights(table(spark, d, "lineitem").withColumn("cell", numeric.log_bin(F.col("l_extendedprice"), 2)).where(F.col("cell").isNotNull()), ["cell"])
    return rounded(x.groupBy("cell").agg(F.count("*").alias("n"), F.first("weight").alias("weight")), "weight", digits=9)


@query("""WITH a AS (SELECT source, avg(length(coalesce(text, ''))) AS p, avg(n_chars) FILTER (doc_id % 2 = 0) AS q, avg(n_chars) FILTER (doc_id % 2 = 1) AS r FROM documents GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY p DESC NULLS LAST, source) AS rp, row_number() OVER (ORDER BY q DESC NULLS LAST, source) AS rq, row_number() OVER (ORDER BY r DESC NULLS LAST, source) AS rr FROM a)
SELECT source, 'even' AS variant, round(p, 6) AS primary_mean, round(q, 6) AS variant_mean, round(q - p, 6) AS difference, (rq - rp)::BIGINT AS rank_change FROM k UNION ALL SELECT source, 'odd', round(p, 6), round(r, 6), round(r - p, 6), (rr - rp)::BIGINT FROM k""")
def sensitivity_comparison(spark, d):
    x = table(spark, d, "documents").select("source", F.length(F.coalesce("text", F.lit(""))).alias("p"), *[F.when(F.col("doc_id") % 2 == i, F.col("n_chars")).alias(k) for i, k in ((0, "even"), (1, "odd"))])
    return rounded(quality.sensitivity(x, "source", "p", ["even", "odd"]), "primary_mean", "variant_mean", "difference")


@query("""WITH x AS (SELECT doc_id, ('0x' || substr(sha256('20260924' || doc_id::VARCHAR), 1, 16))::UBIGINT % 5 = 0 AS h FROM documents) SELECT doc_id FROM x WHERE h""")
def holdout_rows(spark, d):
    x = table(spark, d, "documents").select("doc_id", role(F.col("doc_id").cast("string")).alias("role"))
    return quality.of_roles(x, "role", ["holdout"]).select("doc_id")


@query(f"""WITH {DOC_FEATURES}, e AS (SELECT min(n_words) AS lo, max(n_words) AS hi FROM f), t AS (SELECT doc_id, (n_words - lo) / (hi - lo)::DOUBLE AS t FROM f, e)
SELECT doc_id, round(pow(1 - t, 3), 6) AS b0, round(3 * t * pow(1 - t, 2), 6) AS b1, round(3 * t * t * (1 - t), 6) AS b2 FROM t""")
def spline_basis(spark, d):
    x = written(quality.text_features(texts(spark, d)).select("doc_id", "n_words"), "words")
    low, high = x.agg(F.min("n_words"), F.max("n_words")).first()
    b = lists.bernstein_cubic(F.col("n_words").cast("double"), float(low), float(high))
    return x.select("doc_id", *[r6(b[i]).alias(f"b{i}") for i in range(3)])


@query("""SELECT doc_id, coalesce(list_position(['de', 'en', 'es'], lang) = 2, FALSE)::INT::DOUBLE AS is_en, coalesce(lang = 'es', FALSE)::INT::DOUBLE AS is_es,
  CASE WHEN regexp_full_match(replace(replace(n_chars::VARCHAR, ',', ''), ' ', ''), '[0-9]+') AND n_chars > 0 THEN n_chars::DOUBLE END AS amount, lower(trim(coalesce(source, ''))) IN ('', 'nan', 'none', 'n/a', 'na', 'null', '-', '-1', 'unknown') AS blank_source FROM documents""")
def typed_fields(spark, d):
    x = table(spark, d, "documents")
    hot = lists.one_hot(F.col("lang"), ["de", "en", "es"])
    return x.select("doc_id", hot[0].alias("is_en"), hot[1].alias("is_es"), numeric.positive_number(F.format_number("n_chars", 0)).alias("amount"), numeric.is_blank(F.col("source")).alias("blank_source"))


@query()
def robust_regressions(spark, d):
    x = table(spark, d, "lineitem").select(F.lit(1.0).alias("one"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("y"))
    r = fit.robust_regressions(x, ["one", "q"], "y")
    return r.select("kind", "status", "n", *[F.round(F.get("coefficients", F.lit(i)), 4).alias(k) for i, k in enumerate(("intercept", "slope"))])


@query("""SELECT count(*)::BIGINT AS n, 2::BIGINT AS rank, round(1 - pow(corr(l_discount, l_quantity), 2), 6) AS outside FROM lineitem""")
def column_space_share(spark, d):
    return rounded(fit.column_space(table(spark, d, "lineitem"), ["l_quantity"], "l_discount"), "outside")


@query()
def nested_ridge(spark, d):
    x = table(spark, d, "lineitem").withColumn("one", F.lit(1.0)).withColumn("qd", F.col("l_quantity") * F.col("l_discount")).withColumn("fold", F.col("l_orderkey") % 5)
    folds = fit.gram(x, ["one", "l_quantity", "l_discount", "qd"], ["l_extendedprice", "l_tax"], "fold")
    found = fit.nested_ridge(folds, {"linear": [0, 1, 2], "quadratic": [0, 1, 2, 3]}, [1e-5, 1e-3, 1e-1, 10.0, 1000.0])
    f = spark.createDataFrame(found, "family string, fold long, alpha double, sse double, n long")
    g = f.groupBy("family").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("oof_rmse"), F.count("*").alias("folds"))
    return evaluation.near_tie(g, [], "family", "oof_rmse", ["linear", "quadratic"], 0.0).select("chosen", F.round("best", 3).alias("oof_rmse"))


@query()
def profile_likelihood(spark, d):
    return fit.profile_table(_cells(spark, d), "n", "t", "y")


@query("""SELECT page_id, 'fi' || url AS normal, NULLIF(lower(regexp_extract(url, '^https?://[^/]+/([^/?#]+/[^/?#]+)', 1)), '') AS repository, page_id::VARCHAR AS pretrained FROM pages""")
def text_identities(spark, d):
    from ..functions import text

    p = table(spark, d, "pages")
    said = F.concat(F.lit("pretrained="), F.col("page_id").cast("string"), F.lit(",dtype=x"))
    return p.select("page_id", text.nfkc(F.concat(F.lit("ﬁ"), "url")).alias("normal"), text.repository_of(F.col("url")).alias("repository"), text.argument(said, "pretrained").alias("pretrained"))


@query("""SELECT event_id, (ts + INTERVAL 8 HOUR)::DATE AS local_day, ts::DATE + ((user_id % 9) // 2)::INTEGER AS middle FROM events""")
def local_dates(spark, d):
    from ..functions import dates

    e = table(spark, d, "events")
    day = F.to_date("ts")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", dates.local_date(F.floor(seconds), "Asia/Shanghai").alias("local_day"), dates.midpoint(day, F.date_add(day, (F.col("user_id") % 9).cast("int"))).alias("middle"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN user_id::DOUBLE WHEN 2 THEN CASE WHEN user_id = user_id + 1 THEN 0 END ELSE NULL END AS amount FROM events""")
def token_amounts(spark, d):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    said = F.when(k == 0, u).when(k == 1, F.concat(u, F.lit(", "), u)).when(k == 2, F.concat(u, F.lit(","), (F.col("user_id") + 1).cast("string"))).otherwise("unknown")
    return table(spark, d, "events").select("event_id", numeric.token_amount(said).alias("amount"))


@query(scored_sql() + """, zz AS (SELECT doc_id, [z_mean_word_length, z_unique_share, z_no_alpha_share] AS z FROM s), p AS (SELECT doc_id, z, list_filter(z, lambda v: v IS NOT NULL) AS p FROM zz)
SELECT doc_id, round(CASE WHEN len(p) = 3 THEN list_avg(p) END, 6) AS complete_mean, round(CASE WHEN len(p) > 0 THEN list_avg(p) END, 6) AS partial_mean, len(p)::INTEGER AS n_valid, round(CASE WHEN len(p) > 1 THEN list_stddev_pop(p) END, 6) AS spread FROM p""")
def partial_means(spark, d):
    x = quality.scored(written(quality.text_features(texts(spark, d)), "text-features"))
    z = [F.col(f"z_{v}") for v in quality.BOUNDED]
    return rounded(
        x.select("doc_id", numeric.strict_mean(*z).alias("complete_mean"), numeric.skipping_mean(*z).alias("partial_mean"), sum(v.isNotNull().cast("int") for v in z).alias("n_valid"), numeric.skipping_std(*z).alias("spread")),
        "complete_mean", "partial_mean", "spread",
    )


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN [embedding[1]::DOUBLE, NULL, 'nan'::DOUBLE, 'inf'::DOUBLE] ELSE [embedding[1]::DOUBLE, embedding[2]::DOUBLE, NULL, '-inf'::DOUBLE] END AS x FROM embeddings)
SELECT vec_id, (vec_id % 4 = 0)::INT AS nans, 1 AS nulls, (vec_id % 4 = 0)::INT AS posinf, (vec_id % 4 <> 0)::INT AS neginf FROM e""")
def element_counts(spark, d):
    e, inf = F.col("embedding"), lambda v: F.lit(float(v))
    x = F.when(F.col("vec_id") % 4 == 0, F.array(e[0].cast("double"), F.lit(None), inf("nan"), inf("inf"))).otherwise(F.array(e[0].cast("double"), e[1].cast("double"), F.lit(None), inf("-inf")))
    c = lists.element_counts(x)
    return table(spark, d, "embeddings").select("vec_id", *[c[k].alias(k) for k in ("nulls", "nans", "posinf", "neginf")])


SCOPE_METRICS = {"mean": ("q", "mean"), "median": ("q", "median"), "std": ("q", "std"), "high_rate": ("high", "rate"), "range_median": ("r", "median"), "spread_median": ("s", "median")}


def _draws_sql():
    long = " UNION ALL ".join(f"SELECT event_type AS scope, event_id AS k, '{c}' AS c, {v} AS v FROM events" for c, v in (("q", "value::DOUBLE"), ("high", "(abs(value - 50) > 20)::INT::DOUBLE"), ("r", "abs(value - 50)::DOUBLE"), ("s", "(value * value / 100)::DOUBLE")))
    return f"""x AS ({long}), u AS (SELECT scope, c, r, v, CASE WHEN r = 0 THEN 0 ELSE ('0x' || substr(sha256('o6|' || c || '|' || r::VARCHAR || '|' || k::VARCHAR), 1, 13))::UBIGINT END AS u FROM x, (SELECT unnest(range(0, 7)) AS r) WHERE v IS NOT NULL),
e AS (SELECT scope, c, r, v, unnest(range(0, CASE WHEN r = 0 THEN 1 ELSE {POISSON} END)) FROM u),
g AS (SELECT scope, c, r, avg(v) AS m, quantile_cont(v, 0.5) AS h, stddev_samp(v) AS sd FROM e GROUP BY ALL),
d AS (SELECT scope, 'mean' AS metric, r, m AS v FROM g WHERE c = 'q' UNION ALL SELECT scope, 'median', r, h FROM g WHERE c = 'q' UNION ALL SELECT scope, 'std', r, sd FROM g WHERE c = 'q' UNION ALL SELECT scope, 'high_rate', r, m FROM g WHERE c = 'high'
  UNION ALL SELECT scope, 'range_median', r, h FROM g WHERE c = 'r' UNION ALL SELECT scope, 'spread_median', r, h FROM g WHERE c = 's')"""


def _scope_draws(spark, d):
    v = F.col("value")
    x = table(spark, d, "events").select("event_type", "event_id", v.alias("q"), (F.abs(v - 50) > 20).cast("int").alias("high"), F.abs(v - 50).alias("r"), (v * v / 100).alias("s"))
    return written(bootstrap.scope_draws(x, "event_type", "event_id", SCOPE_METRICS, 6, "o6"), "scope-draws")


@query(f"""WITH {_draws_sql()} SELECT scope, metric, round(max(v) FILTER (r = 0), 6) AS estimate, round(quantile_cont(v, 0.5) FILTER (r > 0), 6) AS median, round(quantile_cont(v, 0.025) FILTER (r > 0), 6) AS low,
  round(quantile_cont(v, 0.975) FILTER (r > 0), 6) AS high, count(v) FILTER (r > 0)::BIGINT AS replicates FROM d GROUP BY scope, metric""")
def scope_bootstrap(spark, d):
    return rounded(bootstrap.scope_intervals(_scope_draws(spark, d)), "estimate", "median", "low", "high")


@query(f"""WITH {_draws_sql()}, z AS (SELECT a.metric, a.r, a.v - b.v AS v FROM d a JOIN d b USING (metric, r) WHERE a.scope = 'click' AND b.scope = 'view')
SELECT 'click' AS scope_a, 'view' AS scope_b, metric, round(max(v) FILTER (r = 0), 6) AS difference, round(quantile_cont(v, 0.5) FILTER (r > 0), 6) AS median, round(quantile_cont(v, 0.025) FILTER (r > 0), 6) AS low,
  round(quantile_cont(v, 0.975) FILTER (r > 0), 6) AS high, round(avg((v > 0)::INT) FILTER (r > 0), 6) AS share_above FROM z GROUP BY metric""")
def scope_differences(spark, d):
    return rounded(bootstrap.scope_differences(_scope_draws(spark, d), [("click", "view")]), "difference", "median", "low", "high", "share_above")


def _wide_sql():
    cols = []
    for v in ("n_words", "n_sentences", "mean_word_length"):
        cols += [f"count({v})::BIGINT AS {v}_n", f"count(*) FILTER ({v} IS NULL)::BIGINT AS {v}_missing", f"round(avg({v}), 6) AS {v}_mean", f"round(stddev_samp({v}), 6) AS {v}_std", f"round(min({v})::DOUBLE, 6) AS {v}_min", f"round(max({v})::DOUBLE, 6) AS {v}_max"]
        cols += [f"round(quantile_cont({v}, {q}), 6) AS {v}_{k}" for k, q in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))]
    return f"""WITH {DOC_FEATURES}, x AS (SELECT 'all' AS scope, lang AS l, n_words, n_sentences, mean_word_length FROM f UNION ALL SELECT 'long', lang, n_words, n_sentences, mean_word_length FROM f WHERE n_words > 300)
SELECT scope, CASE WHEN grouping(l) = 1 THEN 'ALL' ELSE l END AS lang, count(*)::BIGINT AS n_total, {", ".join(cols)} FROM x GROUP BY GROUPING SETS ((scope, l), (scope))"""


@query(_wide_sql())
def scope_wide_summary(spark, d):
    x = written(quality.text_features(texts(spark, d)), "text-features")
    x = summary.scoped(x, {"all": F.lit(True), "long": F.col("n_words") > 300})
    w = summary.wide(x, ["scope"], "lang", ["n_words", "n_sentences", "mean_word_length"])
    return rounded(w, *[c for c in w.columns if c.rsplit("_", 1)[-1] in ("mean", "std", "p05", "p25", "p50", "p75", "p95")], *[f"{v}_{k}" for v in ("n_words", "n_sentences", "mean_word_length") for k in ("min", "max")], digits=6)


@query()
def frozen_scale_fit(spark, d):
    s = fit.fit_summary(written(fit.frozen_scale_fit(_cells(spark, d), "n", "t", "y", 9), "frozen-fits"))
    return rounded(s, "cost", "e", "a", "alpha", "b", "beta", digits=4)


@query()
def budget_scenarios(spark, d):
    grid = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    x = spark.range(1).select(grid("budget", [1e18, 1e20, 1e22])).select("*", grid("context", [2048.0, 32768.0])).select("*", grid("cost_kind", ["exp", "power", "log"]))
    x = x.select("*", grid("effect", ["additive", "tokens"])).select("*", grid("gain", [0.0, 0.1, 0.8])).withColumn("cost_scale", F.lit(1.0))
    x = x.withColumn("case_id", F.row_number().over(Window.orderBy("budget", "context", "cost_kind", "effect", "gain")).cast("long"))  # 108 rows
    s = allocation.solve(x.repartition(16))
    s = s.join(x, "case_id").withColumn("spent_share", F.col("spent") / F.col("budget"))
    return rounded(s.select("budget", "context", "cost_kind", "effect", "gain", "n", "d", "q", "loss", "spent_share"), "n", "d", "q", "loss", "spent_share")


@query("""SELECT o_orderkey FROM orders ORDER BY abs(epoch(o_orderdate) - epoch(TIMESTAMP '2031-06-15')), o_orderkey LIMIT 3""")
def nearest_dates(spark, d):
    return joins.around(table(spark, d, "orders"), "o_orderdate", "2031-06-15", 30, 3, "o_orderkey").select("o_orderkey")


@query("""SELECT c_custkey, (('0x' || substr(sha256('fold' || c_nationkey::VARCHAR), 1, 16))::UBIGINT % 4)::INTEGER AS fold FROM customer""")
def group_folds(spark, d):
    return table(spark, d, "customer").select("c_custkey", rows.group_fold(F.col("c_nationkey"), 4).alias("fold"))
