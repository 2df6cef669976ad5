"""Queries over the star schema, events, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, jsonx, lists, numeric
from ..functions import text as texts
from ..operators import allocation, bootstrap, checks, evaluation, fit, joins, ordering, rows, stats, summary
from . import base
from .base import query, r6, rounded, table


@query("""SELECT 'o_totalprice' AS column_name, 'double' AS type, NULL::VARCHAR AS example, count(*) FILTER (o_totalprice IS NULL)::BIGINT AS missing, count(DISTINCT o_totalprice)::BIGINT AS n_distinct, min(o_totalprice)::DOUBLE AS low, max(o_totalprice)::DOUBLE AS high,
  round(avg(o_totalprice), 4) AS mean, count(*) FILTER (o_totalprice = 0)::BIGINT AS zeros, count(*) FILTER (o_totalprice < 0)::BIGINT AS negatives FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', min(o_orderstatus), count(*) FILTER (o_orderstatus IS NULL), count(DISTINCT o_orderstatus), NULL, NULL, NULL, NULL, NULL FROM orders""")
def column_profile(spark, d):
    return rounded(summary.column_profile(table(spark, d, "orders"), ["o_totalprice"], ["o_orderstatus"]), "mean", digits=4)


@query("""SELECT 'lineitem' AS name, sum(n)::BIGINT AS rows, count(*)::BIGINT AS distinct_keys, sum(n - 1)::BIGINT AS duplicate_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
UNION ALL SELECT 'orders', sum(n)::BIGINT, count(*)::BIGINT, sum(n - 1)::BIGINT FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)""")
def key_uniqueness(spark, d):
    a = checks.duplicate_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("lineitem").alias("name"), "*")
    return a.unionByName(checks.duplicate_audit(table(spark, d, "orders"), ["o_custkey"]).select(F.lit("orders").alias("name"), "*"))


@query("""SELECT 'rows' AS check_id, count(*)::VARCHAR AS actual, (SELECT count(*) FROM orders)::VARCHAR AS expected, 'PASS' AS status FROM orders
UNION ALL SELECT 'no_negative', count(*) FILTER (o_totalprice < 0)::VARCHAR, '0', CASE WHEN count(*) FILTER (o_totalprice < 0) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders
UNION ALL SELECT 'unseen', NULL, '1', 'NOT_CHECKED'""")
def contract_checks(spark, d):
    x = table(spark, d, "orders")
    return checks.check_rows(x, {"rows": (F.count("*"), x.count()), "no_negative": (F.count_if(F.col("o_totalprice") < 0), 0), "unseen": (F.max(F.lit(None).cast("string")), 1)})


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b FROM lineitem)
SELECT l_returnflag, count(*)::BIGINT AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY l_returnflag""")
def spearman_by_group(spark, d):
    return rounded(stats.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"), "rho")


@query("""SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def regr_slope_cells(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(F.regr_slope("l_extendedprice", "l_quantity")).alias("slope"), F.count("*").alias("n"))


@query("""SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.025), 6) AS p2_5, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY o_orderstatus""")
def exact_quantiles(spark, d):
    x = ordering.quantiles(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", {"p2_5": 0.025, "p50": 0.5, "p90": 0.9})
    return rounded(x, "p2_5", "p50", "p90")


@query("""SELECT o_orderstatus, count(*)::BIGINT AS n, list_sort(list(o_totalprice))[(ceil(round(least(1.0, ceil((count(*) + 1) * 0.95) / count(*)) * (count(*) - 1), 9)) + 1)::BIGINT] AS conformal_q FROM orders GROUP BY o_orderstatus""")
def conformal_quantile(spark, d):
    return stats.conformal(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice")


@query("""SELECT round((avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'N')) / sqrt((var_samp(l_quantity) FILTER (l_returnflag = 'R') + var_samp(l_quantity) FILTER (l_returnflag = 'N')) / 2), 6) AS smd_sample,
  round((avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'N')) / sqrt((var_pop(l_quantity) FILTER (l_returnflag = 'R') + var_pop(l_quantity) FILTER (l_returnflag = 'N')) / 2), 6) AS smd_population FROM lineitem""")
def smd_two_variants(spark, d):
    a, b = (F.when(F.col("l_returnflag") == k, F.col("l_quantity")) for k in ("R", "N"))
    x = table(spark, d, "lineitem").agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("sa"), F.var_samp(b).alias("sb"), F.var_pop(a).alias("pa"), F.var_pop(b).alias("pb"))
    f = lambda u, v: r6(stats.standardised_difference(F.col("ma"), F.col("mb"), F.col(u), F.col(v)))
    return x.select(f("sa", "sb").alias("smd_sample"), f("pa", "pb").alias("smd_population"))


@query("""WITH r AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS e, ts, event_id FROM events), x AS (SELECT event_type, e, e - lag(e) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dd FROM r)
SELECT event_type, count(e)::BIGINT AS n, round(sum(dd * dd) / sum(e * e), 6) AS dw FROM x GROUP BY event_type""")
def durbin_watson(spark, d):
    e = table(spark, d, "events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    return rounded(stats.durbin_watson(e.join(m, "event_type").withColumn("e", F.col("value") - F.col("m")), ["event_type"], ["ts", "event_id"], "e"), "dw")


@query("""WITH g AS (SELECT unnest([1000.0, 50000.0, 150000.0, 300000.0]) AS q), x AS (SELECT c_mktsegment AS s, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT s, q, count(*) FILTER (v <= q)::DOUBLE / count(v) AS f FROM x, g GROUP BY s, q)
, p AS (SELECT q, count(*) FILTER (v <= q)::DOUBLE / count(*) AS f FROM x, g GROUP BY q)
SELECT e.q::DOUBLE AS q, round(avg(e.f), 6) AS f_equal, round(any_value(p.f), 6) AS f_pooled FROM e JOIN p ON e.q = p.q GROUP BY e.q""")
def ecdf_equal_domain(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("s"), F.col("o_totalprice").alias("v"))
    grid = [1000.0, 50000.0, 150000.0, 300000.0]
    a = stats.ecdf(x, ["s"], "v", grid).groupBy("q").agg(r6(F.avg("f")).alias("f_equal"))
    return a.join(stats.ecdf(x, [], "v", grid).select("q", r6("f").alias("f_pooled")), "q")


@query("""SELECT user_id % 10 AS bucket, count(*) FILTER (event_type = 'click')::BIGINT AS click, count(*) FILTER (event_type = 'view')::BIGINT AS view, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchase FROM events GROUP BY bucket""")
def pivot_event_counts(spark, d):
    return summary.pivot_counts(table(spark, d, "events").withColumn("bucket", F.col("user_id") % 10), ["bucket"], "event_type", ["click", "view", "purchase"])


@query("""SELECT bucket, kind, n::BIGINT AS n FROM (SELECT user_id % 10 AS bucket, 'click' AS kind, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY bucket UNION ALL SELECT user_id % 10, 'view', count(*) FILTER (event_type = 'view') FROM events GROUP BY 1)""")
def unpivot_back(spark, d):
    x = summary.pivot_counts(table(spark, d, "events").withColumn("bucket", F.col("user_id") % 10), ["bucket"], "event_type", ["click", "view"])
    return x.unpivot(["bucket"], ["click", "view"], "kind", "n")


@query("""SELECT c_nationkey, CASE WHEN min(c_mktsegment) IS NULL THEN 'MISSING' WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) ELSE 'CONFLICT' END AS segment FROM customer GROUP BY c_nationkey""")
def consensus_segment(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(rows.consensus("c_mktsegment").alias("segment"))


@query("""WITH p AS (SELECT o_orderstatus AS s, quantile_cont(o_totalprice, 0.9) AS q FROM orders GROUP BY s)
SELECT s, round(avg(greatest(0.9 * (o_totalprice - q), -0.1 * (o_totalprice - q))), 4) AS loss, round(avg((o_totalprice <= q)::INT), 6) AS coverage FROM orders JOIN p ON o_orderstatus = s GROUP BY s""")
def pinball_coverage(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "s")
    q = ordering.quantiles(o, ["s"], "o_totalprice", {"q": 0.9})
    y = F.col("o_totalprice")
    return o.join(F.broadcast(q), "s").groupBy("s").agg(F.round(stats.pinball(y, F.col("q"), 0.9), 4).alias("loss"), r6(F.avg((y <= F.col("q")).cast("int"))).alias("coverage"))


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, l_quantity AS q, l_extendedprice AS p, 1.0::DOUBLE / (count(*) OVER (PARTITION BY l_returnflag, l_linestatus) * (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem))) AS w FROM lineitem)
SELECT round(sqrt(sum(w * (1500 * q - p) * (1500 * q - p)) / sum(w)), 4) AS rmse, round(sum(w * abs(1500 * q - p)) / sum(w), 4) AS mae, round(sum(w * (1500 * q - p)) / sum(w), 4) AS bias FROM c""")
def weighted_metrics(spark, d):
    x = stats.cell_weights(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    e = x.agg(*stats.errors(F.col("l_extendedprice"), 1500 * F.col("l_quantity"), F.col("weight")))
    return rounded(e.drop("r2"), "rmse", "mae", "bias", digits=4)


@query("""SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""")
def inner_guarded(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return joins.guarded(o, table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]).drop("c_custkey")


@query("""SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_enrich(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    x = joins.guarded(c, table(spark, d, "nation"), ["n_nationkey"], "left")
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.guarded(x, r, ["n_regionkey"], "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*)::BIGINT AS n
FROM (SELECT DISTINCT p_partkey AS k FROM part) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) b USING (k) GROUP BY side""")
def full_outer_presence(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return joins.presence(a, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")), ["k"])


@query("""WITH a AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY ALL)
SELECT l_suppkey, l_quantity, coalesce(a.n, 0)::BIGINT AS n_left, coalesce(b.n, 0)::BIGINT AS n_right FROM a FULL JOIN b USING (l_suppkey, l_quantity) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def bag_equality(spark, d):
    x = table(spark, d, "lineitem")
    return joins.bag_difference(x, x.where("l_orderkey % 7 <> 0"), ["l_suppkey", "l_quantity"])


@query("""SELECT count(*)::BIGINT AS n_common, count(*) FILTER (x.v = y.v)::BIGINT AS n_exact, count(*) FILTER (abs(x.v - y.v) <= 1)::BIGINT AS n_close, max(abs(x.v - y.v)) AS max_abs, round(avg(abs(x.v - y.v)), 6) AS mean_abs
FROM (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier GROUP BY k) x JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY k) y USING (k)""")
def value_agreement(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"))
    return rounded(joins.value_agreement(a, b, ["k"], "v", 1.0), "mean_abs")


@query("""WITH s AS (SELECT event_type AS e, ts, max(value) AS v FROM events GROUP BY e, ts), f AS (SELECT e, arg_min(v, ts) AS fv FROM s GROUP BY e)
SELECT x.event_id, coalesce(s.v, f.fv) AS step_value FROM events x ASOF LEFT JOIN s ON x.event_type = s.e AND x.ts >= s.ts LEFT JOIN f ON x.event_type = f.e""")
def asof_step_lookup(spark, d):
    e = table(spark, d, "events")
    steps = e.groupBy("event_type", "ts").agg(F.max("value").alias("step_value"))
    return joins.as_of(e.select("event_id", "event_type", "ts"), ["event_type"], "ts", steps, "ts", "step_value").select("event_id", "step_value")


@query("""SELECT q, CASE WHEN q >= 0.7 THEN 3.0::DOUBLE WHEN q >= 0.5 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM (SELECT DISTINCT l_discount * 10 AS q FROM lineitem)""")
def step_grid(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("q")).distinct()
    return x.select("q", joins.step_lookup(F.col("q"), [(0.2, 1.0), (0.5, 2.0), (0.7, 3.0)]).alias("v"))


@query("""SELECT o_orderkey FROM orders WHERE abs(epoch(o_orderdate) - epoch(TIMESTAMP '1995-06-15')) <= 365 * 86400""")
def interval_window_join(spark, d):
    return joins.around(table(spark, d, "orders"), "o_orderdate", "1995-06-15", 365, 3, "o_orderkey").select("o_orderkey")


@query("""SELECT r_name, b::DOUBLE AS budget, h::DOUBLE AS context, k AS cost_kind, round(CASE k WHEN 'exp' THEN exp(0.8) - 1 WHEN 'power' THEN 0.8 ELSE ln(1.8) END::DOUBLE, 6) AS g,
  round(((6 + 0.0002 * h) * r_regionkey * 20)::DOUBLE, 6) AS cost FROM region, (SELECT unnest([1e18, 1e20, 1e22]) AS b), (SELECT unnest([2048.0, 32768.0]) AS h), (SELECT unnest(['exp', 'power', 'log']) AS k)""")
def scenario_cross(spark, d):
    grid = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    x = table(spark, d, "region").select("*", grid("budget", [1e18, 1e20, 1e22])).select("*", grid("context", [2048.0, 32768.0])).select("*", grid("cost_kind", ["exp", "power", "log"]))
    q = F.lit(0.8)
    g = F.when(F.col("cost_kind") == "exp", numeric.quality_cost(q, "exp")).when(F.col("cost_kind") == "power", numeric.quality_cost(q, "power")).otherwise(numeric.quality_cost(q, "log"))
    cost = numeric.training_cost(F.col("r_regionkey").cast("double"), F.lit(20.0), F.col("context"), 2e-4)
    return x.select("r_name", "budget", "context", "cost_kind", r6(g).alias("g"), r6(cost).alias("cost"))


GROWTH = """WITH m AS (SELECT c_mktsegment AS family, date_trunc('quarter', o_orderdate)::DATE AS ts, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
p AS (SELECT family, ts AS start, v AS a, lead(ts) OVER w AS n, lead(v) OVER w AS b FROM m WINDOW w AS (PARTITION BY family ORDER BY ts, v)),
g AS (SELECT family, start, (n - start)::INTEGER AS days, ln(b / a) / ((n - start) / 365.25) AS growth FROM p WHERE n - start BETWEEN 60 AND 730 AND a > 0 AND b > 0)"""


def _growth(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = x.groupBy(F.col("c_mktsegment").alias("family"), F.to_date(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp"))).alias("ts")).agg(F.sum("o_totalprice").alias("v"))
    return evaluation.growth_intervals(m, "family", "ts", "v", 60, 730)


@query(GROWTH + " SELECT family, start, days, round(growth, 6) AS growth FROM g")
def adjacent_growth(spark, d):
    return rounded(_growth(spark, d), "growth")


@query(GROWTH + """, f AS (SELECT family, quantile_cont(growth, 0.5) AS m, count(*) AS n FROM g GROUP BY family)
SELECT count(*)::BIGINT AS n_families, coalesce(sum(n), 0)::BIGINT AS n_intervals, CASE WHEN count(*) >= 3 AND sum(n) >= 10 THEN 'IDENTIFIED' ELSE 'NOT_IDENTIFIABLE' END AS status,
  round(quantile_cont(m, 0.5), 6) AS rate, round(quantile_cont(m, 0.1), 6) AS low, round(quantile_cont(m, 0.9), 6) AS high FROM f""")
def growth_rate(spark, d):
    return rounded(evaluation.growth_rate(_growth(spark, d), "family"), "rate", "low", "high")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_user(spark, d):
    return rows.latest(table(spark, d, "events"), ["user_id"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]).select("user_id", "event_id", "value")


@query("""SELECT user_id, max(event_id)::BIGINT AS event_id FROM events GROUP BY user_id""")
def latest_run_by_name(spark, d):
    return rows.latest_by(table(spark, d, "events"), ["user_id"], F.col("event_id"), ["event_id"])


@query("""SELECT event_id, (row_number() OVER w - 1)::BIGINT AS ordinal, row_number() OVER w <= floor(0.8::DECIMAL(10,4) * count(*) OVER (PARTITION BY user_id)) AS in_train FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def ordinal_and_cut80(spark, d):
    x = table(spark, d, "events").select("event_id", "user_id", "ts")
    x = rows.early_part(rows.ordinal(x, ["user_id"], ["ts", "event_id"]), ["user_id"], ["ts", "event_id"])
    return x.select("event_id", "ordinal", "in_train")


@query("""WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, max(o_totalprice) AS best FROM orders GROUP BY ALL)
SELECT o_orderpriority, month, best, max(best) OVER (PARTITION BY o_orderpriority ORDER BY month) AS frontier FROM m""")
def running_frontier(spark, d):
    return evaluation.monthly_frontier(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice")


@query("""SELECT event_id, event_type, previous_state FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events) WHERE previous_state <> event_type""")
def state_transitions(spark, d):
    return rows.transitions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "previous_state")


@query("""SELECT n_name AS name, n_regionkey::BIGINT AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT c_name, NULL, c_acctbal FROM customer""")
def union_by_name(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return summary.union_all(a, table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def intersect_keys(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")))


@query("SELECT n_nationkey AS k FROM nation EXCEPT ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def except_all_keys(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("k")).exceptAll(n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")))


@query("SELECT c_mktsegment AS v FROM customer UNION SELECT o_orderpriority FROM orders")
def distinct_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("v")).union(table(spark, d, "orders").select(F.col("o_orderpriority").alias("v"))).distinct()


@query("""SELECT vec_id, len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AS is_valid, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS top,
  len(list_filter(embedding, lambda x: x < 0)) > 0 AS any_negative, len(list_filter(embedding, lambda x: x < 0 OR x > 1)) = 0 AS in_unit FROM embeddings""")
def list_validity_argmax(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", lists.is_valid(e, 64).alias("is_valid"), lists.argmax(e).alias("top"), lists.any_negative(e).alias("any_negative"), lists.in_unit(e).alias("in_unit"))


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS a, embedding AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(a, lambda x: x / list_sum(a))), 6) AS total, round(list_sum(list_transform(list_zip(a, e), lambda z: (z[1] / list_sum(a)) * z[2])), 6) AS dot FROM a""")
def mixture_normalise_dot(spark, d):
    p = lists.normalised(F.transform("embedding", lambda v: F.abs(v)))
    return table(spark, d, "embeddings").select("vec_id", r6(lists.total(p)).alias("total"), r6(lists.dot(p, F.col("embedding"))).alias("dot"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE)) + embedding[1]::DOUBLE * embedding[2] + embedding[1]::DOUBLE * embedding[3] + embedding[1]::DOUBLE * embedding[4] + embedding[2]::DOUBLE * embedding[3] + embedding[2]::DOUBLE * embedding[4] + embedding[3]::DOUBLE * embedding[4], 5) AS s, 10::INTEGER AS n FROM embeddings""")
def quadratic_terms(spark, d):
    q = lists.quadratic(F.col("embedding"), 4)
    return table(spark, d, "embeddings").select("vec_id", F.round(lists.total(q), 5).alias("s"), F.size(q).alias("n"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", numeric.number(F.get_json_object("props", "$.k")).alias("k"))


@query("""SELECT event_id, 'm,none' AS metric, value, 0.5::DOUBLE AS stderr FROM events""")
def nested_metrics(spark, d):
    text = F.concat(F.lit('{"results":{"t":{"m,none":"'), F.col("value").cast("string"), F.lit('","m_stderr,none":0.5,"alias":"x"}}}'))
    x = jsonx.long_metrics(table(spark, d, "events").select("event_id", text.alias("j")), "event_id", "j")
    return x.select("event_id", "metric", "value", "stderr")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS quarter,
  CASE WHEN o_orderdate::DATE <= DATE '1994-12-31' THEN 'early' WHEN o_orderdate::DATE <= DATE '1996-06-30' THEN 'middle' ELSE 'late' END AS period,
  CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium' ELSE 'large' END AS bin_open,
  CASE WHEN o_totalprice <= 50000 THEN 'small' WHEN o_totalprice <= 150000 THEN 'medium' ELSE 'large' END AS bin_closed FROM orders""")
def date_windows(spark, d):
    t, p = F.col("o_orderdate"), F.col("o_totalprice")
    edges, labels = [50000.0, 150000.0], ["small", "medium", "large"]
    return table(spark, d, "orders").select("o_orderkey", dates.month_key(t).alias("month"), dates.quarter_label(t).alias("quarter"),
        dates.calendar_window(F.to_date(t), [("1994-12-31", "early"), ("1996-06-30", "middle")], "late").alias("period"),
        dates.bin_open_right(p, edges, labels).alias("bin_open"), dates.bin_closed_right(p, edges, labels).alias("bin_closed"))


BOX = "CASE WHEN l_quantity BETWEEN 5 AND 40 AND l_extendedprice BETWEEN 5000 AND 60000 THEN 'inside' WHEN NOT l_quantity BETWEEN 5 AND 40 AND l_extendedprice BETWEEN 5000 AND 60000 THEN 'outside_x' WHEN l_quantity BETWEEN 5 AND 40 THEN 'outside_y' ELSE 'outside_both' END"


@query(f"""SELECT l_orderkey, l_linenumber, round(1.6898 + 0.35398 * pow(l_quantity, -0.33998) + 1.24031 * pow(l_extendedprice / 1000, -0.27988), 6) AS loss, {BOX} AS support FROM lineitem""")
def scaling_law_predict(spark, d):
    law = allocation.LAW
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(numeric.power_law(q, p / 1000, law["e"], law["a"], law["alpha"], law["b"], law["beta"])).alias("loss"), numeric.in_box(q, 5, 40, p, 5000, 60000).alias("support"))


@query(f"""SELECT {BOX} AS support, count(*)::BIGINT AS n, CASE WHEN count(*) >= 5 AND avg(l_discount) <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem GROUP BY support""")
def support_oos_audit(spark, d):
    x = table(spark, d, "lineitem").groupBy(numeric.in_box(F.col("l_quantity").cast("double"), 5, 40, F.col("l_extendedprice"), 5000, 60000).alias("support"))
    x = x.agg(F.count("*").alias("n"), F.avg("l_discount").alias("m"))
    return x.select("support", "n", summary.gate_status(F.col("n") >= 5, F.col("m") <= 0.05).alias("status"))


@query("""WITH b AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem)
SELECT CASE WHEN l_quantity <= q1 THEN 1 WHEN l_quantity <= q2 THEN 2 WHEN l_quantity <= q3 THEN 3 ELSE 4 END::BIGINT AS stratum, count(*)::BIGINT AS n, round(avg(1500 * l_quantity - l_extendedprice), 4) AS bias FROM lineitem, b GROUP BY stratum""")
def bias_quartiles(spark, d):
    x = table(spark, d, "lineitem")
    b = ordering.quantiles(x, [], "l_quantity", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    y = F.col("l_quantity")
    s = F.when(y <= F.col("q1"), 1).when(y <= F.col("q2"), 2).when(y <= F.col("q3"), 3).otherwise(4).cast("long")
    return x.crossJoin(F.broadcast(b)).groupBy(s.alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg(1500 * y - F.col("l_extendedprice")), 4).alias("bias"))  # one row of breaks


@query("""SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem""")
def gram_ols(spark, d):
    g = fit.gram(table(spark, d, "lineitem").withColumn("one", F.lit(1.0)), ["one", "l_quantity"], ["l_extendedprice"])
    b = fit.ridge(g[0][0], g[0][1], 0.0)
    return spark.createDataFrame([(round(float(b[0, 0]), 3), round(float(b[1, 0]), 3))], "intercept double, slope double")


def _ridge_sql():
    pairs = ["aa", "ab", "ac", "bb", "bc", "cc", "ay", "by", "cy", "az", "bz", "cz", "yy", "zz"]
    own = ", ".join(f"sum({p[0]} * {p[1]}) AS {p}_" for p in pairs)
    rest = ", ".join(f"t.{p}_ - o.{p}_ AS {p}_" for p in pairs)
    beta = lambda v: f"""((d*d-r*r)*{v}1 + (q*r-p*d)*{v}2 + (p*r-q*d)*{v}3)/det/sa AS {v}b1, ((q*r-p*d)*{v}1 + (d*d-q*q)*{v}2 + (p*q-r*d)*{v}3)/det/sb AS {v}b2,
      ((p*r-q*d)*{v}1 + (p*q-r*d)*{v}2 + (d*d-p*p)*{v}3)/det/sc AS {v}b3"""  # noqa: E731
    sse = lambda v: f"""{v}{v}_ - 2*({v}b1*a{v}_ + {v}b2*b{v}_ + {v}b3*c{v}_) + {v}b1*{v}b1*aa_ + {v}b2*{v}b2*bb_ + {v}b3*{v}b3*cc_ + 2*({v}b1*{v}b2*ab_ + {v}b1*{v}b3*ac_ + {v}b2*{v}b3*bc_)"""
    return f"""WITH x AS (SELECT l_orderkey % 5 AS f, 1.0::DOUBLE AS a, l_quantity::DOUBLE AS b, l_discount::DOUBLE AS c, l_extendedprice::DOUBLE AS y, l_tax::DOUBLE AS z FROM lineitem),
o AS (SELECT f, count(*)::DOUBLE AS n, {own} FROM x GROUP BY f), t AS (SELECT {", ".join(f"sum({p}_) AS {p}_" for p in pairs)} FROM o),
g AS (SELECT o.f, alpha, {rest} FROM o, t, (SELECT unnest([1e-5, 1e-3, 1e-1, 10.0, 1000.0]) AS alpha)),
h AS (SELECT *, sqrt(aa_) AS sa, sqrt(bb_) AS sb, sqrt(cc_) AS sc FROM g),
m AS (SELECT f, alpha, sa, sb, sc, ab_/(sa*sb) AS p, ac_/(sa*sc) AS q, bc_/(sb*sc) AS r, 1 + alpha AS d, ay_/sa AS y1, by_/sb AS y2, cy_/sc AS y3, az_/sa AS z1, bz_/sb AS z2, cz_/sc AS z3 FROM h),
s AS (SELECT *, d*(d*d-r*r) - p*(p*d-r*q) + q*(p*r-d*q) AS det FROM m), b AS (SELECT f, alpha, {beta("y")}, {beta("z")} FROM s),
e AS (SELECT alpha, sum({sse("y")} + {sse("z")}) / sum(2 * n) AS v FROM b JOIN o USING (f) GROUP BY alpha)
SELECT alpha::DOUBLE AS alpha, round(v, 0) AS oof_mse, v = min(v) OVER () AS chosen FROM e"""


@query(_ridge_sql())
def ridge_cross_validated(spark, d):
    x = table(spark, d, "lineitem").withColumn("one", F.lit(1.0)).withColumn("fold", F.col("l_orderkey") % 5)
    best, scores = fit.cross_validated_ridge(fit.gram(x, ["one", "l_quantity", "l_discount"], ["l_extendedprice", "l_tax"], "fold"), [1e-5, 1e-3, 1e-1, 10.0, 1000.0])
    return spark.createDataFrame([(a, float(round(s)), a == best) for a, s in scores.items()], "alpha double, oof_mse double, chosen boolean")


@query("""WITH x AS (SELECT l_returnflag AS g, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS x, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS y FROM lineitem)
SELECT round(sum(x * y) / sum(x * x), 4) AS slope FROM x""")
def within_group_slope(spark, d):
    l = table(spark, d, "lineitem")
    # sums per group, then of groups: no window over rows
    x, y = F.col("l_quantity").cast("double"), F.col("l_extendedprice")
    g = l.groupBy("l_returnflag").agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.count("*").alias("n"))
    return g.agg(F.round(F.sum(F.col("c") * F.col("n")) / F.sum(F.col("v") * F.col("n")), 4).alias("slope"))


def _budget_sql():
    return """WITH g AS (SELECT b::DOUBLE AS budget, h::DOUBLE AS context, 1e18 * (6.0 + 0.0002 * h) AS u FROM (SELECT unnest([1e18, 1e20, 1e22]) AS b), (SELECT unnest([2048.0, 4096.0, 8192.0, 32768.0, 131072.0]) AS h)),
n AS (SELECT *, least(greatest(pow(0.33998 * 0.35398 / (0.27988 * 1.24031), 1 / 0.61986) * pow(budget / u, 0.27988 / 0.61986), 0.070542), 11.965825) AS n0 FROM g),
s AS (SELECT *, budget / (u * n0) AS d0 FROM n)
SELECT budget, context, round(CASE WHEN d0 > 299.893 THEN budget / (u * 299.893) ELSE n0 END, 6) AS n, round(least(d0, 299.893), 6) AS d FROM s"""


@query(_budget_sql())
def closed_form_budget(spark, d):
    grid = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    x = spark.range(1).select(grid("budget", [1e18, 1e20, 1e22])).select("*", grid("context", [2048.0, 4096.0, 8192.0, 32768.0, 131072.0]))
    n, dd = allocation.optimum(F.col("budget"), F.col("context"))
    return rounded(x.select("budget", "context", n.alias("n"), dd.alias("d")), "n", "d")


@query()
def budget_solver(spark, d):
    x = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("case_id"), F.lit(1e20).alias("budget"), F.lit(2048.0).alias("context"),
        (F.col("n_regionkey") * 0.1).cast("double").alias("gain"), F.element_at(F.array(F.lit("exp"), F.lit("power"), F.lit("log")), F.col("n_nationkey") % 3 + 1).alias("cost_kind"), F.lit(1.0).alias("cost_scale"))
    return rounded(allocation.solve(x).drop("spent"), "n", "d", "q", "loss")


POISSON = " + ".join(f"(u >= {int(s * (1 << 52))})::INT" for s in bootstrap.STEPS)


@query(f"""WITH c AS (SELECT user_id AS k, sum(value) AS s, count(*)::DOUBLE AS n FROM events WHERE value IS NOT NULL GROUP BY user_id),
x AS (SELECT k, s, n, r, ('0x' || substr(sha256('c1|' || r::VARCHAR || '|' || k::VARCHAR), 1, 13))::UBIGINT AS u FROM c, (SELECT unnest(range(0, 201)) AS r)),
w AS (SELECT r, s, n, CASE WHEN r = 0 THEN 1 ELSE {POISSON} END AS w FROM x), m AS (SELECT r, sum(w * s) / nullif(sum(w * n), 0) AS m FROM w GROUP BY r)
SELECT round(max(m) FILTER (r = 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (r > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (r > 0), 6) AS high FROM m""")
def cluster_bootstrap(spark, d):
    return rounded(bootstrap.cluster_bootstrap_mean(table(spark, d, "events"), "user_id", "value", 200, "c1"), "mean", "low", "high")


@query()
def nls_multistart(spark, d):
    cells = table(spark, d, "lineitem").groupBy((F.floor(F.col("l_quantity") / 5) + 1).alias("n"), (F.floor(F.col("l_discount") * 100) + 1).alias("t")).agg(F.count("*").alias("c"))
    law = allocation.LAW
    y = numeric.power_law(F.col("n").cast("double"), F.col("t").cast("double"), law["e"], law["a"], law["alpha"], law["b"], law["beta"])
    return fit.fit_scaling(cells.withColumn("y", y), "n", "t", "y", 8)


@query("""WITH m AS (SELECT l_returnflag AS target, l_linestatus AS model, count(*) AS complexity, avg(l_tax) AS err, stddev_samp(l_tax) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL),
b AS (SELECT target, arg_min(err + se, (err, complexity, model)) AS top FROM m GROUP BY target) SELECT target, arg_min(model, (complexity, err, model)) AS chosen FROM m JOIN b USING (target) WHERE err <= top GROUP BY target""")
def one_se_selection(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("model")).agg(
        F.count("*").alias("complexity"), F.avg("l_tax").alias("err"), (F.stddev_samp("l_tax") / F.sqrt(F.count("*"))).alias("se"))
    return fit.one_standard_error(m, ["target"], "model", "complexity", "err", "se")


@query("""SELECT 'orders' AS component, o_orderstatus AS name, round(stddev_samp(o_totalprice), 4) AS value FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'lineitem', l_returnflag, round(stddev_samp(l_extendedprice), 4) FROM lineitem GROUP BY l_returnflag""")
def uncertainty_ledger(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.stddev_samp("o_totalprice").alias("sd"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.stddev_samp("l_extendedprice").alias("sd"))
    return rounded(summary.ledger({"orders": a, "lineitem": b}, "sd"), "value", digits=4)


@query("""WITH x AS (SELECT o_custkey, c_acctbal > 0 AS a, o_totalprice > 100000 AS b, o_orderstatus = 'F' AS c FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 0::BIGINT AS step, 'positive' AS gate, count(*) FILTER (a)::BIGINT AS n_rows, count(DISTINCT o_custkey) FILTER (a)::BIGINT AS n_entities FROM x UNION ALL SELECT 1, 'large', count(*) FILTER (a AND b), count(DISTINCT o_custkey) FILTER (a AND b) FROM x
UNION ALL SELECT 2, 'finished', count(*) FILTER (a AND b AND c), count(DISTINCT o_custkey) FILTER (a AND b AND c) FROM x""")
def cohort_flow(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return summary.flow(x, [("positive", F.col("c_acctbal") > 0), ("large", F.col("o_totalprice") > 100000), ("finished", F.col("o_orderstatus") == "F")], "o_custkey")


@query("""SELECT c_mktsegment, c_nationkey, count(c_acctbal)::BIGINT AS n, CASE WHEN count(c_acctbal) >= 5 THEN 'DESCRIBED' ELSE 'TOO_FEW' END AS status,
  CASE WHEN count(c_acctbal) >= 5 THEN round(quantile_cont(c_acctbal, 0.25), 6) END AS p25, CASE WHEN count(c_acctbal) >= 5 THEN round(quantile_cont(c_acctbal, 0.5), 6) END AS p50, CASE WHEN count(c_acctbal) >= 5 THEN round(quantile_cont(c_acctbal, 0.75), 6) END AS p75 FROM customer GROUP BY ALL""")
def strata_description(spark, d):
    return rounded(evaluation.strata(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal"), "p25", "p50", "p75")


@query("""SELECT s_nationkey, h::INTEGER AS horizon_months, round(v + 0.1 * v * h / 12, 4) AS raw, round(least(greatest(v + 0.1 * v * h / 12, 0), 9000), 4) AS clipped, v + 0.1 * v * h / 12 BETWEEN 0 AND 9000 AS in_range
FROM (SELECT s_nationkey, avg(s_acctbal) AS v FROM supplier GROUP BY s_nationkey), (SELECT unnest([12, 24]) AS h)""")
def scenario_forecast(spark, d):
    x = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("v")).withColumn("at", F.lit("2024-01-31").cast("date"))
    f = evaluation.forecast(x, [12, 24], "at", F.col("v"), 0.1 * F.col("v"), 0.0, 9000.0)
    return rounded(f.select("s_nationkey", "horizon_months", "raw", "clipped", "in_range"), "raw", "clipped", digits=4)


@query("""WITH x AS (SELECT l_returnflag AS g, l_suppkey % 7 AS k, l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem),
r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS b FROM x),
c AS (SELECT g, corr(a, b) AS rho FROM r GROUP BY g),
m AS (SELECT g, count(*) AS n, count(DISTINCT k) AS clusters, sqrt(avg((p - y) * (p - y))) AS rmse, avg(p - y) AS bias, stddev_samp(y) AS sd FROM x GROUP BY g)
SELECT g, n::BIGINT AS n, clusters::BIGINT AS clusters, round(rmse, 3) AS rmse, round(rho, 6) AS rho, CASE WHEN n < 5 OR clusters < 2 THEN 'STRESS_ONLY'
  WHEN sd > 0 AND rmse <= 0.25 * sd AND abs(bias) <= 0.25 * sd AND (rho IS NULL OR rho >= 0.5) THEN 'SUPPORTED' ELSE 'FAILED' END AS status FROM m JOIN c USING (g)""")
def external_qualification(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_suppkey") % 7).alias("k"), F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).cast("double").alias("p"))
    return evaluation.qualification(x, ["g"], "y", "p", "k").select("g", "n", "clusters", F.round("rmse", 3).alias("rmse"), r6("rho").alias("rho"), "status")


@query("""WITH x AS (SELECT DISTINCT l_quantity AS q FROM lineitem), l AS (SELECT q, 1.6898 + 0.35398 * pow(q, -0.33998) + 1.24031 * pow(q, -0.27988) AS loss FROM x)
SELECT q::DOUBLE AS q, round(loss, 6) AS loss, round(-0.33998 * 0.35398 * pow(q, -0.33998) / loss, 6) AS e_n, round(-0.27988 * 1.24031 * pow(q, -0.27988) / loss, 6) AS e_d FROM l""")
def loss_sensitivities(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q")).distinct()
    x = x.select("q", *evaluation.loss_sensitivities(F.col("q"), F.col("q"), allocation.LAW))
    return rounded(x.select("q", "loss", "e_n", "e_d"), "loss", "e_n", "e_d")


@query("""WITH c AS (SELECT o_orderpriority AS g, count(*) AS n, count(DISTINCT o_orderdate) AS t, max(o_orderdate) AS last FROM orders GROUP BY g)
SELECT o_orderkey, CASE WHEN n = 1 THEN 'single' WHEN n = t THEN 'latest' ELSE 'all_runs' END AS resolution FROM orders JOIN c ON o_orderpriority = g WHERE n <> t OR o_orderdate = last""")
def duplicate_run_resolution(spark, d):
    return rows.resolved_runs(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_orderkey").select("o_orderkey", "resolution")


@query("""WITH q AS (SELECT l_partkey % 100 AS k, sum(l_quantity) AS s FROM lineitem GROUP BY k) SELECT s AS value, sum(1)::BIGINT AS w, (count(*) FILTER (TRUE) * 0 + (SELECT count(*) FROM q b WHERE b.s < q.s))::BIGINT AS before, (SELECT count(*) FROM q)::BIGINT AS total FROM q GROUP BY s""")
def running_counts(spark, d):
    x = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 100).alias("k")).agg(F.sum("l_quantity").alias("value")).withColumn("one", F.lit(1).cast("long"))
    return ordering.running(x, [], "value", "one").select("value", "w", "before", "total")


@query("""SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+', '[EMAIL]', 'g'), 'https?://[^\\s<>"]+', '[URL]', 'g')) AS redacted FROM conversations""")
def redact_conversations(spark, d):
    return base.texts(spark, d, "conversations").select("conv_id", "turn", F.sha2(texts.redacted(F.coalesce("text", F.lit(""))), 256).alias("redacted"))


@query("""WITH x AS (SELECT a.o_totalprice AS p, CASE WHEN a.o_orderkey % 10 = 0 THEN a.o_totalprice + 0.5 ELSE a.o_totalprice END AS q, a.o_orderstatus AS s, CASE WHEN a.o_orderkey % 7 = 0 THEN NULL ELSE a.o_orderstatus END AS t FROM orders a)
SELECT 'o_totalprice' AS column_name, 'double' AS type_left, 'double' AS type_right, TRUE AS same_type, count(*)::BIGINT AS n_rows, count(*) FILTER (abs(p - q) <= 0.01)::BIGINT AS n_equal, max(abs(p - q)) AS max_abs FROM x
UNION ALL SELECT 'o_orderstatus', 'string', 'string', TRUE, count(*)::BIGINT, count(*) FILTER (s IS NOT DISTINCT FROM t)::BIGINT, NULL FROM x UNION ALL SELECT 'o_orderpriority', 'string', NULL, FALSE, NULL, NULL, NULL""")
def column_compare(spark, d):
    o = table(spark, d, "orders")
    b = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return checks.compare_columns(o.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), b, ["o_orderkey"], 0.01)
