import gzip
import json
import lzma
import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import dates, jsonx, lists, numeric, text
from lumenfold.functions.hashing import split_remainder
from lumenfold.operators import allocation, checks, evaluation, fit, joins, ordering, quality, rows, signals, stats, summary
from lumenfold.sources import readers, sinks
from lumenfold.sources.stages import Stages
from lumenfold.streaming import events
from signal_fixture import fixture

NAN = float("nan")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_clip_and_missing(spark):
    lo, hi = F.lit(0.0), F.lit(2.0)
    for v, want in ((1.0, 0.5), (9.0, 1.0), (-9.0, 0.0), (float("inf"), 1.0), (float("-inf"), 0.0), (NAN, None), (None, None)):
        assert one(spark, numeric.clipped(F.lit(v).cast("double"), lo, hi)) == want
    assert one(spark, numeric.clipped(F.lit(1.0), F.lit(2.0), F.lit(2.0))) is None
    assert one(spark, numeric.skipping_range(F.lit(1.0), F.lit(None).cast("double"), F.lit(4.0))) == 3.0
    assert one(spark, numeric.strict_mean(F.lit(1.0), F.lit(None).cast("double"))) is None
    assert one(spark, numeric.finite(F.lit(NAN))) is None


def test_parsers(spark):
    assert one(spark, numeric.positive_number(F.lit("1,200 "))) == 1200.0
    assert one(spark, numeric.positive_number(F.lit("-3"))) is None
    assert one(spark, numeric.token_amount(F.lit("1e9, 1e9"))) == 1e9
    assert one(spark, numeric.token_amount(F.lit("1e9,2e9"))) is None
    assert one(spark, numeric.is_blank(F.lit(" N/A ")))
    assert one(spark, text.nfkc(F.lit("ﬁ①"))) == "fi1"
    assert one(spark, text.argument(F.lit("a=1,pretrained=x/y,b=2"), "pretrained")) == "x/y"
    rules = [("continuously", "continued"), ("pretrained", "base")]
    assert one(spark, text.classify(F.lit("Continuously pretrained"), rules, "other")) == "continued"


def test_split_rule_is_the_published_one(spark):
    import hashlib

    got = {r.id: r.m for r in spark.range(500).select("id", split_remainder(F.col("id").cast("string")).alias("m")).collect()}
    for i, m in got.items():
        assert m == int(hashlib.sha256(f"20260924{i}".encode()).hexdigest()[:16], 16) % 5


def test_bins_differ_at_the_edge(spark):
    args = ([3.0], ["<=3", ">3"])
    assert one(spark, dates.bin_open_right(F.lit(3.0), *args)) == ">3"
    assert one(spark, dates.bin_closed_right(F.lit(3.0), *args)) == "<=3"


def test_lists(spark):
    a = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    assert one(spark, lists.argmax(a)) == 1
    assert not one(spark, lists.is_valid(F.array(F.lit(1.0), F.lit(NAN)), 2))
    assert one(spark, lists.element_counts(F.array(F.lit(NAN), F.lit(float("inf")), F.lit(None).cast("double")))) == (1, 1, 1, 0)
    assert one(spark, lists.one_hot(F.lit("z"), ["a", "b", "c"])) == [0.0, 0.0]
    assert one(spark, lists.cubic_basis(F.lit(2.0), [1.0])) == [2.0, 4.0, 8.0, 1.0]


def test_penalty_hand_cases(spark):
    p = quality.numeric.ramp
    assert one(spark, p(F.lit(1.5), F.lit(1.0), F.lit(2.0))) == 0.5
    assert one(spark, p(F.lit(1.0), F.lit(1.0), F.lit(2.0))) == 0 and one(spark, p(F.lit(7.0), F.lit(1.0), F.lit(2.0))) == 1
    assert math.isclose(one(spark, quality.candidate(F.lit(0.8), F.lit(0.5), F.lit(0.5), 0.02)), 0.792)
    assert one(spark, quality.candidate(F.lit(0.8), F.lit(0.5), F.lit(0.5), 0.0)) == 0.8


def test_signal_fixture(spark):
    x = signals.identified(signals.features(fixture(spark)), "code", "line", "file_domain").cache()
    assert x.count() == 660
    cal = {r.domain: r.n for r in x.where("role = 'calibration'").groupBy("domain").agg(F.count("*").alias("n")).collect()}
    assert cal == {"commoncrawl": 164, "wikipedia": 160, "github": 160}
    limits = signals.bounds(x)
    assert np.allclose(limits["fineweb_edu"], (0.2, 3.15)) and all(np.allclose(limits[c], (-3, 3)) for c in signals.RATED)
    s = signals.scored(x, limits)
    r = s.agg(F.count("q").alias("n"), F.avg("q").alias("m"), F.avg("disagreement_range").alias("d"), F.count_if(F.col("disagreement_range") > 0.5).alias("k")).first()
    assert r.n == 658 and math.isclose(r.m, 0.5640327076857911, abs_tol=1e-12)
    assert math.isclose(r.d, 0.3245284197911316, abs_tol=1e-12) and r.k == 118
    per = {(r.code, r.domain): (r.n, r.m) for r in s.groupBy("code", "domain").agg(F.count("q").alias("n"), F.avg("q").alias("m")).collect()}
    want = {(0, "commoncrawl"): (199, 0.564143252357), (0, "wikipedia"): (200, 0.563622410546), (0, "github"): (200, 0.563622410546),
            (1, "arxiv"): (30, 0.566786566227), (2, "github"): (29, 0.566084594238)}
    for k, (n, m) in want.items():
        assert per[k][0] == n and math.isclose(per[k][1], m, abs_tol=1e-11)
    med = quality.imputed(s, "norm_modernbert_professionalism", "domain")
    got = med.where("norm_modernbert_professionalism IS NULL").select("norm_modernbert_professionalism_imputed").collect()
    assert [round(r[0], 12) for r in got] == [0.6, 0.6]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partitioning_does_not_matter(spark, parts):
    x = spark.range(400).select((F.col("id") * 7919 % 101).cast("double").alias("v"), (F.col("id") % 3).alias("g"), F.lit(1.0).alias("w"), "id").repartition(parts)
    v = sorted(i * 7919 % 101 for i in range(400))
    r = ordering.running(x, [], "v", "w").orderBy("v").collect()
    assert [int(q.before) for q in r] == [sum(u < q.v for u in v) for q in r]
    q = stats.weighted_quantiles(x, [], "v", "w", {"q": 0.5}).first().q
    assert math.isclose(q, np.median(v), abs_tol=1.0)
    first = rows.first_seen(x, ["g"], ["id"]).where("is_first").orderBy("g").collect()
    assert [f.id for f in first] == [0, 1, 2]


def test_spearman_and_distances(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 200).astype(float), rng.integers(0, 9, 200).astype(float)
    d = spark.createDataFrame([(float(x), float(y), "a" if i % 2 else "b") for i, (x, y) in enumerate(zip(a, b, strict=True))], "x double, y double, s string")

    def ranks(v):
        return np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])

    rho = stats.spearman(d, [], "x", "y").first().rho
    assert math.isclose(rho, np.corrcoef(ranks(a), ranks(b))[0, 1], abs_tol=1e-12)
    g = stats.two_sample(d, "s", "a", "b", "x").first()
    u, v = a[1::2], a[::2]
    grid = np.unique(a)
    gap = np.array([(u <= t).mean() - (v <= t).mean() for t in grid])
    assert math.isclose(g.ks, np.abs(gap).max(), abs_tol=1e-12)
    assert math.isclose(g.w1, (np.abs(gap[:-1]) * np.diff(grid)).sum(), abs_tol=1e-12)
    m = stats.mann_whitney(d, "s", "a", "b", "x").first()
    assert math.isclose(m.u, sum((p > q) + 0.5 * (p == q) for p in u for q in v))


def test_small_tests():
    odds, p = stats.fisher_exact(8, 2, 1, 5)
    assert odds == 20 and math.isclose(p, 0.03496503496503495, rel_tol=1e-9)
    assert math.isclose(stats.pearson_p(0.5, 10), 0.14111328125, rel_tol=1e-6)


def test_guards_and_checks(spark):
    x = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    y = spark.createDataFrame([(1, "p"), (2, "q")], "k int, w string")
    assert joins.guarded(x, y, ["k"]).count() == 3
    with pytest.raises(checks.CardinalityError):
        joins.guarded(x, y, ["k"], validate="one_to_one")
    assert checks.repeated_keys(x, ["k"]).collect() == [(1, 2)]
    a = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    b = spark.createDataFrame([("q", "3"), ("r", "4")], "path string, sha256 string")
    assert sorted(map(tuple, checks.manifest_difference(a, b).collect())) == [("p", "missing"), ("q", "changed"), ("r", "extra")]
    s = checks.Seal()
    s.step("calibration")
    s.freeze(b"x")
    s.check(b"x")
    with pytest.raises(ValueError):
        s.check(b"y")
    with pytest.raises(ValueError):
        s.step("extension")


def test_as_of_clamps(spark):
    st = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0)], "g string, t int, v double")
    r = spark.createDataFrame([("a", 5), ("a", 10), ("a", 19), ("a", 99), ("b", 1)], "g string, at int")
    got = {(x.g, x.at): x.v for x in joins.as_of(r, ["g"], "at", st, "t", "v").collect()}
    assert got == {("a", 5): 1.0, ("a", 10): 1.0, ("a", 19): 1.0, ("a", 99): 2.0, ("b", 1): None}


def test_fits_recover_planted_values(spark):
    rng = np.random.default_rng(3)
    n, d = np.meshgrid([0.1, 0.5, 1, 3, 10], [1, 5, 20, 80, 300])
    n, d = n.ravel(), d.ravel()
    law = allocation.LAW
    y = law["e"] + law["a"] * n ** -law["alpha"] + law["b"] * d ** -law["beta"]
    low, high = fit.SCALING_BOUNDS
    best = min((fit.levenberg(fit.scaling_residual(n, d, y), s, low, high) for s in low + fit.halton(6, 5) * (high - low)), key=lambda t: t[1])
    assert np.allclose(np.exp(best[0]), [law[k] for k in ("e", "a", "alpha", "b", "beta")], rtol=1e-4)
    pr = fit.profile(fit.scaling_residual(n, d, y + rng.normal(0, 1e-3, len(y))), best[0], 0, low, high, 5)
    assert pr.sse.min() > 0
    x = np.c_[np.ones(400), rng.normal(size=400)]
    z = x @ [1.0, 2.0] + rng.normal(size=400)
    assert np.allclose(fit.quantile_regression(x, z, 0.5), [1, 2], atol=0.2) and np.allclose(fit.huber_regression(x, z), [1, 2], atol=0.2)
    e = fit.leave_one_out(x, z)
    k = np.linalg.lstsq(np.delete(x, 3, 0), np.delete(z, 3), rcond=None)[0]
    assert math.isclose(e[3], z[3] - x[3] @ k, abs_tol=1e-9)
    assert fit.identifiable(x[:2]) == "NOT_IDENTIFIABLE" and fit.identifiable(x) == "OK"
    assert fit.column_space_share(x, x[:, 1])[1] < 1e-9


def test_budget_goldens(spark):
    c = spark.createDataFrame([(0, 1e18, 2048.0), (1, 1e20, 2048.0), (2, 1e22, 2048.0), (3, 1e18, 32768.0)], "i int, b double, h double")
    n, d = allocation.optimum(F.col("b"), F.col("h"))
    got = {r.i: (r.n, r.d) for r in c.select("i", n.alias("n"), d.alias("d")).collect()}
    # Published optima of the frozen law, whose constants are known to five digits.
    assert math.isclose(got[0][0], 0.078248576, rel_tol=5e-5) and math.isclose(got[1][0], 0.6259227, rel_tol=5e-5)
    assert math.isclose(got[2][0], 5.202388053, rel_tol=5e-5) and got[2][1] == 299.893
    assert got[3][0] == allocation.N_RANGE[0] and math.isclose(got[3][1], 1.129233998, rel_tol=5e-5)
    cases = spark.createDataFrame([(0, 1e20, 2048.0, 0.0, "exp", 1.0)], "case_id long, budget double, context double, gain double, cost_kind string, cost_scale double")
    r = allocation.solve(cases).first()
    assert math.isclose(r.n, got[1][0], rel_tol=1e-4) and r.q == 0.6
    assert [one(spark, allocation.equal_quantile(F.lit(v), [0.2, 0.1, 0.3])) for v in (0.01, 0.34, 1.0)] == [0.1, 0.2, 0.3]


def test_status_labels(spark):
    g = summary.gate_status
    t, f, u = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert [one(spark, g(*x)) for x in ((t, t), (t, f), (t, u), (f, u))] == ["PASS", "FAIL", "INSUFFICIENT", "FAIL"]
    few = spark.createDataFrame([("a", 0.1)], "family string, growth double")
    r = evaluation.growth_rate(few, "family", assumed=0.4).first()
    assert r.status == "NOT_IDENTIFIABLE" and r.rate == 0.4
    up = spark.createDataFrame([("m", "p1", 0.1, 0.1, 1.0), ("m", "p2", 0.06, 0.05, 0.9), ("k", "p1", 0.1, 0.1, 1.0)], "m string, protocol string, mean_gain double, q90_gain double, sign_share double")
    assert {x.m: x.decision for x in evaluation.upgrade_gate(up, ["m"]).collect()} == {"m": "UPGRADE", "k": "KEEP"}


def test_sources_and_sinks(spark, tmp_path):
    lines = [json.dumps({"a": i, "b": [1.0, i]}) for i in range(5)] + ["{broken"]
    with lzma.open(tmp_path / "x.jsonl.xz", "wt") as f:
        f.write("\n".join(lines))
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

    schema = StructType().add("a", LongType()).add("b", ArrayType(DoubleType()))
    got = readers.parsed(readers.xz_lines(spark, str(tmp_path / "*.xz")), schema)
    assert got.where("NOT bad").count() == 5 and got.where("bad").first().line_no == 6
    spark.dataSource.register(readers.XzSource)
    assert spark.read.format("xzlines").load(str(tmp_path / "*.xz")).count() == 6
    j = readers.json_lines(spark, str(tmp_path / "x.jsonl.gz"), schema)
    assert sum(r._corrupt is None for r in j.collect()) == 5
    with pytest.raises(Exception, match=r"(?i)malformed|corrupt"):
        readers.json_lines(spark, str(tmp_path / "x.jsonl.gz"), schema, strict=True).collect()
    (tmp_path / "docs").mkdir()
    for name, body in (("ok.json", '{"results": {"t": {"acc,none": "0.5", "acc_stderr,none": 0.1, "alias": "t"}}}'), ("cut.json", '{"a": [1, 2'), ("bad.json", '{"a" 1}')):
        (tmp_path / "docs" / name).write_text(body)
    log = {r.file_name: r.status for r in readers.json_documents(spark, str(tmp_path / "docs")).collect()}
    assert log == {"ok.json": "ok", "cut.json": "truncated", "bad.json": "malformed"}
    m = jsonx.long_metrics(readers.json_documents(spark, str(tmp_path / "docs")).where("status = 'ok'"), "file_name", "text").collect()
    assert [(r.metric, r.value, r.stderr) for r in m] == [("acc,none", 0.5, 0.1)]
    assert readers.manifest(spark, str(tmp_path / "docs")).count() == 3
    df = spark.createDataFrame([(1, NAN), (2, 0.1)], "k int, v double")
    sinks.json_rows(df, str(tmp_path / "j"))
    assert sorted(spark.read.text(str(tmp_path / "j")).toPandas()["value"]) == ['{"k":1,"v":null}', '{"k":2,"v":0.1}']
    sinks.parquet(df.withColumn("evaluation_role", F.lit("holdout")), str(tmp_path / "p"), ["k", "v", "evaluation_role"], ["evaluation_role"])
    assert readers.parquet_role(spark, str(tmp_path / "p"), ["holdout"]).count() == 2
    sinks.report_csv(df, str(tmp_path / "c"), ["k", "v"])
    assert readers.csv(spark, str(tmp_path / "c"), "k int, v double", ["v"]).where("v = 0.1").count() == 1
    assert readers.csv_union(spark, str(tmp_path / "c"), "k int, v double").columns == ["k", "v", "file_name"]
    e = sinks.EventLog(str(tmp_path / "log"))
    e.add("s00", n=1)
    e.add("s01")
    assert len((tmp_path / "log").read_text().splitlines()) == 2
    (tmp_path / "old.txt").write_bytes("甲,x|y,3\nskip\n".encode("gb18030"))
    old = readers.legacy_table(spark, str(tmp_path / "old.txt"), r"^([^,]+),(.*),(\d+)$", ["a", "b", "c"]).collect()
    assert [tuple(r) for r in old] == [("甲", "x|y", "3")]


def test_stages_are_reused_only_as_they_were(spark, tmp_path):
    s = Stages(spark, str(tmp_path))
    a = s.identity("t", ["in"], {"k": 1}, "code")
    assert s.verdict("t", a) == "NOT_STARTED"
    assert s.run("t", a, lambda: spark.range(3)).count() == 3
    assert s.verdict("t", a) == "REUSABLE" and s.run("t", a, lambda: 1 / 0).count() == 3
    with pytest.raises(ValueError):
        s.run("t", s.identity("t", ["in"], {"k": 2}, "code"), lambda: spark.range(1))


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(src))
    events.run_once(events.first_seen(events.read_events(spark, str(src)), ["user_id", "event_type"], "400 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = spark.read.parquet(str(src)).select("user_id", "event_type").distinct().count()
    assert spark.read.parquet(str(tmp_path / "o")).count() == batch
    events.run_once(events.windowed(events.read_events(spark, str(src)), "1 day", "1 second"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    got = spark.read.parquet(str(tmp_path / "o2"))
    whole = spark.read.parquet(str(src)).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert got.join(whole, ["window", "event_type", "n"]).count() == got.count() > 0


# ---- order in buckets

def ordered_rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        g = ("a", "b", None)[int(rng.integers(3))]
        v = None if rng.random() < 0.05 else float(rng.choice([0.5, 0.5, 0.5, rng.normal()]))
        rows.append((g, int(i), v, float(rng.integers(0, 4))))
    return rows + [("only", 10_000, None, 0.0)]


def test_ranks_quantiles_and_carries_equal_plain_python(spark):
    rows = ordered_rows()
    d = spark.createDataFrame(rows, "g string, k long, v double, w double").repartition(5)
    groups = {g: sorted((r for r in rows if r[0] == g), key=lambda r: r[1]) for g in ("a", "b", None, "only")}
    for descending in (False, True):
        got = {r.k: r.place for r in ordering.row_ranks(d.where("v IS NOT NULL"), ["g"], "v", "k", "place", descending).collect()}
        for part in groups.values():
            order = sorted((r for r in part if r[2] is not None), key=lambda r: (-r[2] if descending else r[2], r[1]))
            assert all(got[r[1]] == i for i, r in enumerate(order, 1))
    q = {r.g: (r.p10, r.p50, r.p99) for r in ordering.quantiles(d, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    t = {r.g: r.p50 for r in ordering.quantiles(d, ["g"], "v", {"p50": 0.5}, "w").collect()}
    for g in ("a", "b", None):
        v = [r[2] for r in groups[g] if r[2] is not None]
        assert np.allclose(q[g], np.quantile(v, [0.1, 0.5, 0.99]))
        assert np.isclose(t[g], np.quantile(np.repeat(v, [int(r[3]) for r in groups[g] if r[2] is not None]), 0.5))
    assert "only" not in q and ordering.quantiles(d.limit(0), ["g"], "v", {"p": 0.5}).count() == 0
    assert [r.p for r in ordering.quantiles(d.limit(0), [], "v", {"p": 0.5}).collect()] == [None]  # as SQL has it
    for before in (False, True):
        got = {r.k: r.last for r in ordering.carried(d, ["g"], F.col("k"), ["k"], "k", "v", "last", before).collect()}
        for part in groups.values():
            last = None
            for r in part:
                if before:
                    assert got[r[1]] == last
                last = r[2] if r[2] is not None else last
                if not before:
                    assert got[r[1]] == last


def test_running_totals_of_many_values_agree(spark):
    d = spark.range(60_000, numPartitions=40).select((F.col("id") % 2).alias("g"), (F.sin(F.col("id").cast("double")) * 100).alias("v"), F.lit(1).alias("one"))
    for by in ([], ["g"]):
        r = ordering.running(d, by, "v", "one")
        g = r.groupBy(*by).agg(F.sum("w").alias("n"), F.max("total").alias("t"), F.max(F.col("before") + F.col("w")).alias("last"), F.countDistinct("before").alias("places"), F.count("*").alias("values"))
        assert all(x.n == x.t == x.last and x.places == x["values"] for x in g.collect())
    got = stats.conformal(d, [], "v").first()
    v = np.sort(np.sin(np.arange(60_000.0)) * 100)
    assert math.isclose(got.conformal_q, v[57_001], rel_tol=1e-12)


def test_late_dates_and_positional_rows(spark):
    d = spark.createDataFrame([(i, f"2024-01-{1 + i % 10:02d}") for i in range(40)] + [(99, None)], "i long, t string").withColumn("t", F.to_date("t"))
    got = rows.late_dates(d, "t").collect()
    assert {str(r.cut_date) for r in got} == {"2024-01-08"}  # place floor(0.8 * 9) of ten dates
    assert {r.i: r.is_late for r in got}[99] is None
    with pytest.raises(ValueError):
        joins.positional(d.select("i"), d.where("i < 39").select("i"), "i", ["i"])


# ---- fits by sums

def test_ladder_orders_few_residuals(spark, monkeypatch):
    made, write = {}, fit.written

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(fit, "written", counted)
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, 4000), rng.normal(0, 1, 4000)
    t = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(3)
    got = fit.ladder(t, "y", {"L": ["x"]}).first()
    rest = np.abs(fit.leave_one_out(np.c_[np.ones(4000), x], y))
    assert math.isclose(got.half_width, np.quantile(rest, math.ceil(4001 * 0.95) / 4000, method="higher"), rel_tol=1e-9)
    assert 0 < made["ladder-values"] < 100


def test_ladder_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n = 200
    loss, size, dd, time = rng.normal(2, 0.3, n), rng.normal(1, 1, n), rng.normal(4, 1, n), rng.normal(0, 30, n)
    family = rng.choice(["x", "y", "z"], n)
    y = 50 - 9 * loss + 3 * size + (family == "y") * 2 + rng.normal(0, 1, n)
    data = [(float(a), float(b), float(c), float(d), float(e), str(f)) for a, b, c, d, e, f in zip(y, loss, size, dd, time, family, strict=True)]
    data += [(None, 1.0, 1.0, 1.0, 1.0, "x"), (1.0, float("nan"), 1.0, 1.0, 1.0, "x")]
    t = spark.createDataFrame(data, "y double, loss double, n double, d double, t double, f string").repartition(3)
    got = {r.candidate: r for r in fit.candidate_ladder(t, "y", "loss", "n", "d", "t", "f", ["x", "y", "z"]).collect()}
    assert len(got) == 9 and all(r.status == "OK" for r in got.values())
    fam = np.c_[family == "y", family == "z"].astype(float)
    u = (size - min(size.min(), 1.0)) / (max(size.max(), 1.0) - min(size.min(), 1.0))
    spline = np.c_[(1 - u) ** 3, 3 * u * (1 - u) ** 2, 3 * u**2 * (1 - u)]
    designs = {
        "LOSS_SIZE_FAMILY_TIME": np.c_[loss, size, fam, time], "LOSS_SIZE_LOG_D": np.c_[loss, size, dd], "LOSS_SIZE_FAMILY_TIME_SPLINE_DF4": np.c_[spline, loss, time, fam], "LOSS_SIZE_LINEAR": np.c_[loss, size],
    }
    for k, x in designs.items():
        x = np.c_[np.ones(n), x]
        rest = fit.leave_one_out(x, y)
        level = min(1.0, math.ceil((n + 1) * 0.95) / n)
        assert math.isclose(got[k].loo_rmse, math.sqrt(np.mean(rest**2)), rel_tol=1e-6), k
        assert math.isclose(got[k].half_width, np.quantile(np.abs(rest), level, method="higher"), rel_tol=1e-6)
    assert got["LOSS_MONOTONE"].rmse < got["CONSTANT"].rmse and got["LOSS_MONOTONE"].half_width > 0
    few = {r.candidate: r.status for r in fit.ladder(t.limit(2), "y", {"CONSTANT": [], "L": ["loss"]}).collect()}
    assert few == {"CONSTANT": "TOO_FEW", "L": "TOO_FEW"}
    same = fit.ladder(t.withColumn("copy", F.col("loss")), "y", {"TWICE": ["loss", "copy"]}).first()
    assert same.status == "NOT_IDENTIFIABLE" and same.rmse is None


def test_robust_regressions_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = np.c_[np.ones(500), rng.normal(size=500)]
    y = x @ [1.0, 2.0] + rng.standard_t(3, 500)
    t = spark.createDataFrame([(1.0, float(a), float(b)) for a, b in zip(x[:, 1], y, strict=True)], "one double, x double, y double").repartition(3)
    got = {r.kind: r for r in fit.robust_regressions(t, ["one", "x"], "y").collect()}
    assert np.allclose(got["ols"].coefficients, np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(got["huber"].coefficients, [1, 2], atol=0.2)
    below = np.mean(y <= x @ np.array(got["quantile"].coefficients))
    assert abs(below - 0.9) < 0.02
    assert {r.status for r in fit.robust_regressions(t.limit(2), ["one", "x"], "y").collect()} == {"NOT_IDENTIFIABLE"}
    s = fit.column_space(t.withColumn("q", 2 * F.col("x") + 1), ["x"], "q").first()
    assert s.rank == 2 and s.outside < 1e-9


def test_configurations_recover_the_law(spark):
    law = allocation.LAW
    data = [(n, d, law["e"] + law["a"] * n ** -law["alpha"] + law["b"] * d ** -law["beta"]) for n in (0.1, 0.5, 1.0, 5.0) for d in (1.0, 4.0, 16.0, 64.0, 200.0, 290.0)]
    got = fit.compare_configurations(spark.createDataFrame(data, "n double, d double, y double"), "n", "d", "y").collect()
    assert len(got) == 4 and sum(r.chosen for r in got) == 1 and all(r.score < 0.01 for r in got)
    with pytest.raises(ValueError):
        fit.cell_table(spark.range(10), ["id"], most=9)


def test_nested_choice_never_sees_its_fold(spark):
    rng = np.random.default_rng(7)
    x = np.c_[np.ones(300), rng.normal(size=(300, 2))]
    y = (x @ [1.0, 0.5, 0.0])[:, None] + rng.normal(size=(300, 1))
    f = np.arange(300) % 5
    folds = {k: (x[f == k].T @ x[f == k], x[f == k].T @ y[f == k], y[f == k].T @ y[f == k], int((f == k).sum())) for k in range(5)}
    alphas = [1e-3, 1.0, 100.0]
    for name, k, alpha, sse, n in fit.nested_ridge(folds, {"all": [0, 1, 2], "two": [0, 1]}, alphas):
        cols = [0, 1, 2] if name == "all" else [0, 1]
        inner = {}
        for a in alphas:
            inner[a] = 0.0
            for j in range(5):
                if j != k:
                    m = (f != k) & (f != j)
                    b = fit.ridge(x[m][:, cols].T @ x[m][:, cols], x[m][:, cols].T @ y[m], a)
                    inner[a] += float(((y[f == j] - x[f == j][:, cols] @ b) ** 2).sum())
        assert alpha == min(inner, key=inner.get)
        b = fit.ridge(x[f != k][:, cols].T @ x[f != k][:, cols], x[f != k][:, cols].T @ y[f != k], alpha)
        assert math.isclose(sse, float(((y[f == k] - x[f == k][:, cols] @ b) ** 2).sum()), rel_tol=1e-9) and n == 60


def test_validation_statuses(spark):
    data = [("ok", i % 3, float(i), float(i) + 0.1) for i in range(20)] + [("few", 0, 1.0, 1.0)] + [("bad", i % 2, float(i), float(-i)) for i in range(9)] + [("flat", i % 2, 3.0, 3.0) for i in range(6)] + [("ok", 1, None, 2.0)]
    got = {r.g: r.status for r in evaluation.qualification(spark.createDataFrame(data, "g string, c int, y double, p double"), ["g"], "y", "p", "c").collect()}
    assert got == {"ok": "SUPPORTED", "few": "STRESS_ONLY", "bad": "FAILED", "flat": "FAILED"}
    x = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0)], "v double")
    s = spark.createDataFrame([(i / 8,) for i in range(1, 9)], "s double")
    got = {r.v: (r.level, r.status, r.usable) for r in allocation.quantile_bridge(x, "v", s, "s", [0.1, 0.2, 0.3, 0.4]).collect()}
    assert got[0.5] == (0.2, "IN_SUPPORT", True) and got[1.0] == (0.4, "IN_SUPPORT", True)
    assert got[-1.0] == (0.1, "OUT_OF_SUPPORT_LOW", False) and got[2.0] == (0.4, "OUT_OF_SUPPORT_HIGH", False)


def test_role_leaks_and_nested_nan(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "i int, evaluation_role string")
    d.write.parquet(str(tmp_path / "roles"))
    assert [r.i for r in readers.parquet_role(spark, str(tmp_path / "roles"), ["a"]).collect()] == [1]
    nan = float("nan")
    n = spark.createDataFrame([([1.0, nan], {"k": float("inf")}, (nan, [nan]))], "a array<double>, m map<string,double>, s struct<x:double,y:array<double>>")
    sinks.json_rows(n, str(tmp_path / "nested"))
    (line,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "nested")).collect()]
    assert line == {"a": [1.0, None], "m": {"k": None}, "s": {"x": None, "y": [None]}}
    sinks.report_csv(spark.createDataFrame([(1, 0.1), (2, 1e300)], "i int, x double"), str(tmp_path / "marked"), ["i", "x"], byte_order_mark=True)
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(map(str, (tmp_path / "marked").glob("part-*"))))
    head, *cells = text.splitlines()
    assert head == "\ufeffi,x" and [float(c.split(",")[1]) for c in cells] == [0.1, 1e300]  # 17 digits read back as they were


def test_written_tables_need_a_shared_folder(spark, monkeypatch):
    from lumenfold.operators import store

    with store.scratch(spark) as keep:
        a, b = store.written(spark.range(3), "a"), keep(store.written(spark.range(4), "b"))
        assert a.count() == 3
    assert b.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(a._written_to).count()


def test_sobol_points_fill_the_cube():
    x = fit.sobol(64, 7)
    for j in range(7):  # each of 64 equal cells of a side holds one point
        assert sorted((x[:, j] * 64).astype(int)) == list(range(64))
    for i in range(7):  # pairs of sides: 8 x 8 cells hold one each in the first two dimensions, all are near that
        for j in range(i):
            cells = len(set(zip((x[:, i] * 8).astype(int), (x[:, j] * 8).astype(int), strict=True)))
            assert cells == 64 if (i, j) == (1, 0) else cells >= 32
    assert not np.allclose(fit.sobol(8, 3, 1), fit.sobol(8, 3, 2)) and np.allclose(fit.sobol(8, 3, 1), fit.sobol(8, 3, 1))


def test_frozen_scale_fit_finds_the_law(spark):
    law = allocation.LAW
    data = [(n, d, law["e"] + law["a"] * n ** -law["alpha"] + law["b"] * d ** -law["beta"]) for n in (0.1, 0.5, 1.0, 3.0, 10.0) for d in (1.0, 5.0, 20.0, 80.0, 300.0)]
    fits = fit.frozen_scale_fit(spark.createDataFrame(data, "n double, d double, y double"), "n", "d", "y", 7).cache()
    s = fit.fit_summary(fits).first()
    assert fits.count() == 7 and s.cost < 1e-10 and s.rank == 5 and not s.near_bound
    assert math.isclose(s.alpha, law["alpha"], rel_tol=1e-2) and math.isclose(s.beta, law["beta"], rel_tol=1e-2)
    two = spark.createDataFrame([(0, True, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5, 1.0, False), (1, True, 1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 5, 1.0, False)], fit.FROZEN)
    assert fit.fit_summary(two).first().unseparated and not fit.fit_summary(two.limit(1)).first().unseparated


def test_budget_scenarios_against_a_grid(spark):
    law, top = allocation.LAW, allocation.D_MAX
    rows_ = [(i, 1e20, 2048.0, gain, kind, 1.0, effect) for i, (gain, kind, effect) in enumerate([(0.0, "exp", "additive"), (0.3, "power", "additive"), (0.8, "log", "tokens"), (5.0, "exp", "tokens")])]
    rows_.append((9, 1e23, 2048.0, 0.1, "exp", 1.0, "additive"))
    got = {r.case_id: r for r in allocation.solve(spark.createDataFrame(rows_, "case_id long, budget double, context double, gain double, cost_kind string, cost_scale double, effect string")).collect()}
    g = {"exp": lambda q: np.exp(q) - 1, "power": lambda q: q * q, "log": np.log1p}
    for i, budget, context, gain, kind, _, effect in rows_:
        n, q = np.meshgrid(np.geomspace(*allocation.N_RANGE, 400), np.linspace(0.6, 1, 81))
        unit = 1e18 * ((6 + allocation.ETA * context) * n + g[kind](q) - g[kind](0.6))
        d = np.minimum(budget / unit, top)
        worth = d * np.exp(gain * (q - 0.6)) if effect == "tokens" else d
        loss = law["e"] + law["a"] * n ** -law["alpha"] + law["b"] * worth ** -law["beta"] - (gain * (q - 0.6) if effect == "additive" else 0)
        assert got[i].loss <= loss.min() + 1e-6 and got[i].spent <= budget * (1 + 1e-9)
    assert got[9].d == top and got[9].spent < 1e23


def test_markdown_reports(spark):
    d = spark.createDataFrame([(1, "a|b"), (2, None)], "i int, t string")
    assert sinks.markdown(d, ["i", "t"]) == "| i | t |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5).select(F.col("id").alias("i")), ["i"], most=3)
