"""Statistics on tables: quantiles, ranks, distances, errors and tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import bucket_count, carried, row_ranks, running
from .store import written


def conformal(df: DataFrame, by: list[str], value: str, coverage: float = 0.95) -> DataFrame:
    """The order statistic at level min(1, ceil((n + 1) * coverage) / n), method higher."""
    x = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1))
    r = running(x, by, value, "_one")
    level = F.least(F.lit(1.0), F.ceil((F.col("total") + 1) * F.lit(coverage)) / F.col("total"))
    # position ceil(level * (n - 1)) from 0 lies in the run of equal values that covers it
    place = F.ceil(F.round(level * (F.col("total") - 1), 9))
    hit = r.where((F.col("before") <= place) & (place < F.col("before") + F.col("w")))
    return hit.select(*by, F.col("total").cast("long").alias("n"), F.col(value).alias("conformal_q"))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, shares: dict[str, float], unit: str | None = None) -> DataFrame:
    """Midpoint positions (cumw - w/2)/W of rows with linear interpolation, clamped at the ends; a column per share.

    Rows of equal value stand in the order of their weight.  unit: where a row of df stands
    for several, the weight of one of them.
    """
    one = F.col(unit or weight)
    r = running(df.where(F.col(value).isNotNull()), by, value, weight, extra=(F.min(one).alias("_first"), F.max(one).alias("_last")))
    # between the first and the last row of a value the quantile is that value
    first = (F.col("before") + F.col("_first") / 2) / F.col("total")
    last = (F.col("before") + F.col("w") - F.col("_last") / 2) / F.col("total")
    v = F.col(value).cast("double").alias("_v")
    ends = F.array(F.struct(first.alias("_p"), v), F.struct(last.alias("_p"), v))
    r = r.select(*by, F.inline(ends))
    aggs = []
    for name, share in shares.items():
        aggs += [
            F.max(F.when(F.col("_p") <= F.lit(share), F.struct("_p", "_v"))).alias(f"{name}_a"),
            F.min(F.when(F.col("_p") >= F.lit(share), F.struct("_p", "_v"))).alias(f"{name}_b"),
        ]
    x = r.groupBy(*by).agg(*aggs)

    def between(name, share):
        lo, hi = F.col(f"{name}_a"), F.col(f"{name}_b")
        gap = hi["_p"] - lo["_p"]
        inner = F.when(gap == 0, lo["_v"]).otherwise(lo["_v"] + (hi["_v"] - lo["_v"]) * (F.lit(share) - lo["_p"]) / F.when(gap != 0, gap))
        return F.when(lo.isNull(), hi["_v"]).when(hi.isNull(), lo["_v"]).otherwise(inner).alias(name)

    return x.select(*by, *[between(k, v) for k, v in shares.items()])


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of rows that have both; NULL where a side does not vary (the built-in divides by zero there)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.when(spread > 0, spread))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the average rank of a value in its group (ties share the mean)."""
    r = running(df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1)), by, value, "_one")
    ranks = r.select(*by, value, (F.col("before") + (F.col("w") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value], "left")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Average-rank Spearman; NULL where a side does not vary."""
    # written: ranks meet their rows by value, and a sum of doubles differs in its last bits from one evaluation to the next
    d = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), "rank-rows")
    d = average_ranks(average_ranks(d, by, x, "_rx"), by, y, "_ry")
    agg = [F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho")]
    out = d.groupBy(*by).agg(*agg) if by else d.agg(*agg)
    return out.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


def _paired_ranks(df: DataFrame, by: list[str], key: str, columns: list[str]) -> DataFrame:
    """by, key, _n (rows of the group) and _r_<column>: places by score descending, key ascending, all in one order."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("_variant"), F.col(c).cast("double").alias("_score")) for c in columns]))
    x = row_ranks(df.select(*by, key, rows), [*by, "_variant"], "_score", key, "_rank", descending=True)
    x = x.groupBy(*by, key).agg(*[F.max(F.when(F.col("_variant") == c, F.col("_rank"))).alias(f"_r_{c}") for c in columns])
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))  # a row per group
    return x.join(sizes, by) if by else x.crossJoin(F.broadcast(sizes))


def _top(share: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(share).cast("decimal(10,4)") * F.col("_n")))


def rank_agreement(df: DataFrame, by: list[str], key: str, a: str, b: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) on ranks without ties (score descending, key ascending)."""
    x = _paired_ranks(df, by, key, [a, b]).withColumn("_d", F.col(f"_r_{a}") - F.col(f"_r_{b}"))
    return x.groupBy(*by).agg(F.count("*").alias("n"), rank_correlation(F.col("_d")).alias("rho"))


def rank_correlation(d: Column) -> Column:
    n, s = F.count("*").cast("double"), F.sum((d * d).cast("double"))
    return F.when(n > 1, 1 - 6 * s / F.when(n > 1, n * (n * n - 1)))


def top_share_jaccard(df: DataFrame, by: list[str], key: str, a: str, b: str, share: str = "0.1") -> DataFrame:
    """n_top, n_both and Jaccard of the top ceil(share * n) rows by two scores (ties by key)."""
    x = _paired_ranks(df, by, key, [a, b]).withColumns({"_a": F.col(f"_r_{a}") <= _top(share), "_b": F.col(f"_r_{b}") <= _top(share)})
    x = x.groupBy(*by).agg(
        F.count_if("_a").alias("n_top"), F.count_if(F.col("_a") & F.col("_b")).alias("n_both"), F.count_if(F.col("_a") | F.col("_b")).alias("_u")
    )
    return x.withColumn("jaccard", F.col("n_both") / F.col("_u")).drop("_u")


def rank_grid(df: DataFrame, by: list[str], key: str, base: str, others: dict[str, str], share: str = "0.1") -> DataFrame:
    """variant, n, rho, jaccard of several scores against one: the rows are read and dealt once."""
    x = _paired_ranks(df, by, key, [base, *others.values()])
    aggs = [F.count("*").alias("n")]
    for k, c in others.items():
        a, b = F.col(f"_r_{base}") <= _top(share), F.col(f"_r_{c}") <= _top(share)
        aggs += [rank_correlation(F.col(f"_r_{base}") - F.col(f"_r_{c}")).alias(f"rho_{k}"), (F.count_if(a & b) / F.count_if(a | b)).alias(f"j_{k}")]
    x = x.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), F.col(f"rho_{k}").alias("rho"), F.col(f"j_{k}").alias("jaccard")) for k in others])
    return x.select(*by, "n", F.inline(rows))


def ecdf(df: DataFrame, by: list[str], value: str, grid: list[float]) -> DataFrame:
    """Right-continuous ECDF of each group at a short grid: one pass."""
    n = F.count(value)
    at = [(F.count_if(F.col(value) <= g) / n).alias(f"_{i}") for i, g in enumerate(grid)]
    x = df.groupBy(*by).agg(*at)
    rows = F.array(*[F.struct(F.lit(float(g)).alias("q"), F.col(f"_{i}").alias("f")) for i, g in enumerate(grid)])
    return x.select(*by, F.inline(rows))


def two_sample(df: DataFrame, side: str, a: str, b: str, value: str) -> DataFrame:
    """ks and w1 (1-Wasserstein) of the values of two sides."""
    x = df.where(F.col(side).isin(a, b) & F.col(value).isNotNull())
    d = x.select(F.col(value).cast("double").alias("v"), (F.col(side) == a).cast("double").alias("wa"), (F.col(side) == b).cast("double").alias("wb"))
    n = d.agg(F.sum("wa").alias("na"), F.sum("wb").alias("nb"))
    d = d.crossJoin(F.broadcast(n))  # one row
    d = d.withColumn("g", F.col("wa") / F.col("na") - F.col("wb") / F.col("nb"))
    r = running(d, [], "v", "g")
    r = r.withColumn("gap", F.col("before") + F.col("w"))
    # the next distinct value: neighbours across bucket borders come from the whole order
    nxt = next_value(r, "v")
    return nxt.agg(F.max(F.abs("gap")).alias("ks"), F.coalesce(F.sum(F.abs("gap") * (F.col("next_v") - F.col("v"))), F.lit(0.0)).alias("w1"))


def next_value(df: DataFrame, value: str) -> DataFrame:
    """next_<value> over distinct values: a window inside each bucket, the next bucket's least at its end."""
    buckets = bucket_count(df)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = written(df.agg(F.percentile_approx(value, shares, F.lit(10 * buckets)).alias("_cuts")), "cuts")
    x = df.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    least = x.groupBy("_b").agg(F.min(value).alias("_m"))  # at most `buckets` rows
    after = least.withColumn("_next", F.lead("_m").over(Window.orderBy("_b"))).drop("_m")
    inside = F.lead(value).over(Window.partitionBy("_b").orderBy(value))
    return x.withColumn("_in", inside).join(F.broadcast(after), "_b").withColumn(f"next_{value}", F.coalesce("_in", "_next")).drop("_in", "_next", "_b")


def mann_whitney(df: DataFrame, side: str, a: str, b: str, value: str) -> DataFrame:
    """u of side a and Cliff's delta, from average rank sums."""
    x = df.where(F.col(side).isin(a, b) & F.col(value).isNotNull()).select(side, value)
    x = average_ranks(x, [], value, "_r")
    s = x.agg(
        F.sum(F.when(F.col(side) == a, F.col("_r"))).alias("ra"), F.count_if(F.col(side) == a).alias("na"), F.count_if(F.col(side) == b).alias("nb")
    )
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    return s.select("na", "nb", u.alias("u"), (2 * u / (F.col("na") * F.col("nb")) - 1).alias("cliffs_delta"))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and two-sided p of a 2 x 2 table."""
    odds = math.inf if b * c == 0 and a * d > 0 else math.nan if b * c == 0 else a * d / (b * c)
    rows, cols, n = a + b, a + c, a + b + c + d
    log_choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    p = lambda x: math.exp(log_choose(rows, x) + log_choose(n - rows, cols - x) - log_choose(n, cols))
    at = p(a)
    return odds, min(1.0, sum(q for x in range(max(0, cols - (n - rows)), min(rows, cols) + 1) if (q := p(x)) <= at * (1 + 1e-9)))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p of a correlation, from the incomplete beta function."""
    if n < 3 or abs(r) >= 1:
        return math.nan if n < 3 else 0.0
    x, a, b = 1 - r * r, (n - 2) / 2, 0.5
    # continued fraction of the regularised incomplete beta I_x(a, b)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a, b, x):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / d if d else 1e30
        h = d
        for m in range(1, 300):
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1 / (1 + t * d), 1 + t / c
            h *= d * c
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / (1 + t * d), 1 + t / c
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def errors(actual: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """rmse, mae, bias and r2, weighted."""
    w = F.lit(1.0) if weight is None else weight
    e = predicted - actual
    sw, swy, swyy = F.sum(w), F.sum(w * actual), F.sum(w * actual * actual)
    spread = swyy - swy * swy / sw
    return [
        F.sqrt(F.sum(w * e * e) / sw).alias("rmse"),
        (F.sum(w * F.abs(e)) / sw).alias("mae"),
        (F.sum(w * e) / sw).alias("bias"),
        F.when(spread > 0, 1 - F.sum(w * e * e) / F.when(spread > 0, spread)).alias("r2"),
    ]


def cell_weights(df: DataFrame, cells: list[str], name: str = "weight") -> DataFrame:
    """Each cell the same total weight, the whole summing to 1."""
    sizes = df.groupBy(*cells).agg(F.count("*").alias("_n"))
    k = sizes.agg(F.count("*").alias("_k"))
    sizes = sizes.crossJoin(F.broadcast(k))  # one row
    return df.join(sizes, cells).withColumn(name, 1.0 / (F.col("_n") * F.col("_k"))).drop("_n", "_k")


def standardised_difference(mean_a, mean_b, var_a, var_b) -> Column:
    pooled = F.sqrt((var_a + var_b) / 2)
    return F.when(pooled > 0, (mean_a - mean_b) / F.when(pooled > 0, pooled))


def durbin_watson(df: DataFrame, by: list[str], order: list[str], residual: str) -> DataFrame:
    """n and the statistic of residuals in the order of a number or time and a numeric unique key."""
    x = df.withColumn("_e", F.struct(F.col(residual).alias("r")))
    x = carried(x, by, F.col(order[0]), order[1:], order[-1], "_e", "_previous", before=True)
    x = x.withColumn("_d", F.col(residual) - F.col("_previous.r"))
    s = F.sum(F.col(residual) * F.col(residual))
    return x.groupBy(*by).agg(F.count(residual).alias("n"), F.when(s > 0, F.sum(F.col("_d") * F.col("_d")) / s).alias("dw"))


def sign_changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """n_up, n_down, n_same of adjacent differences in the order of a number or time and a numeric unique key."""
    x = df.withColumn("_e", F.struct(F.col(value).alias("r")))
    x = carried(x, by, F.col(order[0]), order[1:], order[-1], "_e", "_previous", before=True)
    d = F.col(value) - F.col("_previous.r")
    return x.groupBy(*by).agg(F.count_if(d > 0).alias("n_up"), F.count_if(d < 0).alias("n_down"), F.count_if(d == 0).alias("n_same"))


def pinball(actual: Column, predicted: Column, tau: float) -> Column:
    e = actual - predicted
    return F.avg(F.greatest(F.lit(tau) * e, F.lit(tau - 1) * e))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most common value (least on ties), its count and share."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = c.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("_x"), F.sum("n").alias("_t"))
    return best.select(*by, F.col(f"_x.{value}").alias("mode"), F.col("_x.n").alias("n"), (F.col("_x.n") / F.col("_t")).alias("share"))


def fisher_rows(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """df, a row per 2 x 2 table, with odds (missing where undefined or infinite) and the two-sided p."""
    @F.pandas_udf("odds double, p double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        found = [fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)]
        return pd.DataFrame([(o if math.isfinite(o) else None, p) for o, p in found], columns=["odds", "p"], dtype="float64")

    x = df.withColumn("_t", test(a, b, c, d)).select(*df.columns, "_t.*")
    return x.withColumn("odds", F.when(~F.isnan("odds"), F.col("odds")))


def calibration(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """n, r, its two-sided p_value and the calibration slope of actual on predicted."""
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x != x else pearson_p(float(x), int(k)) for x, k in zip(r, n, strict=True)], dtype="float64")

    ok = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    g = df.where(ok).groupBy(*by).agg(F.count("*").alias("n"), correlation(actual, predicted).alias("r"), F.regr_slope(actual, predicted).alias("slope"))
    return g.withColumn("p_value", p("r", "n"))
