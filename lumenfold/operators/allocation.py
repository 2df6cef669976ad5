"""Compute allocation: closed forms as Column expressions, a solver for the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import dot
from .joins import as_of
from .ordering import running

# The frozen law and its support.
LAW = {"e": 1.6898, "a": 0.35398, "alpha": 0.33998, "b": 1.24031, "beta": 0.27988}
N_RANGE = (0.070542, 11.965825)
D_MAX = 299.893
ETA = 2e-4


def optimum(budget: Column, context: Column, law: dict = LAW, eta: float = ETA) -> tuple[Column, Column]:
    """(N, D) in billions for cost 1e18 (6 + eta H) N D = budget: the interior optimum, clamped to the support."""
    unit = F.lit(1e18) * (F.lit(6.0) + F.lit(eta) * context)
    s = law["alpha"] + law["beta"]
    ratio = (law["alpha"] * law["a"] / (law["beta"] * law["b"])) ** (1 / s)
    n = F.lit(ratio) * F.pow(budget / unit, F.lit(law["beta"] / s))
    n = F.least(F.greatest(n, F.lit(N_RANGE[0])), F.lit(N_RANGE[1]))
    d = budget / (unit * n)
    over = d > D_MAX
    return F.when(over, budget / (unit * F.lit(D_MAX))).otherwise(n), F.when(over, F.lit(D_MAX)).otherwise(d)


def active(n: Column, d: Column) -> Column:
    """Which bounds hold, joined by |."""
    return F.concat_ws(
        "|",
        F.when(n <= N_RANGE[0] * (1 + 1e-9), "N_low"),
        F.when(n >= N_RANGE[1] * (1 - 1e-9), "N_high"),
        F.when(d >= D_MAX * (1 - 1e-9), "D_high"),
        F.lit("budget"),
    )


def golden(f, low: float, high: float, rounds: int = 120) -> float:
    r = (5**0.5 - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - r * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + r * (high - low)
            fb = f(b)
    return (low + high) / 2


def solve(cases: DataFrame, law: dict = LAW) -> DataFrame:
    """case_id, n, d, q, loss, spent for rows (case_id, budget, context, gain, cost_kind, cost_scale and, if there, effect).

    Quality q in [0.6, 1] costs cost_scale * g(q) per unit of D above its cost at 0.6.  By the
    effect "additive" (also where none is given) the loss falls by gain * (q - 0.6); by "tokens"
    a token counts exp(gain * (q - 0.6)) times.  The budget is an inequality: at the upper end of
    D some is left.  Each row is independent: a task solves its rows, from a coarse grid over q,
    by nested golden sections around the best three points.
    """

    def g(kind, q):
        return np.exp(q) - 1 if kind == "exp" else q * q if kind == "power" else np.log1p(q)

    def one(r):
        tokens = getattr(r, "effect", "additive") == "tokens"

        def best_n(q):
            extra = max(r.cost_scale * (g(r.cost_kind, q) - g(r.cost_kind, 0.6)), 0.0)
            unit = lambda n: 1e18 * ((6 + ETA * r.context) * n + extra)

            def loss(log_n):
                n = np.exp(log_n)
                d = min(r.budget / unit(n), D_MAX)
                worth = d * np.exp(r.gain * (q - 0.6)) if tokens else d
                return law["e"] + law["a"] * n ** -law["alpha"] + law["b"] * worth ** -law["beta"] - (0.0 if tokens else r.gain * (q - 0.6))

            n = np.exp(golden(loss, np.log(N_RANGE[0]), np.log(N_RANGE[1])))
            d = min(r.budget / unit(n), D_MAX)
            return loss(np.log(n)), n, d, unit(n) * d

        grid = np.linspace(0.6, 1.0, 9)
        near = sorted(grid, key=lambda v: best_n(v)[0])[:3]
        found = [golden(lambda q: best_n(q)[0], max(0.6, v - 0.05), min(1.0, v + 0.05), 40) for v in near]
        q = min([0.6, 1.0, *near, *found], key=lambda v: (best_n(v)[0], v))
        loss, n, d, spent = best_n(q)
        return (r.case_id, float(n), float(d), float(q), float(loss), float(spent))

    def run(it):
        for pdf in it:
            yield pd.DataFrame([one(r) for r in pdf.itertuples()], columns=["case_id", "n", "d", "q", "loss", "spent"])

    return cases.mapInPandas(run, "case_id long, n double, d double, q double, loss double, spent double")


def equal_quantile(x: Column, levels: list[float]) -> Column:
    """Ceil-index bridge onto sorted unique levels: F in (0, 1] -> level number ceil(k F), 1 for F = 0."""
    at = F.least(F.greatest(F.ceil(F.lit(len(levels)) * x).cast("int"), F.lit(1)), F.lit(len(levels)))
    return F.element_at(F.array(*[F.lit(float(v)) for v in sorted(levels)]), at)


def quantile_bridge(points: DataFrame, value: str, support: DataFrame, support_value: str, levels: list[float]) -> DataFrame:
    """points with f (the support's share at or below), level, status and usable: what lies outside the support has a level but is not usable."""
    r = running(support.where(F.col(support_value).isNotNull()).withColumn("_one", F.lit(1).cast("long")), [], support_value, "_one")
    steps = r.select(F.lit(0).alias("_all"), F.col(support_value).cast("double").alias("_s"), ((F.col("before") + F.col("w")) / F.col("total")).alias("f"))
    ends = steps.agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"))
    x = points.withColumn("_all", F.lit(0)).withColumn("_point", F.col(value).cast("double"))
    x = as_of(x, ["_all"], "_point", steps, "_s", "f").crossJoin(F.broadcast(ends))  # one row
    status = F.when(F.col("_point") < F.col("_low"), "OUT_OF_SUPPORT_LOW").when(F.col("_point") > F.col("_high"), "OUT_OF_SUPPORT_HIGH").otherwise("IN_SUPPORT")
    f = F.when(F.col("_point") < F.col("_low"), F.lit(0.0)).otherwise(F.col("f"))
    k = len(levels)
    x = x.withColumn("status", status).withColumn("usable", F.col("status") == "IN_SUPPORT").withColumn("f", f)
    # a share that should be whole may lie a rounding error above
    return x.withColumn("level", equal_quantile(F.round(k * F.col("f"), 9) / k, levels)).drop("_all", "_point", "_low", "_high")


def sensitivity(n: Column, d: Column, budget: Column, context: Column, law: dict = LAW, eta: float = ETA) -> dict[str, Column]:
    """Of an allocation: active constraints, KKT residual and multiplier in logs of N and D, the budget's residual, the marginal gain, and both elasticity terms.

    A bound that holds takes its variable out of the projected gradient.  The marginal gain is
    the central difference of the optimal loss over the budget, 1e-4 of it to each side.
    """
    unit = F.lit(1e18) * (F.lit(6.0) + F.lit(eta) * context)
    cost = unit * n * d
    en, ed = F.lit(law["alpha"] * law["a"]) * F.pow(n, F.lit(-law["alpha"])), F.lit(law["beta"] * law["b"]) * F.pow(d, F.lit(-law["beta"]))
    low, high = n <= N_RANGE[0] * (1 + 1e-8), n >= N_RANGE[1] * (1 - 1e-8)
    d_high = d >= D_MAX * (1 - 1e-8)
    free_n, free_d = (~(low | high)).cast("double"), (~d_high).cast("double")
    # the gradient of the loss is (-en, -ed), that of the cost (cost, cost)
    free = free_n + free_d
    mu = F.when(free > 0, (en * free_n + ed * free_d) / (cost * F.when(free > 0, free)))
    pn, pd = free_n * (-en + mu * cost), free_d * (-ed + mu * cost)
    loss = lambda m, k: F.lit(law["e"]) + F.lit(law["a"]) * F.pow(m, F.lit(-law["alpha"])) + F.lit(law["b"]) * F.pow(k, F.lit(-law["beta"]))
    lo, hi = (loss(*optimum(budget * (1 + s * 1e-4), context, law, eta)) for s in (-1, 1))
    return {
        "active": F.concat_ws("|", F.when(F.abs(cost - budget) <= budget * 1e-9, "BUDGET_BINDING"), F.when(low, "N_LOWER"), F.when(high, "N_UPPER"), F.when(d_high, "D_UPPER")),
        "kkt_residual": F.when(free > 0, F.sqrt(pn * pn + pd * pd)).otherwise(0.0),
        "multiplier": mu,
        "budget_residual": (cost - budget) / budget,
        "marginal_gain": (lo - hi) / (2e-4 * budget),
        "n_term": en,
        "d_term": ed,
    }


def best_vertex(recipes: DataFrame, key: str, recipe: str, weights: list[float], largest: bool = False) -> DataFrame:
    """The recipe that a linear loss over the hull of all recipes attains: key, loss, n_recipes, n_better and check.

    A linear programme over a simplex attains a vertex; the check is its dual: the value is feasible
    (no recipe lies beyond it), so no mixture does better.
    """
    w = F.array(*[F.lit(float(v)) for v in weights])
    x = recipes.select(key, dot(w, F.slice(F.col(recipe), 1, len(weights))).alias("_g")).where(F.col("_g").isNotNull())
    pick = F.max_by if largest else F.min_by
    order = F.struct("_g", -F.col(key) if largest else F.col(key))
    best = x.agg(pick(F.struct(F.col(key).alias("k"), "_g"), order).alias("_b"), F.count("*").alias("n_recipes"))
    y = x.crossJoin(F.broadcast(best))  # one row
    beyond = F.col("_g") > F.col("_b._g") + 1e-9 if largest else F.col("_g") < F.col("_b._g") - 1e-9
    g = y.agg(F.first("_b.k").alias(key), F.first("_b._g").alias("loss"), F.first("n_recipes").alias("n_recipes"), F.count_if(beyond).alias("n_better"))
    return g.withColumn("check", F.when(F.col("n_better") == 0, "LP_MATCH").otherwise("LP_REFINED"))
