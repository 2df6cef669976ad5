"""Model fitting.  The table is reduced to sums on the cluster; only matrices of a few columns reach numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lists import bernstein_cubic, one_hot
from .evaluation import near_tie
from .ordering import running
from .stats import conformal, spearman
from .store import written


def gram(df: DataFrame, x: list[str], y: list[str], by: str | None = None) -> dict:
    """Sums of products of x and y columns, by fold if asked: {fold: (X'X, X'Y, Y'Y, n)}; one pass."""
    names = [*x, *y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs]
    g = df.groupBy(F.lit(0).alias("_f") if by is None else F.col(by).alias("_f")).agg(F.count("*").alias("_n"), *sums)
    out = {}
    for r in g.collect():  # a row per fold
        m = np.zeros((len(names), len(names)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        p = len(x)
        out[r["_f"]] = (m[:p, :p], m[:p, p:], m[p:, p:], r["_n"])
    return out


def ridge(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """Scaled, not centred, without intercept; coefficients on the raw scale."""
    scale = np.sqrt(np.diag(xx))
    scale = np.where(scale > 0, scale, 1.0)
    a = xx / np.outer(scale, scale) + alpha * np.eye(len(xx))
    return np.linalg.solve(a, xy / scale[:, None]) / scale[:, None]


def cross_validated_ridge(folds: dict, alphas: list[float]) -> tuple[float, dict[float, float]]:
    """The alpha of least out-of-fold mean squared error: each fold's Gram is the total minus its own."""
    total = [sum(np.asarray(f[k]) for f in folds.values()) for k in range(4)]
    scores = {}
    for a in alphas:
        sse = n = 0.0
        for xx, xy, yy, m in folds.values():
            b = ridge(total[0] - xx, total[1] - xy, a)
            sse += np.trace(yy - 2 * b.T @ xy + b.T @ xx @ b)
            n += m * yy.shape[0]
        scores[a] = sse / n
    best = min(scores, key=lambda a: (scores[a], a))
    return best, scores


def leave_one_out(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Closed-form residuals e / (1 - h) of least squares."""
    h = x @ np.linalg.pinv(x.T @ x) @ x.T
    return (y - h @ y) / np.maximum(1 - np.diag(h), 1e-12)


def levenberg(residual, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 200, soft: bool = False):
    """Bounded Levenberg-Marquardt with a numeric Jacobian; soft: weights of the soft-L1 loss."""
    p = np.clip(np.asarray(start, float), low, high)
    damp = 1e-2

    def weighted(q):
        r = residual(q)
        if soft:
            r = r * np.sqrt(2 * (np.sqrt(1 + r * r) - 1) / np.maximum(r * r, 1e-300))
        return r

    r = weighted(p)
    cost = r @ r
    for _ in range(steps):
        step = 1e-6 * np.maximum(1e-3, np.abs(p))
        jac = np.stack([(weighted(np.clip(p + step * (np.arange(len(p)) == k), low, high)) - r) / step[k] for k in range(len(p))], 1)
        h = jac.T @ jac
        g = jac.T @ r
        moved = False
        for _ in range(12):
            d = np.linalg.lstsq(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), -g, rcond=None)[0]
            q = np.clip(p + d, low, high)
            s = weighted(q)
            if s @ s < cost:
                done = cost - s @ s < 1e-14 * max(cost, 1e-30)
                p, r, cost, damp, moved = q, s, s @ s, damp / 3, not done
                break
            damp *= 4
        if not moved:
            break
    jac_ok = np.linalg.matrix_rank(jac) if len(r) >= len(p) else 0
    return p, float(cost), {"rank": int(jac_ok), "condition": float(np.linalg.cond(jac)), "near_bound": bool(np.any((p <= low + 1e-9) | (p >= high - 1e-9)))}


def halton(n: int, dims: int) -> np.ndarray:
    """Low-discrepancy points in the unit cube: starts of a multi-start fit."""
    primes = [2, 3, 5, 7, 11, 13, 17, 19][:dims]
    out = np.zeros((n, dims))
    for j, b in enumerate(primes):
        for i in range(n):
            f, k = 1.0, i + 1
            while k:
                f /= b
                out[i, j] += f * (k % b)
                k //= b
    return out


SCALING_BOUNDS = (np.log([0.01, 1e-3, 0.02, 1e-3, 0.02]), np.log([20.0, 50.0, 2.0, 50.0, 2.0]))


def scaling_residual(n, d, loss):
    """Log-parameters E, A, alpha, B, beta of E + A n^-alpha + B d^-beta."""

    def f(p):
        e, a, al, b, be = np.exp(p)
        return e + a * n**-al + b * d**-be - loss

    return f


def fit_scaling(df: DataFrame, n: str, d: str, loss: str, starts: int = 16) -> DataFrame:
    """start, the five parameters, sse and diagnostics: one task per start over the cell table, whose size is checked."""
    held = df.sparkSession.sparkContext.broadcast(cell_table(df, [n, d, loss]))
    low, high = SCALING_BOUNDS
    points = low + halton(starts, 5) * (high - low)

    def run(it):
        x, y, z = held.value.T
        for pdf in it:
            rows = []
            for s in pdf["start"]:
                p, sse, info = levenberg(scaling_residual(x, y, z), points[s], low, high)
                rows.append([s, *np.exp(p), sse, info["rank"], info["near_bound"]])
            yield pd.DataFrame(rows, columns=["start", "e", "a", "alpha", "b", "beta", "sse", "rank", "near_bound"])

    schema = "start long, e double, a double, alpha double, b double, beta double, sse double, rank long, near_bound boolean"
    ids = df.sparkSession.range(starts, numPartitions=min(starts, 16)).withColumnRenamed("id", "start")
    return ids.mapInPandas(run, schema)


def profile_points(best: np.ndarray, index: int, points: int = 41, width: float = 1.0) -> np.ndarray:
    """Log grid around the optimum, with it."""
    return np.unique(np.r_[best[index] + np.linspace(-width, width, points), best[index]])


def profile(residual, best: np.ndarray, index: int, low: np.ndarray, high: np.ndarray, points: int = 41) -> pd.DataFrame:
    """SSE with one parameter held, the others refitted; inside: SSE <= best + 3.84 sigma^2."""
    rows = []
    base = residual(best)
    sse0, n = float(base @ base), len(base)
    for v in profile_points(best, index, points):
        if not low[index] <= v <= high[index]:
            continue
        lo, hi, start = low.copy(), high.copy(), best.copy()
        lo[index] = hi[index] = start[index] = v
        _, sse, _ = levenberg(residual, start, lo, hi, 60)
        rows.append((float(np.exp(v)), sse, sse <= sse0 + 3.84 * sse0 / max(n - len(best), 1)))
    return pd.DataFrame(rows, columns=["value", "sse", "inside"])


def quantile_regression(x: np.ndarray, y: np.ndarray, tau: float, rounds: int = 200) -> np.ndarray:
    """Iteratively reweighted least squares for the pinball loss."""
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        e = y - x @ b
        w = np.where(e >= 0, tau, 1 - tau) / np.maximum(np.abs(e), 1e-8)
        new = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if np.max(np.abs(new - b)) < 1e-10:
            break
        b = new
    return b


def huber_regression(x: np.ndarray, y: np.ndarray, t: float = 1.345, rounds: int = 100) -> np.ndarray:
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        e = y - x @ b
        s = np.median(np.abs(e - np.median(e))) / 0.6744897501960817 or 1e-12
        w = np.minimum(1.0, t * s / np.maximum(np.abs(e), 1e-12))
        new = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if np.max(np.abs(new - b)) < 1e-10:
            break
        b = new
    return b


def identifiable(x: np.ndarray) -> str:
    """OK, or NOT_IDENTIFIABLE where rows do not exceed columns or columns depend on each other."""
    return "OK" if len(x) > x.shape[1] and np.linalg.matrix_rank(x) == x.shape[1] else "NOT_IDENTIFIABLE"


def column_space_share(x: np.ndarray, q: np.ndarray) -> tuple[int, float]:
    """Rank of x and the share of q (centred) that lies outside its column space."""
    b = np.linalg.lstsq(x, q, rcond=None)[0]
    r = q - x @ b
    c = q - q.mean()
    return int(np.linalg.matrix_rank(x)), float(r @ r / max(c @ c, 1e-300))


def one_standard_error(df: DataFrame, by: list[str], model: str, complexity: str, mean: str, se: str) -> DataFrame:
    """The simplest model whose mean error is within one standard error of the best."""
    best = df.groupBy(*by).agg(F.min_by(F.struct(mean, se), F.struct(F.col(mean), F.col(complexity), F.col(model))).alias("_b"))
    x = df.join(best, by).where(F.col(mean) <= F.col("_b")[mean] + F.col("_b")[se])
    return x.groupBy(*by).agg(F.min_by(model, F.struct(F.col(complexity), F.col(mean), F.col(model))).alias("chosen"))


# ---- candidate ladders -------------------------------------------------------------------


#: Of a residual's size, so many bits name the bin in which the order statistic is sought: 256 bins from a number to its double.
LEADING_BITS = 20


def ladder(df: DataFrame, target: str, specs: dict[str, list[str]], least: int = 4) -> DataFrame:
    """candidate, n_fit, n_features, status, rmse, loo_rmse, half_width of least squares with intercept on each spec's complete cases.

    One pass sums the products of all specs; a second has each row's leave-one-out residual
    e / (1 - h), whose 95 % conformal order statistic is the half width: the second pass counts
    sizes by their leading bits, a third orders those of the one bin that holds it.  A spec with too few
    rows (fewer than `least`, or not more than its columns) or dependent columns has a status only.
    """
    names = list(dict.fromkeys([target, *[c for cols in specs.values() for c in cols]]))
    at = [[names.index(c) for c in cols] for cols in specs.values()]
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])

    def complete(b, i):
        """Target and columns of a batch's complete cases of spec i."""
        m = [b.column(k).to_numpy(zero_copy_only=False) for k in (0, *at[i])]
        ok = np.logical_and.reduce([np.isfinite(v) for v in m])
        return [v[ok] for v in m]

    def products(batches):
        total = [np.zeros((len(c) + 2, len(c) + 2)) for c in at]
        for b in batches:
            for i in range(len(at)):
                y, *cols = complete(b, i)
                m = np.stack([np.ones(len(y)), *cols, y])
                total[i] += m @ m.T
        flat = [(i, k, v) for i, g in enumerate(total) for k, v in enumerate(g.reshape(-1).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], names=["i", "k", "v"])

    grams = [np.zeros((len(c) + 2) ** 2) for c in at]
    for r in x.mapInArrow(products, "i long, k long, v double").groupBy("i", "k").agg(F.sum("v").alias("v")).collect():  # a row per product
        grams[r["i"]][r["k"]] = r["v"]
    status, models = [], {}
    for i, (k, cols) in enumerate(specs.items()):
        p = len(cols) + 1
        g = grams[i].reshape(p + 1, p + 1)
        n, xx, xy = round(g[0, 0]), g[:p, :p], g[:p, p]
        if n < least or n <= len(cols):
            status.append((k, n, len(cols), "TOO_FEW"))
            continue
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        unit = xx / np.outer(scale, scale)
        if np.linalg.matrix_rank(unit, hermitian=True) < p:
            status.append((k, n, len(cols), "NOT_IDENTIFIABLE"))
            continue
        status.append((k, n, len(cols), "OK"))
        inverse = np.linalg.inv(unit) / np.outer(scale, scale)
        models[i] = (k, n, inverse @ xy, inverse)
    out = df.sparkSession.createDataFrame(status, "candidate string, n_fit long, n_features long, status string")
    if not models:
        return out.withColumns({c: F.lit(None).cast("double") for c in ("rmse", "loo_rmse", "half_width")})

    def residuals(b, i):
        """e and o, value by value, so that they have the same bits in each pass."""
        _, _, beta, inverse = models[i]
        y, *cols = complete(b, i)
        z = [np.ones(len(y)), *cols]
        e, h = y.copy(), np.zeros(len(y))
        for c in range(len(z)):
            e -= beta[c] * z[c]
            part = inverse[c, c] * z[c]
            for d in range(c + 1, len(z)):
                part += 2 * inverse[c, d] * z[d]
            h += part * z[c]
        return e, e / np.maximum(1 - h, 1e-12)

    leading = lambda o: (np.abs(o).view(np.uint64) >> np.uint64(64 - LEADING_BITS)).astype(np.int64)

    def counted(batches):
        held, sums = {i: {} for i in models}, {i: np.zeros(2) for i in models}
        for b in batches:
            for i in models:
                e, o = residuals(b, i)
                sums[i] += e @ e, o @ o
                for v, n in zip(*(c.tolist() for c in np.unique(leading(o), return_counts=True)), strict=True):
                    held[i][v] = held[i].get(v, 0) + n
        flat = [(i, -1, 0, *map(float, sums[i])) for i in models] + [(i, v, n, 0.0, 0.0) for i in models for v, n in held[i].items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], names=["i", "bin", "n", "e", "o"])

    bins = x.mapInArrow(counted, "i long, bin long, n long, e double, o double").groupBy("i", "bin").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("o").alias("o"))
    found = sorted(map(tuple, bins.collect()))  # at most 2 ** LEADING_BITS rows of a spec
    facts, wanted = [], {}
    for i, (k, n, _, _) in models.items():
        (_, _, _, e, o), *rest = [r for r in found if r[0] == i]
        place, below = math.ceil(round(min(1.0, math.ceil((n + 1) * 0.95) / n) * (n - 1), 9)), 0
        for _, v, m, _, _ in rest:
            if below + m > place:
                wanted[i] = v
                break
            below += m
        facts.append((i, k, math.sqrt(e / n), math.sqrt(o / n), place - below))

    def inside(batches):
        for b in batches:
            for i, v in wanted.items():
                o = np.abs(residuals(b, i)[1])
                o = o[leading(o) == v]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), i)), pa.array(o), pa.array(np.ones(len(o), np.int64))], names=["i", "a", "one"])

    values = written(x.mapInArrow(inside, "i long, a double, one long").groupBy("i", "a").agg(F.sum("one").alias("one")), "ladder-values")
    facts = df.sparkSession.createDataFrame(facts, "i long, candidate string, rmse double, loo_rmse double, place long")
    r = running(values, ["i"], "a", "one").join(F.broadcast(facts), "i")  # a row per spec
    r = r.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("w")))
    return out.join(r.select("candidate", "rmse", "loo_rmse", F.col("a").alias("half_width")), "candidate", "left")


def _complete(columns: list[str]):
    out = F.lit(True)
    for c in columns:
        d = F.col(c).cast("double")
        out = out & d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.coalesce(out, F.lit(False))


def _residuals(long: DataFrame) -> DataFrame:
    """Of candidate, e, o, a: rmse, loo_rmse and the conformal half width."""
    g = long.groupBy("candidate").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.sqrt(F.avg(F.col("o") * F.col("o"))).alias("loo_rmse"))
    q = conformal(long, ["candidate"], "a").select("candidate", F.col("conformal_q").alias("half_width"))
    return g.join(q, "candidate", "left")


def isotonic(df: DataFrame, x: str, y: str, folds: int = 5) -> DataFrame:
    """e and o: residuals of a monotone fit, in sample and cross-fitted over folds dealt by digest; the direction is that of the rank correlation.

    Rows of one x are one weighted point, so a fit sees distinct values only; beyond the ends the end's value holds.
    """
    from pyspark.ml.regression import IsotonicRegression

    d = df.where(_complete([x, y])).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    d = written(d.withColumn("_f", F.pmod(F.xxhash64("_x", "_y"), F.lit(folds)).cast("int")), "isotonic-rows")
    rho = spearman(d, [], "_x", "_y").first()["rho"]
    cells = written(d.groupBy("_x", "_f").agg(F.sum("_y").alias("_s"), F.count("*").alias("_n")), "isotonic-cells")
    model = IsotonicRegression(featuresCol="_x", labelCol="_m", weightCol="_w", isotonic=rho is None or rho >= 0)
    one = lambda c: c.groupBy("_x").agg((F.sum("_s") / F.sum("_n")).alias("_m"), F.sum("_n").cast("double").alias("_w"))
    fitted = model.fit(one(cells)).transform(cells.select("_x").distinct()).select("_x", F.col("prediction").alias("_p"))
    held = None
    for k in range(folds):
        part = cells.where(F.col("_f") == k).select("_x", "_f")
        p = model.fit(one(cells.where(F.col("_f") != k))).transform(part).select("_x", "_f", F.col("prediction").alias("_q"))
        held = p if held is None else held.unionAll(p)
    z = d.join(fitted, "_x").join(held, ["_x", "_f"])
    return z.select((F.col("_y") - F.col("_p")).alias("e"), (F.col("_y") - F.col("_q")).alias("o"))


def candidate_ladder(df: DataFrame, target: str, loss: str, log_n: str, log_d: str, time: str, family: str, families: list[str]) -> DataFrame:
    """The nine candidates from a constant to a spline with family and time, each with complexity, as `ladder` and `isotonic` fit them.

    families: the levels of the family; the first has no column, and other values are all 0.
    """
    df = written(df.select(target, loss, log_n, log_d, time, family), "ladder-rows")
    low, high = df.agg(F.min(F.col(log_n).cast("double")), F.max(F.col(log_n).cast("double"))).first()
    x = df.withColumns({f"_fam{i}": F.when(F.col(family).isNotNull(), one_hot(F.col(family), families)[i]) for i in range(len(families) - 1)})
    flat = low is None or not high > low
    b = None if flat else bernstein_cubic(F.col(log_n).cast("double"), low, high)
    x = x.withColumns({f"_spl{i}": F.lit(0.0) if flat else b[i] for i in range(3)})
    fam, spl = [f"_fam{i}" for i in range(len(families) - 1)], [f"_spl{i}" for i in range(3)]
    specs = {
        "CONSTANT": (0, []), "SIZE_LOG_LINEAR": (1, [log_n]), "LOSS_SIZE_LINEAR": (2, [loss, log_n]), "LOSS_SIZE_FAMILY": (3, [loss, log_n, *fam]),
        "LOSS_SIZE_TIME": (3, [loss, log_n, time]), "LOSS_SIZE_FAMILY_TIME": (4, [loss, log_n, *fam, time]), "LOSS_SIZE_LOG_D": (4, [loss, log_n, log_d]),
        "LOSS_SIZE_FAMILY_TIME_SPLINE_DF4": (5, [*spl, loss, time, *fam]),
    }
    out = ladder(x, target, {k: c for k, (_, c) in specs.items()})
    n = x.where(_complete([loss, target])).count()
    mono = out.sparkSession.createDataFrame([("LOSS_MONOTONE", n, 1, "OK" if n >= 4 else "TOO_FEW")], "candidate string, n_fit long, n_features long, status string")
    if n >= 4:
        r = isotonic(x, loss, target).select(F.lit("LOSS_MONOTONE").alias("candidate"), "e", "o", F.abs("o").alias("a"))
        mono = mono.join(_residuals(r), "candidate", "left")
    else:
        mono = mono.withColumns({c: F.lit(None).cast("double") for c in ("rmse", "loo_rmse", "half_width")})
    levels = F.create_map(*[F.lit(z) for k, v in ({k: c for k, (c, _) in specs.items()} | {"LOSS_MONOTONE": 2}).items() for z in (k, v)])
    return out.unionByName(mono).withColumn("complexity", levels[F.col("candidate")])


# ---- configurations ----------------------------------------------------------------------

MOST_CELLS = 200_000
PRIORITY = ["point/linear", "point/soft", "bins/linear", "bins/soft"]


def cell_table(df: DataFrame, columns: list[str], most: int = MOST_CELLS) -> np.ndarray:
    """A small table of numbers as an array; an error, not a slow driver, where it is not small."""
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).limit(most + 1).toPandas().to_numpy()
    if len(x) > most:
        raise ValueError(f"more than {most} cells: aggregate them first")
    return x[~np.isnan(x).any(axis=1)]


def compare_configurations(cells: DataFrame, n: str, d: str, loss: str, starts: int = 4) -> DataFrame:
    """configuration, fit_rmse, loo_rmse (a size left out), late_rmse (the last 20 % of each size's tokens), score, chosen.

    Weights by point or equal over bins of log tokens, times linear or soft-L1 residuals; every
    fit (configuration and fold) is a row that a task fits on the checked, broadcast cells.
    The score is the mean of the two validation errors; of those within 1 % of the least the
    first in PRIORITY is chosen.
    """
    spark = cells.sparkSession
    held = spark.sparkContext.broadcast(cell_table(cells, [n, d, loss]))
    sizes = np.unique(held.value[:, 0])
    jobs = [(c, s) for c in PRIORITY for s in [-2, -1, *range(len(sizes))]]
    low, high = SCALING_BOUNDS
    points = low + halton(starts, 5) * (high - low)

    def run(it):
        x, y, z = held.value.T
        top = np.array([x_max for x_max in [y[x == s].max() for s in sizes]])[np.searchsorted(sizes, x)]
        bins = np.floor(np.log10(np.maximum(y, 1e-12)) * 4)
        for pdf in it:
            out = []
            for name, fold in zip(pdf["configuration"], pdf["fold"], strict=True):
                test = np.ones(len(x), bool) if fold == -2 else y > 0.8 * top if fold == -1 else x == sizes[fold]
                train = np.ones(len(x), bool) if fold == -2 else ~test
                w = np.ones(len(x))
                if name.startswith("bins"):
                    _, at, many = np.unique(bins[train], return_inverse=True, return_counts=True)
                    w = np.zeros(len(x))
                    w[train] = 1.0 / many[at]
                if not test.any() or train.sum() < 5:
                    out.append((name, fold, 0, None))
                    continue
                r = np.sqrt(w[train] / w[train].sum())
                base = scaling_residual(x[train], y[train], z[train])
                best = min((levenberg(lambda p: base(p) * r, s, low, high, 120, name.endswith("soft")) for s in points), key=lambda f: f[1])[0]
                e = scaling_residual(x[test], y[test], z[test])(best)
                out.append((name, fold, int(test.sum()), float(e @ e)))
            yield pd.DataFrame(out, columns=["configuration", "fold", "n", "sse"])

    rows = spark.createDataFrame(jobs, "configuration string, fold long").repartition(len(jobs))
    f = rows.mapInPandas(run, "configuration string, fold long, n long, sse double")
    part = lambda c: F.sqrt(F.sum(F.when(c, F.col("sse"))) / F.sum(F.when(c, F.col("n"))))
    g = f.groupBy("configuration").agg(part(F.col("fold") == -2).alias("fit_rmse"), part(F.col("fold") >= 0).alias("loo_rmse"), part(F.col("fold") == -1).alias("late_rmse"))
    g = g.withColumn("score", (F.col("loo_rmse") + F.col("late_rmse")) / 2)
    chosen = near_tie(g, [], "configuration", "score", PRIORITY).select("chosen")
    return g.crossJoin(F.broadcast(chosen)).withColumn("chosen", F.col("configuration") == F.col("chosen"))  # one row


# ---- robust and identifiability fits by sums ---------------------------------------------


def weighted_line(df: DataFrame, x: list[str], y: str, weight=None) -> np.ndarray:
    """Weighted least squares by one pass of sums; `weight` is a Column."""
    z = df if weight is None else df.withColumns({c: F.col(c) * F.sqrt(weight) for c in [*x, y]})
    xx, xy, _, _ = gram(z, x, [y])[0]
    return ridge(xx, xy, 0.0)[:, 0]


def robust_regressions(df: DataFrame, x: list[str], y: str, tau: float = 0.9, t: float = 1.345, rounds: int = 25) -> DataFrame:
    """kind, status, n and coefficients (an array in the order of x) of least squares, the tau quantile and Huber's M estimate.

    Reweighted least squares: each round is one pass of sums over the complete cases, whatever
    their number; the scale of Huber's is the median absolute residual, from a sketch.
    """
    z = written(df.where(_complete([*x, y])).select(*[F.col(c).cast("double").alias(c) for c in [*x, y]]), "regression-rows")
    xx, _, _, n = gram(z, x, [y]).get(0, (np.zeros((len(x), len(x))), None, None, 0))
    spark = df.sparkSession
    schema = "kind string, status string, n long, coefficients array<double>"
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    if n <= len(x) or np.linalg.matrix_rank(xx / np.outer(scale, scale), hermitian=True) < len(x):
        return spark.createDataFrame([(k, "NOT_IDENTIFIABLE", int(n), None) for k in ("ols", "quantile", "huber")], schema)
    start = weighted_line(z, x, y)
    rows = [("ols", "OK", int(n), start.tolist())]
    error = lambda b: F.col(y) - sum((F.lit(float(v)) * F.col(c) for v, c in zip(b, x, strict=True)), F.lit(0.0))
    for kind in ("quantile", "huber"):
        b = start
        for _ in range(rounds):
            e = error(b)
            if kind == "quantile":
                w = F.when(e >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(e), F.lit(1e-6))
            else:
                s = z.agg(F.percentile_approx(F.abs(e), 0.5, F.lit(100_000))).first()[0] / 0.6744897501960817 or 1e-12
                w = F.least(F.lit(1.0), F.lit(t * s) / F.greatest(F.abs(e), F.lit(1e-12)))
            new = weighted_line(z, x, y, w)
            done = np.max(np.abs(new - b)) < 1e-9 * max(1.0, np.max(np.abs(b)))
            b = new
            if done:
                break
        rows.append((kind, "OK", int(n), b.tolist()))
    return spark.createDataFrame(rows, schema)


def column_space(df: DataFrame, x: list[str], q: str) -> DataFrame:
    """rank of x and the share of q (centred) outside its column space, by one pass of sums; 1 is identifiable apart from x, 0 is not."""
    z = df.where(_complete([*x, q])).withColumn("_one", F.lit(1.0))
    xx, xq, qq, n = gram(z, ["_one", *x], [q]).get(0, (np.zeros((len(x) + 1,) * 2), np.zeros((len(x) + 1, 1)), np.zeros((1, 1)), 0))
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    unit = xx / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(unit, hermitian=True))
    c = xq[:, 0] / scale
    spread = float(qq[0, 0] - xq[0, 0] ** 2 / n) if n else 0.0
    share = float(qq[0, 0] - c @ np.linalg.pinv(unit, hermitian=True) @ c) / spread if spread > 0 else None
    return df.sparkSession.createDataFrame([(int(n), rank, share)], "n long, rank long, outside double")


def nested_ridge(folds: dict, families: dict[str, list[int]], alphas: list[float]) -> list[tuple]:
    """(family, fold, alpha, sse, n): each fold is predicted by the alpha that the other folds choose among themselves.

    families: the columns of the Gram matrices that each uses.  All fits come from the folds' sums;
    of the families the one of the least out-of-fold error is chosen by the caller.
    """
    out = []
    for name, cols in families.items():
        part = {f: (xx[np.ix_(cols, cols)], xy[cols], yy, n) for f, (xx, xy, yy, n) in folds.items()}
        for f, (xx, xy, yy, n) in part.items():
            others = {g: v for g, v in part.items() if g != f}
            alpha, _ = cross_validated_ridge(others, alphas)
            b = ridge(sum(v[0] for v in others.values()), sum(v[1] for v in others.values()), alpha)
            out.append((name, f, alpha, float(np.trace(yy - 2 * b.T @ xy + b.T @ xx @ b)), int(n) * yy.shape[0]))
    return out


def profile_table(df: DataFrame, n: str, d: str, loss: str, points: int = 11, starts: int = 6) -> DataFrame:
    """parameter, value, sse, inside: the profile of each scaling parameter over a log grid; a task per grid point on the checked, broadcast cells."""
    spark = df.sparkSession
    cells = cell_table(df, [n, d, loss])
    low, high = SCALING_BOUNDS
    f = scaling_residual(*cells.T)
    best = min((levenberg(f, s, low, high) for s in low + halton(starts, 5) * (high - low)), key=lambda t: t[1])[0]
    held = spark.sparkContext.broadcast((cells, best))
    names = ["e", "a", "alpha", "b", "beta"]
    jobs = [(names[i], i, float(v)) for i in range(5) for v in profile_points(best, i, points) if low[i] <= v <= high[i]]

    def run(it):
        table, at = held.value
        g = scaling_residual(*table.T)
        base = g(at)
        sse0 = float(base @ base)
        for pdf in it:
            out = []
            for name, i, v in zip(pdf["parameter"], pdf["i"], pdf["log_value"], strict=True):
                lo, hi, start = low.copy(), high.copy(), at.copy()
                lo[i] = hi[i] = start[i] = v
                _, sse, _ = levenberg(g, start, lo, hi, 60)
                out.append((name, float(np.exp(v)), sse, bool(sse <= sse0 + 3.84 * sse0 / max(len(base) - 5, 1) + 1e-300)))
            yield pd.DataFrame(out, columns=["parameter", "value", "sse", "inside"])

    rows = spark.createDataFrame(jobs, "parameter string, i long, log_value double").repartition(len(jobs))
    return rows.mapInPandas(run, "parameter string, value double, sse double, inside boolean")


# Primitive polynomials (degree, coefficients) and initial numbers of the published Sobol sequence, dimensions 2 to 7.
DIRECTIONS = [(1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13])]


def sobol(n: int, dims: int, seed: int | None = None) -> np.ndarray:
    """Points of the Sobol sequence in the unit cube, up to 7 dimensions; a seed scrambles them by a random digital shift."""
    bits = 30
    shift = np.zeros(dims, np.int64) if seed is None else np.random.default_rng(seed).integers(0, 1 << bits, dims)
    out = np.zeros((n, dims))
    for j in range(dims):
        if j == 0:
            v = [1 << (bits - 1 - i) for i in range(bits)]
        else:
            s, a, m = DIRECTIONS[j - 1]
            v = [m[i] << (bits - 1 - i) for i in range(s)]
            for i in range(s, bits):
                x = v[i - s] ^ (v[i - s] >> s)
                for k in range(1, s):
                    x ^= ((a >> (s - 1 - k)) & 1) * v[i - k]
                v.append(x)
        x = 0
        for i in range(n):
            out[i, j] = ((x ^ int(shift[j])) + 0.5 * (seed is not None)) / (1 << bits)
            x ^= v[((i + 1) & -(i + 1)).bit_length() - 1]
    return out


def frozen_scale_fit(df: DataFrame, n: str, d: str, loss: str, starts: int = 33, seed: int = 7) -> DataFrame:
    """start, success, cost, the five parameters, rank, condition and near_bound of fits whose scales are frozen first: E, A and B in units of the median loss, residuals in units of its IQR.

    The first start is the frozen law, the others scrambled Sobol points in the inner 90 % of the
    log bounds; a task per start on the checked, broadcast cells.
    """
    spark = df.sparkSession
    cells = cell_table(df, [n, d, loss])
    if not len(cells):
        return spark.createDataFrame([], FROZEN)
    y = cells[:, 2]
    unit = float(np.median(y))
    spread = max(float(np.percentile(y, 75) - np.percentile(y, 25)), 1e-8)
    low, high = np.log([1e-8, 1e-8, 1e-4, 1e-8, 1e-4]), np.log([1e3, 1e3, 4.0, 1e3, 4.0])
    law = np.log([LAW_START[0] / unit, LAW_START[1] / unit, LAW_START[2], LAW_START[3] / unit, LAW_START[4]])
    points = np.vstack([np.clip(law, low, high), low + (0.05 + 0.9 * sobol(starts - 1, 5, seed)) * (high - low)])
    held = spark.sparkContext.broadcast(cells)

    def run(it):
        x, t, z = held.value.T
        scale = np.array([unit, unit, 1.0, unit, 1.0])
        weight = 1 / np.sqrt(len(z))

        def residual(p):
            e, a, al, b, be = np.exp(p) * scale
            return weight * (e + a * x**-al + b * t**-be - z) / spread

        for pdf in it:
            rows = []
            for s in pdf["start"]:
                p, sse, info = levenberg(residual, points[s], low, high, 400)
                rows.append([s, bool(np.isfinite(sse)), sse / 2, *(np.exp(p) * scale), info["rank"], info["condition"], info["near_bound"]])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FROZEN.split(", ")])

    ids = spark.range(starts, numPartitions=min(starts, 16)).withColumnRenamed("id", "start")
    return ids.mapInPandas(run, FROZEN)


FROZEN = "start long, success boolean, cost double, e double, a double, alpha double, b double, beta double, rank long, condition double, near_bound boolean"
LAW_START = (1.6898, 0.35398, 0.33998, 1.24031, 0.27988)


def fit_summary(fits: DataFrame, near: float = 1e-7, apart: float = 1e-3) -> DataFrame:
    """The best fit with n_successful and unseparated: whether another start reached the same cost with other parameters (in logs)."""
    best = fits.where("success").agg(F.min_by(F.struct("cost", "e", "a", "alpha", "b", "beta", "rank", "near_bound"), F.struct("cost", "start")).alias("_b"), F.count("*").alias("n_successful"))
    x = fits.where("success").crossJoin(F.broadcast(best))  # one row
    far = sum((F.pow(F.log(F.col(c)) - F.log(F.col(f"_b.{c}")), F.lit(2.0)) for c in ("e", "a", "alpha", "b", "beta")), F.lit(0.0))
    other = x.agg(F.count_if((F.col("cost") <= F.col("_b.cost") + near) & (F.sqrt(far) > apart)).alias("_n"))
    return best.crossJoin(F.broadcast(other)).select("_b.*", "n_successful", (F.col("_n") > 0).alias("unseparated"))  # one row each
