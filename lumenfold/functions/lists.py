"""Array Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def is_valid(x: Column, size: int) -> Column:
    """Right length and every element finite: one bad element spoils the list."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce((F.size(x) == size) & ~bad, F.lit(False))


def element_counts(x: Column) -> Column:
    """struct of null, nan, posinf and neginf element counts."""
    count = lambda f: F.size(F.filter(x, f))
    d = lambda v: v.cast("double")
    return F.struct(
        count(lambda v: v.isNull()).alias("nulls"),
        count(lambda v: F.coalesce(F.isnan(d(v)), F.lit(False))).alias("nans"),
        count(lambda v: F.coalesce(d(v) == float("inf"), F.lit(False))).alias("posinf"),
        count(lambda v: F.coalesce(d(v) == -float("inf"), F.lit(False))).alias("neginf"),
    )


def argmax(x: Column) -> Column:
    """Position from 0 of the largest element, the first on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def sums_to_one(x: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(total(x) - 1) <= tolerance


def in_unit(x: Column) -> Column:
    return F.forall(x, lambda v: (v >= 0) & (v <= 1))


def any_negative(x: Column) -> Column:
    return F.exists(x, lambda v: v < 0)


def normalised(x: Column) -> Column:
    """Elements over their sum; NULL where the sum is 0."""
    s = total(x)
    return F.when(s != 0, F.transform(x, lambda v: v.cast("double") / F.when(s != 0, s)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def quadratic(x: Column, size: int) -> Column:
    """x and the products x_i x_j, i < j."""
    products = [x[i].cast("double") * x[j].cast("double") for i in range(size) for j in range(i + 1, size)]
    return F.concat(F.transform(F.slice(x, 1, size), lambda v: v.cast("double")), F.array(*products))


def recipe_hash(x: Column, digits: int = 12) -> Column:
    return F.sha2(F.to_json(F.transform(x, lambda v: F.round(v.cast("double"), digits))), 256)


def one_hot(x: Column, levels: list[str]) -> Column:
    """Indicators of all but the first level; unseen values are all 0."""
    return F.array(*[F.when(x == v, 1.0).otherwise(0.0) for v in levels[1:]])


def cubic_basis(x: Column, knots: list[float]) -> Column:
    """Truncated-power cubic spline terms: x, x^2, x^3 and (x - k)^3 above each knot."""
    above = [F.pow(F.greatest(x - F.lit(k), F.lit(0.0)), F.lit(3.0)) for k in knots]
    return F.array(x, F.pow(x, F.lit(2.0)), F.pow(x, F.lit(3.0)), *above)


def bernstein_cubic(x: Column, low: float, high: float) -> Column:
    """The cubic B-spline basis over one span [low, high] without its last term; linear beyond the ends."""
    t = (x - F.lit(low)) / F.lit(high - low)
    u = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    v, over = 1 - u, t - u
    inside = [v * v * v, 3 * u * v * v, 3 * u * u * v]
    slope = [-3 * v * v, 3 * v * (v - 2 * u), 3 * u * (2 * v - u)]
    return F.array(*[b + over * s for b, s in zip(inside, slope, strict=True)])
