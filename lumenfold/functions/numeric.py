"""Numeric Column functions.  NaN and infinities become NULL on entry and stay apart as flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as double; NULL for NaN and infinities."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)


def flags(x: Column, name: str) -> list[Column]:
    d = x.cast("double")
    inf = float("inf")
    return [
        F.coalesce(F.isnan(d), F.lit(False)).alias(f"{name}_nan"),
        F.coalesce(d == inf, F.lit(False)).alias(f"{name}_posinf"),
        F.coalesce(d == -inf, F.lit(False)).alias(f"{name}_neginf"),
    ]


def number(text: Column) -> Column:
    """A finite number or NULL; never an error."""
    return finite(text.try_cast("double"))


def positive_number(text: Column) -> Column:
    """Commas and spaces dropped; NULL unless finite and above 0."""
    n = number(F.regexp_replace(text, "[, ]", ""))
    return F.when(n > 0, n)


def token_amount(text: Column) -> Column:
    """A plain or scientific number, or a comma list of one repeated number."""
    parts = F.array_distinct(F.transform(F.split(text, ","), lambda x: F.trim(x)))
    plain = r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
    return F.when((F.size(parts) == 1) & parts[0].rlike(plain), parts[0].try_cast("double"))


def is_blank(text: Column) -> Column:
    """NULL or one of the blank markers."""
    markers = ["", "nan", "none", "n/a", "na", "null", "-", "-1", "unknown"]
    return text.isNull() | F.lower(F.trim(text)).isin(markers)


def clipped(x: Column, low: Column, high: Column) -> Column:
    """clip((x - low) / (high - low), 0, 1); +Inf is 1, -Inf 0, NaN and NULL stay missing, a flat range is missing."""
    d = x.cast("double")
    share = F.when(high > low, (d - low) / F.when(high > low, high - low))
    return F.when(d.isNull() | F.isnan(d), F.lit(None)).otherwise(
        F.when(share.isNull(), F.lit(None)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    )


def ramp(x: Column, low: Column, high: Column) -> Column:
    """0 up to low, 1 from high, linear between."""
    return F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise((x - low) / (high - low))


def strict_mean(*x: Column) -> Column:
    """NULL if any is NULL."""
    return reduce(lambda a, b: a + b, x) / F.lit(float(len(x)))


def _present(*x: Column) -> Column:
    return F.filter(F.array(*x), lambda v: v.isNotNull())


def skipping_mean(*x: Column) -> Column:
    p = _present(*x)
    return F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, v: a + v) / F.size(p))


def skipping_range(*x: Column) -> Column:
    """max - min of those present; NULL for fewer than two."""
    p = _present(*x)
    return F.when(F.size(p) > 1, F.array_max(p) - F.array_min(p))


def skipping_std(*x: Column) -> Column:
    """Population deviation of those present; NULL for fewer than two."""
    p = _present(*x)
    m = F.aggregate(p, F.lit(0.0), lambda a, v: a + v) / F.size(p)
    ss = F.aggregate(p, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return F.when(F.size(p) > 1, F.sqrt(ss / F.size(p)))


def power_law(n: Column, d: Column, e: float, a: float, alpha: float, b: float, beta: float) -> Column:
    return F.lit(e) + F.lit(a) * F.pow(n, F.lit(-alpha)) + F.lit(b) * F.pow(d, F.lit(-beta))


def effective_data_law(n, d, q, e, a, alpha, b, beta, gamma) -> Column:
    """The data term sees d * exp(gamma * q)."""
    return power_law(n, d * F.exp(F.lit(gamma) * q), e, a, alpha, b, beta)


def quality_cost(q: Column, kind: str, scale: float = 1.0, rate: float = 1.0) -> Column:
    """g(q): exp, power or log."""
    if kind == "exp":
        return F.lit(scale) * (F.exp(F.lit(rate) * q) - 1)
    if kind == "power":
        return F.lit(scale) * F.pow(q, F.lit(rate))
    return F.lit(scale) * F.log1p(F.lit(rate) * q)


def training_cost(n: Column, d: Column, context: Column, eta: float, gain: Column | None = None) -> Column:
    """6 N D + eta N D H, and what quality above the base costs per unit of D."""
    out = (F.lit(6.0) + F.lit(eta) * context) * n * d
    return out if gain is None else out + d * F.greatest(gain, F.lit(0.0))


def log_growth(before: Column, after: Column, days: Column, year: float = 365.25) -> Column:
    """Annualised log growth; NULL unless both are above 0 and days pass."""
    ok = (before > 0) & (after > 0) & (days > 0)
    return F.when(ok, F.ln(F.when(ok, after) / F.when(ok, before)) / (F.when(ok, days) / F.lit(year)))


def in_box(x: Column, low: float, high: float, y: Column, y_low: float, y_high: float) -> Column:
    """Inclusive support box: missing, inside, outside_x, outside_y or outside_both."""
    a, b = x.between(low, high), y.between(y_low, y_high)
    return (
        F.when(x.isNull() | y.isNull(), "missing").when(a & b, "inside").when(~a & b, "outside_x").when(a & ~b, "outside_y").otherwise("outside_both")
    )


def compute_of(direct: Column, n: Column, d: Column) -> tuple[Column, Column]:
    """(compute, origin): what was reported where it is above 0, else 6 N D where both are, else missing."""
    built = (n > 0) & (d > 0)
    value = F.when(direct > 0, direct).when(built, F.lit(6.0) * n * d)
    return value, F.when(direct > 0, "REPORTED").when(built, "CONSTRUCTED_6ND").otherwise("MISSING")


def quality_map(q: Column, kind: str, base: float, slope: float, low: float, high: float, grid: list[tuple[float, float]] = (), target: tuple[float, float] = (0.1, 0.6)) -> tuple[Column, Column, Column]:
    """(mapped, status, usable) of a quality by identity, an affine map about `base` (which maps to the target's upper end) or steps; outside the support it is not usable."""
    if kind == "step":
        from ..operators.joins import step_lookup

        mapped = F.when(q < low, F.lit(target[0])).when(q > high, F.lit(1.0)).otherwise(step_lookup(q, list(grid)))
        status = F.when(q < low, "OUT_OF_SUPPORT_LOW").when(q > high, "OUT_OF_SUPPORT_HIGH")
        status = status.when(mapped.between(*target), "IN_SUPPORT").when(mapped < target[0], "OUT_OF_SUPPORT_LOW").otherwise("OUT_OF_SUPPORT_HIGH")
        return mapped, status, q.between(low, high) & mapped.between(*target)
    mapped = q if kind == "identity" else F.lit(target[1]) + F.lit(slope) * (q - F.lit(base))
    ok = q.between(low, high) & mapped.between(*target)
    return mapped, F.when(ok, "IN_SUPPORT").when(mapped < target[0], "OUT_OF_SUPPORT_LOW").otherwise("OUT_OF_SUPPORT_HIGH"), ok


def scenario_effect(mapped: Column, kind: str, share: float, ratio: float, strength: float, top: float = 0.6) -> tuple[Column, Column]:
    """(added to the loss, factor on the tokens) of a mapped quality; a missing one has no effect."""
    gain = F.lit(share * ratio * strength) * (mapped - F.lit(top))
    if kind == "additive":
        return F.coalesce(-gain, F.lit(0.0)), F.lit(1.0)
    return F.lit(0.0), F.coalesce(F.exp(gain), F.lit(1.0))


def log_bin(x: Column, per_decade: int) -> Column:
    """The number of a value's equal bin of log10; NULL unless it is above 0."""
    return F.when(x > 0, F.floor(F.log10(F.when(x > 0, x)) * per_decade).cast("long"))
