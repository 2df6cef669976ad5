"""Keys, fingerprints and splits from digests: the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "20260924"


def hex_remainder(hexed: Column, modulus: int) -> Column:
    """The first 16 hex digits as an unsigned number, mod `modulus`."""
    return (F.conv(F.substring(hexed, 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def split_remainder(key: Column, seed: str = SEED, folds: int = 5) -> Column:
    return hex_remainder(F.sha2(F.concat(F.lit(seed), key), 256), folds)


def role(key: Column, seed: str = SEED, folds: int = 5) -> Column:
    return F.when(split_remainder(key, seed, folds) == 0, "holdout").otherwise("calibration")


def canonical_key(*parts: Column) -> Column:
    """Digest of the JSON list of the parts as strings."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def fingerprint(*columns: str) -> Column:
    """Digest for equality of the named fields; NULL fields are written, not dropped."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def derived_seed(master: str, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(master), *parts), 256), 1, 16)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a digest of the parts."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 52)


def short_id(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)
