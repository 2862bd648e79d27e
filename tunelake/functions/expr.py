"""Shared column expressions. Everything here is a built-in Spark
expression, so it stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: label id that loss functions ignore.
IGNORE_INDEX = -100


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading and trailing whitespace of every kind (``trim`` only
    removes spaces)."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^\s+", ""), r"\s+$", "")


def is_blank(c) -> Column:
    return strip_ws(F.coalesce(col(c), F.lit(""))) == ""


def clean_text(c) -> Column:
    """null -> '', CR and LF -> space one for one, then strip."""
    return strip_ws(F.translate(F.coalesce(col(c), F.lit("")), "\n\r", "  "))


def seeded_md5(seed, *cols) -> Column:
    """md5 of ``seed:c1:c2...`` (hex). Partitioning independent, unlike
    ``rand(seed)``."""
    parts = [F.lit(str(seed))] + [col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hex8_to_long(h: Column) -> Column:
    """First 8 hex digits as a non-negative integer in [0, 2^32)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def seeded_bucket(seed, modulus: int, *cols) -> Column:
    return hex8_to_long(seeded_md5(seed, *cols)) % F.lit(modulus)


def seeded_uniform(seed, *cols) -> Column:
    """Deterministic uniform number in [0, 1) from the hash of the key."""
    return hex8_to_long(seeded_md5(seed, *cols)) / F.lit(4294967296.0)


def log_sigmoid(x) -> Column:
    """Numerically stable log(sigmoid(x))."""
    x = col(x)
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def nan_to_null(x) -> Column:
    x = col(x)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def round6(x) -> Column:
    return F.round(col(x), 6)
