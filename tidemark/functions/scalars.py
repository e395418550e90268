"""Lenient conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for null.
NULL_TOKENS = ("", "null", "None", "N/A", "n/a", "unknown")


def lenient_int(c: Column) -> Column:
    """A non-negative long, or null for anything that is not one (blank, backslash-N, overflow, text)."""
    n = c.cast("string").try_cast("bigint")
    return F.when(n >= 0, n)


def lenient_string(c: Column) -> Column:
    """Null for empty and backslash-N."""
    return F.when(~c.isin("", "\\N"), c)


def lenient_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def complete_date(c: Column) -> Column:
    """Year and year-month texts become their first day; others stay."""
    c = F.trim(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))).otherwise(c)


def null_token(c: Column) -> Column:
    c = F.trim(c)
    return F.when(~c.isin(*NULL_TOKENS), c)


def digits_int(c: Column) -> Column:
    """All digits of a text as one number: `12 (3)` is 123."""
    return F.regexp_replace(c, r"[^\d\-]", "").try_cast("bigint")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 0.5 where all values are one."""
    return F.when(low == high, F.lit(0.5)).otherwise((x - low) / (high - low))


def z_score(x: Column, mean: Column, deviation: Column) -> Column:
    """0 where the deviation is 0 or unknown."""
    return F.when(F.coalesce(deviation, F.lit(0.0)) > 0, (x - mean) / deviation).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms < 1e-12, F.lit(1.0)).otherwise(1 - dot(a, b) / norms)


def unit(a: Column) -> Column:
    """Scaled to length one; the zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def sampling_key(column: Column, seed: int) -> Column:
    """An order that any engine can repeat: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))
