"""Lenient numeric coercion. ANSI mode raises on bad casts, so these use try_cast."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The JVM parser also takes "1.0d" and hex floats, which are not numbers here.
_NUMBER_TEXT = r"(?i)^\s*[-+]?((\d+(\.\d*)?|\.\d+)(e[-+]?\d+)?|inf|infinity|nan)\s*$"


def text_to_double(c: Column) -> Column:
    """Number read from text; NULL where the text is not a number."""
    return F.when(c.rlike(_NUMBER_TEXT), F.trim(c).try_cast("double"))


def _truncate(c: Column) -> Column:
    # A double cast to bigint drops the fraction, so it truncates toward zero.
    # NaN and values outside the type become NULL through try_cast.
    return F.when(~F.isnan(c), c.try_cast("bigint"))


def text_as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(_truncate(text_to_double(c)), F.lit(default).cast("bigint"))


def double_as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(_truncate(c.cast("double")), F.lit(default).cast("bigint"))


def bool_as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(default).cast("bigint"))


def text_as_float(c: Column, default: float = 0.0) -> Column:
    """Text "nan" is a number and stays NaN; only unreadable text takes the default."""
    return F.coalesce(text_to_double(c), F.lit(float(default)))
