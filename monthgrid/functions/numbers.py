"""Numeric scalars: coercion, guards and ratios.  Missing is NULL; NaN and infinities become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column) -> Column:
    """A double where the text is one, else NULL."""
    return finite(c.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or the result isn't finite."""
    return finite(a / F.nullif(b, F.lit(0.0)))


def growth(now: Column, before: Column) -> Column:
    return ratio(now, before) - 1


def at_least(c: Column, floor: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def messy_number(c: Column) -> Column:
    """Text with blanks, non-breaking blanks, a decimal comma or an exponent to a double; dashes and other junk to NULL."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(c), "[\\s\\u00A0]", ""), ",", ".")
    kept = F.regexp_replace(kept, "[^0-9eE+.\\-]", "")
    return finite(kept.try_cast("double"))


def narrowest(c: Column, lo, hi) -> str:
    """The smallest integer type that holds lo..hi."""
    for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
        if -(1 << bits) <= lo and hi < (1 << bits):
            return name
    return "bigint"
