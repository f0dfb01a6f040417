"""Calendar scalars over month-start dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column) -> Column:
    """The first day of the month as a date; NULL stays NULL."""
    return F.trunc(c.cast("date"), "month")


def shift(c: Column, months) -> Column:
    return F.add_months(c, months)


def month_index(c: Column) -> Column:
    """Months since year 0: differences of it are exact month distances."""
    return (F.year(c) * 12 + F.month(c)).cast("int")


def season(c: Column) -> dict[str, Column]:
    """month, quarter and the position in the year on a circle."""
    angle = 2 * math.pi * (F.month(c) - 1) / 12
    return {"month": F.month(c), "quarter": F.quarter(c), "month_sin": F.sin(angle), "month_cos": F.cos(angle)}
