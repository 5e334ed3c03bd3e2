"""Calendar helpers.

The day-of-year circle has 366 slots in every year; leap years are not
aligned (Q3): March 1 is DOY 60 in common years and 61 in leap years.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from solstice.schemas import DOY_SLOTS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_date_col(x) -> Column:
    return _c(x).cast("date")


def doy(x) -> Column:
    return F.dayofyear(_c(x))


def circular_doy_distance(a, b) -> Column:
    """Distance on the 366-slot circle: ``least(|a-b|, 366-|a-b|)`` (H3)."""
    d = F.abs(_c(a) - _c(b))
    return F.least(d, F.lit(DOY_SLOTS) - d)


def band_offsets(halfwidth: int) -> Column:
    """Offsets -h..h used to fan a row out to every target DOY whose band holds it."""
    if 2 * halfwidth + 1 > DOY_SLOTS:
        raise ValueError("band wider than the year")
    return F.sequence(F.lit(-halfwidth), F.lit(halfwidth))


def shift_doy(d, offset) -> Column:
    """DOY shifted on the circle: ``pmod(d - 1 + off, 366) + 1``."""
    return F.pmod(_c(d) - 1 + _c(offset), F.lit(DOY_SLOTS)) + 1
