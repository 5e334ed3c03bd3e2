"""Numeric helpers: rounding and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sround(x, digits: int) -> Column:
    """Round half-up on the value's decimal form, stable across engines.

    The value is first fixed to 12 decimals, then rounded.  Two engines that
    sum in a different order and land one ulp apart still agree, and a value
    printed as ``1.005`` rounds to ``1.01`` (B20, Q14).  Returns DOUBLE.
    """
    return F.round(_c(x).cast("decimal(38,12)"), digits).cast("double")


def c_to_f(x, digits: int | None = 1) -> Column:
    """Celsius -> Fahrenheit, rounded to 1 decimal like the reports (H2)."""
    f = _c(x) * 9.0 / 5.0 + 32.0
    return sround(f, digits) if digits is not None else f


def delta_c_to_f(x) -> Column:
    """Temperature *difference* in C -> F: scale only, no offset (H2)."""
    return _c(x) * 9.0 / 5.0


def tenths(x) -> Column:
    """Tenths of a unit -> unit, lenient: unparsable text becomes null (B1, B2)."""
    return F.try_divide(_c(x).try_cast("double"), F.lit(10.0))


def f_to_c(x) -> Column:
    return (_c(x) - 32.0) * 5.0 / 9.0


def inch_to_mm(x) -> Column:
    return _c(x) * 25.4
