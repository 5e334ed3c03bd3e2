"""Percentile interpolation and classification rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from solstice.schemas import (
    MIN_COVERAGE_RATIO, MIN_COVERAGE_YEARS, QUANTILE_NAMES, QUANTILE_PCTS,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def percentile_from_quantiles(value, quantile_cols=QUANTILE_NAMES, pcts=QUANTILE_PCTS,
                              low_tail: str = "ratio") -> Column:
    """Percentile of ``value`` by linear interpolation between stored breakpoints (H5).

    * null / NaN breakpoints are skipped; no breakpoint left -> null
    * value <= lowest breakpoint: ``low_tail="ratio"`` gives ``p * value / v``
      (0.0 when v = 0), the method's rule (Q4); ``"clamp"`` gives ``p / 2``,
      the mirror of the upper tail
    * value >= highest breakpoint: ``p + (100 - p) / 2`` (99.0 for p98, Q5)
    * otherwise the first segment (in breakpoint order) holding the value wins (Q7)

    Written as one scalar CASE over the (few) breakpoint pairs, so it stays in
    whole-stage codegen; segment (i, j) exists when both ends are present and
    every breakpoint between them is missing.
    """
    v = _c(value)
    b = [_c(c).cast("double") for c in quantile_cols]
    ok = [x.isNotNull() & ~F.isnan(x) for x in b]
    bb = [F.when(o, x) for o, x in zip(ok, b)]
    n = len(bb)
    first_v = F.coalesce(*bb)
    last_v = F.coalesce(*reversed(bb))
    first_p = None
    last_p = None
    for i in range(n):
        first_p = F.when(ok[i], F.lit(float(pcts[i]))) if first_p is None else first_p.when(ok[i], F.lit(float(pcts[i])))
        j = n - 1 - i
        last_p = F.when(ok[j], F.lit(float(pcts[j]))) if last_p is None else last_p.when(ok[j], F.lit(float(pcts[j])))
    if low_tail == "ratio":
        low = F.when(first_v != 0, first_p * (v / first_v)).otherwise(F.lit(0.0))
    elif low_tail == "clamp":
        low = first_p * 0.5
    else:
        raise ValueError(f"unknown low_tail {low_tail!r}")
    high = last_p + (F.lit(100.0) - last_p) * 0.5
    out = F.when(v.isNull() | first_v.isNull(), F.lit(None).cast("double")).when(v <= first_v, low).when(v >= last_v, high)
    for i in range(n):
        for j in range(i + 1, n):
            cond = ok[i] & ok[j]
            for k in range(i + 1, j):
                cond = cond & ~ok[k]
            cond = cond & (b[i] <= v) & (v <= b[j])
            pi, pj = float(pcts[i]), float(pcts[j])
            seg = F.when(b[j] == b[i], F.lit((pi + pj) / 2.0)).otherwise(
                F.lit(pi) + (v - b[i]) / (b[j] - b[i]) * F.lit(pj - pi))
            out = out.when(cond, seg)
    return out.otherwise(F.lit(50.0))


def severity_level(pct) -> Column:
    """3 extreme, 2 unusual, 1 a_bit, 0 normal (cut points 5/15/35/65/85/95, Q8)."""
    p = _c(pct)
    return (F.when((p < 5) | (p > 95), 3)
            .when((p <= 15) | (p >= 85), 2)
            .when((p <= 35) | (p >= 65), 1)
            .otherwise(0))


def _level_name(lvl: Column) -> Column:
    return (F.when(lvl >= 3, F.lit("extreme")).when(lvl == 2, F.lit("unusual"))
            .when(lvl == 1, F.lit("a_bit")).otherwise(F.lit("normal")))


def severity(pct, coverage_years=None, coverage_ratio=None,
             min_years: int = MIN_COVERAGE_YEARS, min_ratio: float = MIN_COVERAGE_RATIO) -> Column:
    """Severity with one downgrade for short history and one for a sparse window (H6).

    ``coverage_years`` / ``coverage_ratio`` may be None (no such downgrade) or a
    column; a null value in the column also means no downgrade.
    """
    lvl = severity_level(pct)
    if coverage_years is not None:
        cy = _c(coverage_years)
        lvl = lvl - F.when(cy.isNotNull() & (cy < min_years), 1).otherwise(0)
    if coverage_ratio is not None:
        cr = _c(coverage_ratio)
        lvl = lvl - F.when(cr.isNotNull() & (cr < min_ratio), 1).otherwise(0)
    lvl = F.greatest(lvl, F.lit(0))
    return F.when(_c(pct).isNull(), F.lit("insufficient_data")).otherwise(
        _level_name(lvl))


def direction(pct, metric) -> Column:
    """warm/cold, or wet/dry when the metric starts with "prcp"; neutral at 50 or null (H7).

    ``metric`` is a Column (use ``F.lit("tavg_c")`` for a fixed metric).
    """
    p = _c(pct)
    is_prcp = _c(metric).startswith("prcp")
    return (F.when(p.isNull(), F.lit("neutral"))
            .when(p > 50, F.when(is_prcp, F.lit("wet")).otherwise(F.lit("warm")))
            .when(p < 50, F.when(is_prcp, F.lit("dry")).otherwise(F.lit("cold")))
            .otherwise(F.lit("neutral")))


def severity_display(sev, dirn) -> Column:
    """Board label from (direction, severity); unknown pairs read "Near Normal" (H12)."""
    s, d = _c(sev), _c(dirn)
    # Display labels.
    return (F.when((d == "cold") & (s == "extreme"), F.lit("Extremely Cold"))
            .when((d == "cold") & (s == "unusual"), F.lit("Unusually Cold"))
            .when((d == "cold") & (s == "a_bit"), F.lit("A Bit Colder"))
            .when((d == "warm") & (s == "extreme"), F.lit("Extremely Warm"))
            .when((d == "warm") & (s == "unusual"), F.lit("Unusually Warm"))
            .when((d == "warm") & (s == "a_bit"), F.lit("A Bit Warmer"))
            .otherwise(F.lit("Near Normal")))


def period_verdict(rank_warm, rank_cold, total) -> tuple[Column, Column, Column]:
    """Verdict words from rank position (H13): returns (word, side, rank_shown)."""
    rw, rc, n = _c(rank_warm), _c(rank_cold), _c(total)
    is_warm = rw <= rc
    rank = F.when(is_warm, rw).otherwise(rc)
    pos = rank / n
    near = F.when(is_warm, F.lit("warm")).otherwise(F.lit("cold"))
    far = F.when(is_warm, F.lit("cold")).otherwise(F.lit("warm"))
    word = (F.when(pos <= 0.05, F.concat(F.lit("unusually "), near))
            .when(pos <= 0.33, F.concat(near, F.lit("er than average")))
            .when(pos <= 0.67, F.lit("near average"))
            .otherwise(F.concat(far, F.lit("er than average"))))
    side = F.when(pos <= 0.67, F.concat(near, F.lit("est"))).otherwise(F.concat(far, F.lit("est")))
    shown = F.when(pos <= 0.67, rank).otherwise(n - rank + 1)
    return word, side, shown


def ordinal_suffix(n) -> Column:
    x = _c(n)
    return (F.when((F.pmod(x, F.lit(100)) >= 11) & (F.pmod(x, F.lit(100)) <= 13), F.lit("th"))
            .when(F.pmod(x, F.lit(10)) == 1, F.lit("st"))
            .when(F.pmod(x, F.lit(10)) == 2, F.lit("nd"))
            .when(F.pmod(x, F.lit(10)) == 3, F.lit("rd"))
            .otherwise(F.lit("th")))


def ordinal(n) -> Column:
    """English ordinal "1st", "12th", "23rd" (H14)."""
    return F.concat(_c(n).cast("string"), ordinal_suffix(n))


def deviation(value, normal) -> Column:
    """Deviation from normal, null when either side is null."""
    return _c(value) - _c(normal)
