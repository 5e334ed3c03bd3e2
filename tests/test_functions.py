"""Literal edge cases for the scalar rules (FIXTURES.md section C)."""

import pytest
from pyspark.sql import functions as F

from solstice.functions import (
    direction, ordinal, percentile_from_quantiles, severity, shift_doy, sround, supporting_line, window_label,
)
from solstice.functions.classify import period_verdict, severity_display

Q = ["p02", "p10", "p25", "p50", "p75", "p90", "p98"]


def _pct(spark, qs, value, low_tail="ratio"):
    df = spark.createDataFrame([tuple(None if q is None else float(q) for q in qs) + (float(value),)], ", ".join(f"{q} double" for q in Q) + ", v double")
    return df.select(percentile_from_quantiles(F.col("v"), low_tail=low_tail).alias("p")).first()["p"]


def test_h5_middle(spark):
    assert _pct(spark, [0, 5, 20, 30, 40, 50, 60], 25) == pytest.approx(37.5)


def test_h5_low_tail_ratio_and_clamp(spark):
    qs = [-10, 0, 5, 10, 15, 20, 25]
    assert _pct(spark, qs, -20) == pytest.approx(4.0)
    assert _pct(spark, qs, -20, "clamp") == pytest.approx(1.0)
    assert _pct(spark, [0, 10, 20, 30, 40, 50, 60], -1) == 0.0


def test_h5_high_tail_and_null_breakpoints(spark):
    assert _pct(spark, [0, 5, 10, 15, 20, 25, 30], 30) == 99.0
    assert _pct(spark, [0, 5, 10, 15, 20, 25, None], 26) == 95.0
    # a null in the middle: the segment spans the gap
    assert _pct(spark, [0, 10, None, 30, 40, 50, 60], 20) == pytest.approx(10 + 0.5 * 40)
    assert _pct(spark, [None] * 7, 1) is None


def _sev(spark, p, years=None, ratio=None):
    df = spark.createDataFrame([(float(p), years, ratio)], "p double, y int, r double")
    y = F.col("y") if years is not None else None
    r = F.col("r") if ratio is not None else None
    return df.select(severity(F.col("p"), y, r).alias("s")).first()["s"]


@pytest.mark.parametrize("p,expected", [(4.9, "extreme"), (5, "unusual"), (15, "unusual"), (35, "a_bit"),
                                        (50, "normal"), (65, "a_bit"), (85, "unusual"), (95, "unusual"),
                                        (95.1, "extreme")])
def test_h6_cut_points(spark, p, expected):
    assert _sev(spark, p) == expected


def test_h6_downgrades(spark):
    assert _sev(spark, 1.0, years=20) == "unusual"
    assert _sev(spark, 1.0, years=20, ratio=0.29) == "a_bit"
    assert _sev(spark, 50.0, years=5, ratio=0.1) == "normal"


def test_h7_direction(spark):
    df = spark.createDataFrame([(50.0, "tavg_c"), (80.0, "prcp_mm"), (20.0, "prcp_mm"), (20.0, "tmax_c")], "p double, m string")
    got = [r[0] for r in df.select(direction(F.col("p"), F.col("m"))).collect()]
    assert got == ["neutral", "wet", "dry", "cold"]


def test_h10_half_even_formatting(spark):
    df = spark.createDataFrame([(98.5,)], "p double")
    line = df.select(supporting_line(F.lit(7), F.col("p"), F.lit("warm"), F.lit(30), F.lit(1990))).first()[0]
    assert line == "Warmer than 98% of historical weeks (since 1990, 30 years of data)."


def test_h8_labels_and_h14_ordinal(spark):
    df = spark.range(1).select(*[window_label(F.lit(w)).alias(f"w{w}") for w in (1, 7, 14, 30, 365)],
                               *[ordinal(F.lit(n)).alias(f"o{n}") for n in (1, 2, 3, 4, 11, 12, 13, 21, 22, 111)])
    r = df.first()
    assert [r["w1"], r["w7"], r["w14"], r["w30"], r["w365"]] == ["day", "week", "14-day period", "30-day period", "year"]
    assert [r[f"o{n}"] for n in (1, 2, 3, 4, 11, 12, 13, 21, 22, 111)] == \
        ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "22nd", "111th"]


def test_h12_display_and_h13_verdict(spark):
    df = spark.createDataFrame([("extreme", "cold"), ("normal", "warm"), ("a_bit", "warm")], "s string, d string")
    assert [r[0] for r in df.select(severity_display("s", "d")).collect()] == ["Extremely Cold", "Near Normal", "A Bit Warmer"]
    v = spark.createDataFrame([(1, 30, 30), (8, 23, 30), (15, 16, 30), (28, 3, 30)], "rw int, rc int, n int")
    word, side, shown = period_verdict("rw", "rc", "n")
    got = [tuple(r) for r in v.select(word, side, shown).collect()]
    assert got == [("unusually warm", "warmest", 1), ("warmer than average", "warmest", 8),
                   ("near average", "warmest", 15), ("colder than average", "coldest", 3)]


def test_c7_circular_band(spark):
    # target 1, h 3: DOY 360, 365, 1, 3, 10 -> F T T T F ; target 365: 360, 364, 365, 1, 5 -> F T T T F
    def members(target):
        df = spark.range(1, 367).withColumnRenamed("id", "d").select(F.col("d").cast("int").alias("d"))
        fan = df.select("d", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("o")).select(
            "d", shift_doy(F.col("d"), F.col("o")).alias("t"))
        return {r["d"] for r in fan.where(F.col("t") == target).collect()}
    m1 = members(1)
    assert [d in m1 for d in (360, 365, 1, 3, 10)] == [False, True, True, True, False]
    m365 = members(365)
    assert [d in m365 for d in (360, 364, 365, 1, 5)] == [False, True, True, True, False]


def test_sround_is_half_up_on_decimal_form(spark):
    df = spark.createDataFrame([(1.005,), (12.34565,), (-2.675,)], "x double")
    assert [r[0] for r in df.select(sround(F.col("x"), 2)).collect()] == [1.01, 12.35, -2.68]
