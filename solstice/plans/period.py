"""Period-vs-history comparison (J10: C12, D13, D14, E9, H13).

Each period of a station (<= 90 days; any number of them, told apart by their
start) is aligned to every other year by
(month, day) with an equi-join against the period's calendar; Feb 29 only
matches when the period contains it, and a period crossing New Year groups
history by calendar year (Q13, kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.functions.classify import period_verdict
from solstice.functions.numeric import sround
from solstice.operators.quantiles import exact_quantiles

BAND_Q = (0.10, 0.25, 0.50, 0.75, 0.90)
BAND_N = ("p10", "p25", "p50", "p75", "p90")


def _aligned(series: DataFrame, periods: DataFrame, value: str):
    cal = periods.select("station_id", "start_date", F.explode(F.sequence("start_date", "end_date")).alias("d")).select(
        "station_id", "start_date", F.month("d").alias("m"), F.dayofmonth("d").alias("dd"),
        F.datediff("d", "start_date").alias("day_offset"))
    s = series.select("station_id", "obs_date", F.col(value).alias("avg"))
    hist = s.withColumn("m", F.month("obs_date")).withColumn("dd", F.dayofmonth("obs_date")).join(
        cal, ["station_id", "m", "dd"]).where(F.year("obs_date") != F.year("start_date"))
    cur = s.join(periods, "station_id").where(F.col("obs_date").between(F.col("start_date"), F.col("end_date")))
    return hist, cur


def period_bands(series: DataFrame, periods: DataFrame, value: str = "tavg_c") -> DataFrame:
    """p10..p90 of the other years' values at each day offset of the period."""
    hist, _ = _aligned(series, periods, value)
    q = exact_quantiles(hist, ["station_id", "start_date", "day_offset"], "avg", BAND_Q, BAND_N, count_name="n_years")
    return q.select("station_id", "start_date", "day_offset", *[sround(F.col(n), 4).alias(n) for n in BAND_N], "n_years")


def period_verdicts(series: DataFrame, periods: DataFrame, value: str = "tavg_c") -> DataFrame:
    """D14 + E9 + H13: current mean vs yearly means of the aligned history."""
    hist, cur = _aligned(series, periods, value)
    yearly = hist.groupBy("station_id", "start_date", F.year("obs_date").alias("year")).agg(F.avg("avg").alias("ym"))
    cur_avg = cur.groupBy("station_id", "start_date", "end_date").agg(F.avg("avg").alias("current_avg"))
    j = yearly.join(cur_avg, ["station_id", "start_date"])
    agg = j.groupBy("station_id", "start_date", "end_date", "current_avg").agg(
        F.min("year").alias("earliest_year"),
        (F.sum((F.col("ym") < F.col("current_avg")).cast("int")) + 1).alias("rank_cold"),
        (F.sum((F.col("ym") > F.col("current_avg")).cast("int")) + 1).alias("rank_warm"),
        (F.count("ym") + 1).alias("total_years"))
    word, side, shown = period_verdict("rank_warm", "rank_cold", "total_years")
    return agg.select("station_id", "start_date", "end_date", sround(F.col("current_avg"), 4).alias("current_avg"),
                      "earliest_year", "rank_cold", "rank_warm", "total_years",
                      word.alias("verdict"), side.alias("side"), shown.alias("rank_shown"))
