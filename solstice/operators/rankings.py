"""Seasonal rankings of the current period against every year.

The candidate rows of a target are the rolled values whose DOY lies within
+-h of the target DOY on the circle (H3).  Per-year picks are ``min_by`` /
``max_by`` aggregates with (distance or value, date) keys, so ties resolve
to the earliest date; ranks are ``row_number`` ordered by (rounded value,
year), which reproduces a stable sort: equal values keep year order (E7).
A ranking partition is one station's years: bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstice.functions.numeric import c_to_f, sround
from solstice.operators.rolling import rolling, since_filter
from solstice.schemas import DOY_HALFWIDTH, DOY_SLOTS


def _band_candidates(long: DataFrame, targets: DataFrame, window_days: int, since_year, halfwidth: int,
                     key: str = "station_id") -> DataFrame:
    s = since_filter(long.where(F.col("value").isNotNull()), since_year)
    r = rolling(s, [window_days], "rows_nonnull", keys=(key, "metric_id"))
    # Each target fans out to the days of its band, so days join by (key, day of year), not by key alone.
    t = targets.select(key, F.col("end_date").alias("target_date"), F.explode(F.sequence(F.lit(-halfwidth), F.lit(halfwidth))).alias("_k"))
    t = t.withColumn("_doy", F.pmod(F.dayofyear("target_date") - 1 + F.col("_k"), F.lit(DOY_SLOTS)) + 1)
    j = r.withColumn("_doy", F.dayofyear("obs_date")).join(t, [key, "_doy"])
    return j.withColumn("year", F.year("obs_date")).withColumn("doy_diff", F.abs("_k")).drop("_doy", "_k")


def _rank_years(per_year: DataFrame, ascending: Column, key: str = "station_id") -> DataFrame:
    """E7 + E8: rank per station by value_c (asc when ``ascending``), stable on year; add °F,
    delta to the current year, is_current, current_rank and total_years."""
    part = Window.partitionBy(key, "target_date")
    sort_key = F.when(ascending, F.col("value_c")).otherwise(-F.col("value_c"))
    ranked = per_year.withColumn("rank", F.row_number().over(part.orderBy(sort_key, F.col("year"))))
    cur_f = F.max(F.when(F.col("is_current"), c_to_f(F.col("value_c")))).over(part)
    return ranked.withColumn("value_f", c_to_f(F.col("value_c"))).withColumn(
        "delta_f", sround(F.col("value_f") - cur_f, 1)).withColumn(
        "current_rank", F.max(F.when(F.col("is_current"), F.col("rank"))).over(part)).withColumn(
        "total_years", F.count(F.lit(1)).over(part))


def seasonal_rankings(long: DataFrame, targets: DataFrame, window_days: int, since_year=None,
                      halfwidth: int = DOY_HALFWIDTH, key: str = "station_id") -> DataFrame:
    """Per station and target end date, each year's value nearest the
    target DOY (E5), ranked (E7) in the direction of the current value (D11).

    ``long``: (station_id, metric_id, obs_date, value) for one metric;
    ``targets``: (station_id, end_date).  Stations whose target year has no
    value give no rows.
    """
    c = _band_candidates(long, targets, window_days, since_year, halfwidth, key)
    per_year = c.groupBy(key, "target_date", "year").agg(
        F.min_by(F.struct("obs_date", "value"), F.struct("doy_diff", "obs_date")).alias("_p")).select(
        key, "target_date", "year", sround(F.col("_p.value"), 2).alias("value_c"),
        (F.col("year") == F.year("target_date")).alias("is_current"))
    part = Window.partitionBy(key, "target_date")
    cur = F.max(F.when(F.col("is_current"), F.col("value_c"))).over(part)
    with_pct = per_year.withColumn("_cur", cur).where(F.col("_cur").isNotNull()).withColumn(
        "pct_below", 100.0 * F.sum(F.when(F.col("value_c") < F.col("_cur"), 1).otherwise(0)).over(part)
        / F.count(F.lit(1)).over(part))
    with_pct = with_pct.withColumn("direction", F.when(F.col("pct_below") <= 50, "cold").otherwise("warm"))
    out = _rank_years(with_pct, F.col("direction") == "cold", key)
    return out.select(key, F.col("target_date").alias("end_date"), "year", "value_c", "rank", "value_f",
                      "delta_f", "is_current", "current_rank", "total_years", "direction")


def extremes_rankings(long: DataFrame, targets: DataFrame, window_days: int, direction: str = "cold",
                      since_year=None, halfwidth: int = DOY_HALFWIDTH, key: str = "station_id") -> DataFrame:
    """Each year's most extreme rolling mean inside the seasonal band
    (E6; ties -> earliest date), ranked coldest-first or warmest-first."""
    if direction not in ("cold", "warm"):
        raise ValueError("direction must be cold or warm")
    c = _band_candidates(long, targets, window_days, since_year, halfwidth, key)
    k = sround(F.col("value"), 9)
    ud = F.unix_date(F.col("obs_date"))
    pick = (F.min_by(F.struct("obs_date", "value"), F.struct(k, ud)) if direction == "cold"
            else F.max_by(F.struct("obs_date", "value"), F.struct(k, -ud)))
    per_year = c.groupBy(key, "target_date", "year").agg(pick.alias("_p")).select(
        key, "target_date", "year", sround(F.col("_p.value"), 2).alias("value_c"),
        F.date_sub(F.col("_p.obs_date"), window_days - 1).alias("start_date"),
        F.col("_p.obs_date").alias("period_end"),
        (F.col("year") == F.year("target_date")).alias("is_current"))
    part = Window.partitionBy(key, "target_date")
    per_year = per_year.withColumn("_has", F.max(F.col("is_current").cast("int")).over(part)).where(F.col("_has") == 1)
    out = _rank_years(per_year, F.lit(direction == "cold"), key)
    return out.select(key, F.col("target_date").alias("end_date"), "year", "value_c", "start_date", "period_end",
                      "rank", "value_f", "delta_f", "is_current", "current_rank", "total_years",
                      F.lit(direction).alias("direction"))


def ranking_excerpt(rankings: DataFrame, top: int = 10, around: int = 2) -> DataFrame:
    """First ``top`` rows plus +-``around`` rows of the current one."""
    return rankings.where((F.col("rank") <= top) | (F.abs(F.col("rank") - F.col("current_rank")) <= around))


def percent_below(values: DataFrame, current: DataFrame, key: str = "station_id", value: str = "value") -> DataFrame:
    """Share (in %) of a key's values strictly below its current value."""
    j = values.select(key, value).join(current.select(key, F.col(value).alias("_cur")), key)
    return j.groupBy(key).agg((100.0 * F.avg((F.col(value) < F.col("_cur")).cast("int"))).alias("pct_below"))


def percentile_of_score(values: DataFrame, current: DataFrame, key: str = "station_id",
                        value: str = "value") -> DataFrame:
    """Percentile-of-score, kind "rank" (ties averaged); nulls dropped."""
    j = values.select(key, value).where(F.col(value).isNotNull()).join(
        current.select(key, F.col(value).alias("_cur")), key)
    lt = F.sum((F.col(value) < F.col("_cur")).cast("int"))
    le = F.sum((F.col(value) <= F.col("_cur")).cast("int"))
    eq = F.max((F.col(value) == F.col("_cur")).cast("int"))
    return j.groupBy(key).agg((50.0 * (lt + le + eq) / F.count(value)).alias("percentile"))
