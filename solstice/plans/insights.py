"""Window insight (J2) and latest insights.

One plan answers every (station, end date, window) request at once; callers
filter the result.  No clock: ``as_of`` is a parameter (Q19).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.functions.classify import direction, percentile_from_quantiles, severity
from solstice.functions.numeric import sround
from solstice.functions.text import primary_statement, supporting_line
from solstice.operators.asof import latest_window
from solstice.operators.climatology import climatology
from solstice.operators.records import record_check
from solstice.operators.rolling import calendar_windows, rolling, since_filter, to_long
from solstice.schemas import DOY_HALFWIDTH, LATEST_WINDOWS, QUANTILE_NAMES


def _quantile_struct(prefix: str = "") -> F.Column:
    return F.struct(*[F.col(prefix + n).alias(n) for n in QUANTILE_NAMES],
                    F.col(prefix + "n_samples").alias("n_samples"),
                    F.col(prefix + "first_year").alias("first_year"))


def latest_insights(series: DataFrame, as_of: str, metric: str = "tavg_c",
                    windows: Sequence[int] = LATEST_WINDOWS, since_year: int | None = None,
                    stored_climatology: DataFrame | None = None, low_tail: str = "ratio",
                    halfwidth: int = DOY_HALFWIDTH) -> DataFrame:
    """Per station and window the newest usable window (C11) classified
    against the baseline ``since_year`` (default as_of year - 24), falling back
    to stored climatology when the baseline has < 10 samples (C6).

    ``series`` is the wide daily table (station_id, obs_date, metric columns).
    Output columns follow the latest-insight table (metric in the key, Q12).
    """
    as_of_year = int(str(as_of)[:4])
    if since_year is None:
        since_year = as_of_year - 24
    long = series.select("station_id", "obs_date", F.lit(metric).alias("metric_id"),
                         F.col(metric).alias("value"))
    latest = latest_window(long, windows, as_of, keys=("station_id",)).withColumn(
        "value", sround(F.col("value"), 4)).withColumn("metric_id", F.lit(metric))
    wanted = latest.select("station_id", "metric_id", "window_days",
                           F.dayofyear("end_date").alias("end_doy"))
    keys = ("station_id", "metric_id", "window_days")
    base = rolling(since_filter(long, since_year), windows, "rows_nonnull", keys=("station_id", "metric_id"))
    fly = climatology(base, keys=keys, halfwidth=halfwidth, target_doys=wanted)
    j = latest.withColumn("end_doy", F.dayofyear("end_date")).join(
        fly.select(*keys, "end_doy", _quantile_struct().alias("_fly")), [*keys, "end_doy"], "left")
    if stored_climatology is not None:
        st = stored_climatology.where(F.col("doy_window_halfwidth") == halfwidth)
        j = j.join(st.select(*keys, "end_doy", _quantile_struct().alias("_st")), [*keys, "end_doy"], "left")
        q = F.coalesce(F.col("_fly"), F.col("_st"))
    else:
        q = F.col("_fly")
    j = j.withColumn("_q", q)
    pct = percentile_from_quantiles(F.col("value"), [f"_q.{n}" for n in QUANTILE_NAMES], low_tail=low_tail)
    j = j.withColumn("_pct", pct)
    sev = severity(F.col("_pct"), coverage_ratio=F.col("coverage_ratio"))
    dirn = direction(F.col("_pct"), F.col("metric_id"))
    j = j.withColumn("severity", sev).withColumn("direction", dirn)
    cov_years = F.lit(as_of_year - since_year + 1)
    return j.select(
        "station_id", "window_days", F.col("metric_id").alias("metric"), "end_date",
        sround(F.col("value"), 2).alias("value"),
        sround(F.col("_q.p50"), 2).alias("normal_value"),
        sround(F.col("_pct"), 1).alias("percentile"),
        "severity", "direction",
        primary_statement(F.col("window_days"), F.col("severity"), F.col("direction")).alias("primary_statement"),
        supporting_line(F.col("window_days"), F.col("_pct"), F.col("direction"), cov_years,
                        F.lit(since_year), F.lit(since_year), F.lit(as_of_year)).alias("supporting_line"),
        cov_years.cast("int").alias("coverage_years"),
        F.lit(since_year).cast("int").alias("first_year"),
        F.lit(since_year).cast("int").alias("since_year"),
    )


def window_insights(series: DataFrame, climatology_table: DataFrame, records: DataFrame, coverage: DataFrame,
                    windows: Sequence[int], metric: str | Sequence[str] = "tavg_c", low_tail: str = "ratio",
                    halfwidth: int = DOY_HALFWIDTH, since_year: int | None = None,
                    baseline: DataFrame | None = None, current_year: int | None = None) -> DataFrame:
    """J2 for every (station, existing date, window) at once, default baseline
    (stored climatology, station coverage years, both downgrades, record check).

    ``metric``: one or several; ``climatology_table``: D5 rows; ``records``: D10
    rows (a metric without any has no record check); ``coverage``: D2 rows.
    With ``since_year`` the climatology is that baseline's (D7), ``baseline`` its
    D4 rows, which give coverage years and first year, and a short history
    does not downgrade; the statement names ``since_year`` to ``current_year``.
    """
    long = to_long(series, [metric] if isinstance(metric, str) else list(metric))
    cw = calendar_windows(long, windows).where(F.col("n_valid") > 0).withColumn(
        "value", sround(F.col("value"), 4)).withColumn("coverage_ratio", sround(F.col("coverage_ratio"), 4))
    keys = ["station_id", "metric_id", "window_days"]
    st = climatology_table.where(F.col("doy_window_halfwidth") == halfwidth).select(
        *keys, "end_doy", F.struct(*[F.col(n) for n in QUANTILE_NAMES], "n_samples", "first_year").alias("_q"))
    j = cw.withColumn("end_doy", F.dayofyear("end_date")).join(st, [*keys, "end_doy"], "left")
    if since_year is None:
        known = coverage.select("station_id", F.col("coverage_years").alias("_cy"), F.year("first_obs_date").alias("_fy"))
    else:
        known = baseline.where(F.col("since_year") == since_year).select(
            "station_id", F.col("coverage_years").alias("_cy"), F.col("first_year").alias("_fy"))
    j = j.join(known, "station_id", "left")
    j = record_check(j, records.select(*keys, "record_type", "value", "start_date", "end_date"), keys)
    pct = percentile_from_quantiles(F.col("value"), [f"_q.{n}" for n in QUANTILE_NAMES], low_tail=low_tail)
    cy = F.coalesce(F.col("_cy"), F.lit(0))
    if since_year is None:
        first_year = F.coalesce(F.col("_q.first_year"), F.col("_fy"), F.lit(2000))
    else:
        first_year = F.coalesce(F.col("_fy"), F.lit(since_year))
    j = j.withColumn("_pct", pct).withColumn("_cyears", cy).withColumn("_first", first_year)
    j = j.withColumn("severity", severity(F.col("_pct"), F.col("_cyears") if since_year is None else None,
                                           F.col("coverage_ratio"))).withColumn(
        "direction", direction(F.col("_pct"), F.col("metric_id")))
    return j.select(
        "station_id", "end_date", "window_days", F.col("metric_id").alias("metric"),
        primary_statement(F.col("window_days"), F.col("severity"), F.col("direction"),
                          F.col("record_type")).alias("primary_statement"),
        supporting_line(F.col("window_days"), F.col("_pct"), F.col("direction"), F.col("_cyears"), F.col("_first"),
                        None if since_year is None else F.lit(since_year),
                        None if since_year is None else F.lit(current_year)).alias("supporting_line"),
        sround(F.col("value"), 2).alias("value"), "severity", sround(F.col("_pct"), 1).alias("percentile"),
        F.col("_q.p25").alias("p25"), F.col("_q.p75").alias("p75"),
        F.col("_cyears").cast("int").alias("coverage_years"), F.col("_first").cast("int").alias("first_year"),
        "coverage_ratio", F.col("_q.n_samples").alias("n_samples"), "record_type", "record_value", "record_start", "record_end")


def window_series(series: DataFrame, climatology_table: DataFrame, window_days: int, metric: str = "tavg_c",
                  halfwidth: int = DOY_HALFWIDTH, low_tail: str = "ratio") -> DataFrame:
    """E3 value per date (nulls kept: any gap in the w rows gives no point),
    left-joined to stored climatology on (series, window, DOY) (C5), with its
    percentile and the p10..p90 band."""
    long = series.select("station_id", "obs_date", F.lit(metric).alias("metric_id"), F.col(metric).alias("value"))
    r = rolling(long, [window_days], "rows_nullable")
    keys = ["station_id", "metric_id", "window_days"]
    st = climatology_table.where(F.col("doy_window_halfwidth") == halfwidth)
    j = r.withColumn("end_doy", F.dayofyear("obs_date")).join(st, [*keys, "end_doy"], "left")
    pct = percentile_from_quantiles(F.col("value"), low_tail=low_tail)
    return j.select("station_id", F.col("obs_date").alias("date"), "window_days", sround(F.col("value"), 2).alias("value"),
                    sround(pct, 1).alias("percentile"), "p10", "p25", "p50", "p75", "p90")
