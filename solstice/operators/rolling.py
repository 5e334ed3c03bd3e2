"""Rolling windows over daily series.

Four semantics exist and disagree on gappy data, so each is a named frame:

* ``rows_nonnull``  (E2) rows frame over non-null rows only, full windows only
  (pandas ``dropna().rolling(w, min_periods=w)``)
* ``rows_nullable`` (E3) rows frame over all rows; any null or missing row
  inside the w rows gives no value
* ``rows_partial``  (E1) rows frame, partial windows allowed, nulls skipped
* ``calendar``      (E4) the w calendar days ending at the row's date

Physical plan: every window size is one more frame over the same
``partitionBy(keys).orderBy(date)`` spec, so Spark plans one exchange and one
sort for all of them (Exchange -> Sort -> Window).  The partition is one daily
series: at most one row per calendar day, so its size is bounded by the
length of the calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstice.operators.partitioning import cluster_by_series
from solstice.schemas import METRICS

FRAMES = ("rows_nonnull", "rows_nullable", "rows_partial", "calendar")


def to_long(df: DataFrame, metrics: Sequence[str] = METRICS,
            keys: Sequence[str] = ("station_id", "obs_date")) -> DataFrame:
    """Wide -> long once (B16): (keys..., metric_id, value)."""
    return df.unpivot(list(keys), list(metrics), "metric_id", "value")


def since_filter(df: DataFrame, since_year, date: str = "obs_date") -> DataFrame:
    """Baseline filter (B14) written as a date bound so parquet min/max stats prune."""
    if since_year is None:
        return df
    if isinstance(since_year, int):
        return df.where(F.col(date) >= F.make_date(F.lit(since_year), F.lit(1), F.lit(1)))
    return df.where(F.col(date) >= F.make_date(F.col(since_year), F.lit(1), F.lit(1)))


def _frame(keys: Sequence[str], date: str, w: int, frame: str):
    base = Window.partitionBy(*keys)
    if frame == "calendar":
        return base.orderBy(F.unix_date(F.col(date))).rangeBetween(-(w - 1), 0)
    return base.orderBy(date).rowsBetween(-(w - 1), 0)


def rolling_value(value: str, keys: Sequence[str], date: str, w: int, frame: str, agg: str = "avg") -> Column:
    """Rolling aggregate of one window size under one frame semantics."""
    if frame not in FRAMES:
        raise ValueError(f"frame must be one of {FRAMES}")
    f = _frame(keys, date, w, frame)
    fn = F.avg if agg == "avg" else F.sum
    rolled = fn(value).over(f)
    if frame in ("rows_nonnull", "rows_nullable"):
        return F.when(F.count(value).over(f) == w, rolled)
    return rolled


_EXACT = "decimal(38,18)"


def _number(value: str) -> Column:
    """The value, or null for NaN: a day without a number is a missing day."""
    return F.when(~F.isnan(value), F.col(value))


def prefix_stage(df: DataFrame, value: str, keys: Sequence[str], date: str, tag: str = "") -> DataFrame:
    """Add running exact sum / count / row number of ``value`` per series.

    A rows frame of w rows is then ``run - lag(run, w)``: O(1) per row and
    window, where Spark's sliding frame re-aggregates all w rows for every
    row.  The running sum is DECIMAL, so the difference is exact (no float
    cancellation, and equal multisets give equal sums).
    """
    o = Window.partitionBy(*keys).orderBy(date)
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"_cs{tag}", F.coalesce(F.sum(F.col(value).cast(_EXACT)).over(run), F.lit(0).cast(_EXACT))) \
             .withColumn(f"_cc{tag}", F.count(value).over(run))


def prefix_window(value: str, keys: Sequence[str], date: str, w: int, frame: str, agg: str = "avg",
                  tag: str = "") -> Column:
    """Rows-frame aggregate of the last ``w`` rows from ``prefix_stage`` columns."""
    o = Window.partitionBy(*keys).orderBy(date)
    cs, cc = F.col(f"_cs{tag}"), F.col(f"_cc{tag}")
    s = cs - F.coalesce(F.lag(cs, w).over(o), F.lit(0).cast(_EXACT))
    c = cc - F.coalesce(F.lag(cc, w).over(o), F.lit(0))
    if frame in ("rows_nonnull", "rows_nullable"):
        return F.when(c == w, (s / F.lit(w)).cast("double"))
    if frame == "rows_partial":
        return F.when(c > 0, (s if agg == "sum" else s / c).cast("double"))
    raise ValueError(frame)


def rolling(df: DataFrame, windows: Sequence[int], frame: str = "rows_nonnull",
            value: str = "value", keys: Sequence[str] = ("station_id", "metric_id"),
            date: str = "obs_date", agg: str = "avg", keep_null: bool = False,
            carry: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Long rolling table: (keys..., date, window_days, value, carry...).

    ``rows_nonnull`` first drops null values (B17).  Rows without a value
    for a window are dropped unless ``keep_null``.  The input is clustered by
    the series key (see ``operators.partitioning``), so jobs downstream that
    group by (keys, window_days, ...) need no further shuffle.
    """
    df = df.withColumn(value, _number(value))
    src = df.where(F.col(value).isNotNull()) if frame == "rows_nonnull" else df
    src = cluster_by_series(src, keys, partitions)
    if frame == "calendar":
        cols = [F.struct(F.lit(w).alias("window_days"),
                         rolling_value(value, keys, date, w, frame, agg).alias("v")).alias(f"_w{i}")
                for i, w in enumerate(windows)]
    else:
        src = prefix_stage(src, value, keys, date)
        cols = [F.struct(F.lit(w).alias("window_days"),
                         prefix_window(value, keys, date, w, frame, agg).alias("v")).alias(f"_w{i}")
                for i, w in enumerate(windows)]
    staged = src.select(*keys, date, *carry, *cols)
    out = staged.select(*keys, date, *carry,
                        F.explode(F.array(*[F.col(f"_w{i}") for i in range(len(windows))])).alias("_w")).select(
        *keys, date, F.col("_w.window_days").alias("window_days"), F.col("_w.v").alias(value), *carry)
    return out if keep_null else out.where(F.col(value).isNotNull())


def calendar_windows(df: DataFrame, windows: Sequence[int], value: str = "value",
                     keys: Sequence[str] = ("station_id", "metric_id"), date: str = "obs_date") -> DataFrame:
    """E4 at every existing date: mean, n_valid and coverage of the w days ending there.

    Output (keys..., end_date, window_days, start_date, value, n_valid, coverage_ratio);
    value is null when the window holds no valid value.  A NaN is no value (B19).
    """
    df = cluster_by_series(df.withColumn(value, _number(value)), keys)
    cols = []
    for i, w in enumerate(windows):
        f = _frame(keys, date, w, "calendar")
        cols.append(F.struct(F.lit(w).alias("window_days"), F.avg(value).over(f).alias("v"),
                             F.count(value).over(f).alias("n")).alias(f"_w{i}"))
    staged = df.select(*keys, date, *cols)
    out = staged.select(*keys, date, F.explode(F.array(*[F.col(f"_w{i}") for i in range(len(windows))])).alias("_w"))
    return out.select(
        *keys, F.col(date).alias("end_date"), F.col("_w.window_days").alias("window_days"),
        F.date_sub(F.col(date), F.col("_w.window_days") - 1).alias("start_date"),
        F.col("_w.v").alias("value"), F.col("_w.n").alias("n_valid"),
        (F.col("_w.n") / F.col("_w.window_days")).alias("coverage_ratio"))


def window_at(series: DataFrame, ends: DataFrame, value: str = "value",
              keys: Sequence[str] = ("station_id",), date: str = "obs_date") -> DataFrame:
    """Calendar window ending at requested dates, which need not exist as rows.

    ``ends`` has (keys..., end_date, window_days).  Each request fans out to its
    w dates (bounded by w), is equi-joined to the series and aggregated; no
    range join.  Output (keys..., end_date, window_days, start_date, value,
    n_valid, coverage_ratio); requests whose window holds no valid value get
    ``value`` null and ``n_valid`` 0; a NaN is no value (B19).
    """
    req = ends.select(*keys, "end_date", "window_days")
    days = req.select(*keys, "end_date", "window_days",
                      F.explode(F.sequence(F.lit(0), F.col("window_days") - 1)).alias("_k")).select(
        *keys, "end_date", "window_days", F.date_sub("end_date", F.col("_k")).alias(date))
    s = series.select(*keys, date, _number(value).alias(value))
    j = days.join(s, [*keys, date], "left")
    agg = j.groupBy(*keys, "end_date", "window_days").agg(
        F.avg(value).alias("value"), F.count(value).alias("n_valid"))
    return agg.select(*keys, "end_date", "window_days",
                      F.date_sub("end_date", F.col("window_days") - 1).alias("start_date"),
                      "value", "n_valid", (F.col("n_valid") / F.col("window_days")).alias("coverage_ratio"))


def _running(values: Sequence[str], keys: Sequence[str], date: str) -> Column:
    """One struct per row: the exact running sum and count of every value of the series up to the row.

    For several values in one pass: one lag of the struct serves all of them (see ``prefix_stage`` for a single value).
    """
    run = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(_EXACT)
    return F.struct(*[c for i, v in enumerate(values) for c in (
        F.coalesce(F.sum(F.col(v).cast(_EXACT)).over(run), zero).alias(f"s{i}"), F.count(v).over(run).alias(f"c{i}"))])


def _before(run: str, windows: Sequence[int], keys: Sequence[str], date: str) -> Column:
    """Per window size its number of rows and the running struct just before the window (null: the series begins in it)."""
    o = Window.partitionBy(*keys).orderBy(date)
    return F.array(*[F.struct(F.lit(w).alias("window_days"), F.lag(run, w).over(o).alias("p")) for w in windows])


def _sum_and_count(i: int, run: str = "_run", before: str = "_w.p") -> tuple[Column, Column]:
    """Sum and count of value ``i`` in the window of an exploded row."""
    s = F.col(f"{run}.s{i}") - F.coalesce(F.col(f"{before}.s{i}"), F.lit(0).cast(_EXACT))
    return s, F.col(f"{run}.c{i}") - F.coalesce(F.col(f"{before}.c{i}"), F.lit(0))


def recent_windows(daily: DataFrame, windows: Sequence[int], lookback_days: int = 400,
                   key: str = "station_id", date: str = "obs_date") -> DataFrame:
    """For every end date in the last ``lookback_days`` of each station, all
    window sizes, rows frame with partial windows: means of tavg/tmin/tmax,
    *sum* of precipitation (Q17), coverage = count(tavg) / w.

    History is cut at ``last - lookback - max(windows)`` days before rolling,
    as the method does (a rows frame does not let Catalyst push that filter).
    The last dates are a partial aggregate joined back, so only the cut
    history is shuffled and sorted.
    """
    wmax = max(windows)
    last = daily.groupBy(key).agg(F.max(date).alias("_last"))
    src = daily.select(key, date, *[_number(m).alias(m) for m in ("tavg_c", "tmin_c", "tmax_c", "prcp_mm")]).join(last, key).where(
        F.col(date) >= F.date_sub("_last", lookback_days + wmax))
    src = cluster_by_series(src, [key])
    metrics = ("tavg_c", "tmin_c", "tmax_c", "prcp_mm")
    staged = src.withColumn("_run", _running(metrics, [key], date)).select(
        key, date, "_last", "_run", _before("_run", windows, [key], date).alias("_a"))
    out = staged.where(F.col(date) >= F.date_sub("_last", lookback_days)).select(key, date, "_run", F.explode("_a").alias("_w"))
    values = []
    for i, (m, agg) in enumerate(zip(metrics, ("mean", "mean", "mean", "sum"))):
        total, count = _sum_and_count(i)
        values.append(F.when(count > 0, (total if agg == "sum" else total / count).cast("double")).alias(f"{m}_{agg}"))
    return out.select(
        key, F.col("_w.window_days").alias("window_days"), F.col(date).alias("end_date"),
        F.date_sub(F.col(date), F.col("_w.window_days") - 1).alias("start_date"),
        *values, (_sum_and_count(0)[1] / F.col("_w.window_days").cast("double")).alias("coverage_ratio"))
