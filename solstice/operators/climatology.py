"""Day-of-year climatology.

For each target DOY 1..366 the sample is every value whose DOY lies within
+-halfwidth on the 366-slot circle.  Instead of a theta join (which would be
a nested-loop join) each value is fanned out to the 2h+1 target DOYs whose
band contains it, and the quantiles become a plain equi-``groupBy``.

Two-level aggregation keeps the fan-out small: values are first collected
per (series, DOY) -- at most one per year -- and only these arrays are fanned
out to the 2h+1 target DOYs and concatenated there, so the x15 copy is of
366 arrays per series, not of every daily row.  A target group (series,
window, DOY) holds about (2h+1) x years values because a daily series has
one value per day: bounded by the calendar however large the table.  The
quantiles are read off the sorted array (``operators.quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solstice.functions.dates import band_offsets, circular_doy_distance, doy, shift_doy
from solstice.functions.numeric import sround
from solstice.operators.quantiles import interpolated
from solstice.schemas import DOY_HALFWIDTH, MIN_SAMPLES, QUANTILE_NAMES


def climatology(rolled: DataFrame, keys: Sequence[str] = ("station_id", "metric_id", "window_days"),
                halfwidth: int = DOY_HALFWIDTH, min_samples: int = MIN_SAMPLES,
                value: str = "value", date: str = "obs_date", digits: int | None = 4,
                target_doys: DataFrame | None = None) -> DataFrame:
    """Quantiles p02..p98, n_samples, first/last year per (keys..., end_doy).

    ``rolled`` holds non-null values (e.g. ``rolling(..., "rows_nonnull")``).
    ``first_year``/``last_year`` span the whole rolled series of the key, as the
    method reports them.  Groups with fewer than ``min_samples`` values are
    skipped.  ``target_doys`` (keys subset + end_doy) restricts the result to
    wanted DOYs with a semi join after the fan-out (D6, D7).
    """
    span = Window.partitionBy(*keys)
    yr = F.year(F.col(date))
    base = rolled.select(*keys, date, value, F.min(yr).over(span).alias("first_year"),
                         F.max(yr).over(span).alias("last_year"))
    if target_doys is not None:
        # Keep only rows inside the band of some wanted DOY before fanning out
        # (semi join, no duplication), then keep only the wanted groups.
        tk = [c for c in target_doys.columns if c != "end_doy"]
        t = target_doys.withColumnRenamed("end_doy", "_t")
        cond = [base[c] == t[c] for c in tk] + [
            circular_doy_distance(doy(base[date]), t["_t"]) <= halfwidth]
        base = base.join(t, cond, "left_semi")
    per_doy = base.groupBy(*keys, doy(F.col(date)).alias("_d")).agg(
        F.collect_list(value).alias("_v"), F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"))
    fan = per_doy.select("*", F.explode(band_offsets(halfwidth)).alias("_o")).withColumn(
        "end_doy", shift_doy(F.col("_d"), F.col("_o")))
    if target_doys is not None:
        fan = fan.join(target_doys, [c for c in target_doys.columns], "left_semi")
    grp = fan.groupBy(*keys, "end_doy").agg(
        F.array_sort(F.flatten(F.collect_list("_v"))).alias("_s"),
        F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"))
    agg = grp.select(*keys, "end_doy", *interpolated(F.col("_s")), F.size("_s").cast("long").alias("n_samples"),
                     "first_year", "last_year")
    rnd = (lambda c: sround(c, digits)) if digits is not None else (lambda c: c)
    return agg.where(F.col("n_samples") >= min_samples).select(
        *keys, F.col("end_doy").cast("int").alias("end_doy"),
        F.lit(halfwidth).alias("doy_window_halfwidth"),
        *[rnd(F.col(n)).alias(n) for n in QUANTILE_NAMES],
        "n_samples", "first_year", "last_year")


def baseline_climatology(series_long: DataFrame, since_years: Sequence[int], windows: Sequence[int],
                         keys: Sequence[str] = ("station_id", "metric_id"), halfwidth: int = DOY_HALFWIDTH,
                         min_samples: int = MIN_SAMPLES, value: str = "value", date: str = "obs_date",
                         target_doys: DataFrame | None = None) -> DataFrame:
    """D6/D7 for several baselines in one job.

    Each row is repeated once per baseline it belongs to (``explode`` of the
    short literal list, no join), filtered to ``obs_date >= Jan 1 of
    since_year`` *before* rolling (Q2), and the baseline becomes part of the
    series key.
    """
    from solstice.operators.rolling import rolling
    arr = F.array(*[F.lit(int(y)) for y in since_years])
    b = series_long.withColumn("since_year", F.explode(arr)).where(
        F.col(date) >= F.make_date(F.col("since_year"), F.lit(1), F.lit(1)))
    rk = [*keys, "since_year"]
    rolled = rolling(b, windows, "rows_nonnull", value=value, keys=rk, date=date)
    return climatology(rolled, keys=[*rk, "window_days"], halfwidth=halfwidth, min_samples=min_samples,
                       value=value, date=date, target_doys=target_doys)
