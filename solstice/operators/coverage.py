"""Coverage and bookkeeping aggregates (D2-D4, D8, D9, D15, C8, B12), baseline
options (H17) and the registry lookup (C14, H16).

All are hash aggregates with a partial phase on the station key; none
collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.functions.numeric import sround
from solstice.schemas import AUTHORITATIVE_SOURCES, BASELINE_YEARS, STATION_ID_PREFIX


def station_coverage(daily: DataFrame, key: str = "station_id", date: str = "obs_date") -> DataFrame:
    """first/last date, calendar-year span, completeness % over present rows (Q21)."""
    return daily.groupBy(key).agg(
        F.min(date).alias("first_obs_date"), F.max(date).alias("last_obs_date"),
        (F.year(F.max(date)) - F.year(F.min(date)) + 1).cast("int").alias("coverage_years"),
        sround(100.0 * F.count("tavg_c") / F.count(F.lit(1)), 1).alias("completeness_temp_pct"),
        sround(100.0 * F.count("prcp_mm") / F.count(F.lit(1)), 1).alias("completeness_prcp_pct"))


def update_station_coverage(stations: DataFrame, daily: DataFrame, key: str = "station_id") -> DataFrame:
    """Station dimension refreshed from D2 (left join; stations without rows keep nulls)."""
    cov = station_coverage(daily, key)
    keep = [c for c in stations.columns if c not in cov.columns or c == key]
    return stations.select(*keep).join(cov, key, "left")


def date_range(daily: DataFrame, key: str = "station_id", date: str = "obs_date") -> DataFrame:
    """D3."""
    return daily.groupBy(key).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def baseline_years(daily: DataFrame, since_years: Sequence[int | None], stations: DataFrame,
                   key: str = "station_id", date: str = "obs_date") -> DataFrame:
    """D4 for several baselines: distinct years with data and first year, per
    (station, since_year); a baseline without data gives (0, since_year).

    Baselines are a short literal list expanded with ``explode`` (no join);
    rows are first reduced to distinct (station, year).
    """
    yrs = daily.select(key, F.year(date).alias("year")).distinct()
    arr = F.array(*[F.lit(s).cast("int") for s in since_years])
    b = yrs.select(key, "year", F.explode(arr).alias("since_year")).where(
        F.col("since_year").isNull() | (F.col("year") >= F.col("since_year")))
    agg = b.groupBy(key, "since_year").agg(F.count("year").alias("n_years"), F.min("year").alias("first_year"))
    grid = stations.select(key).distinct().select(key, F.explode(arr).alias("since_year"))
    j = grid.join(agg, [grid[key] == agg[key], grid.since_year.eqNullSafe(agg.since_year)], "left").select(
        grid[key], grid.since_year, agg.n_years, agg.first_year)
    return j.select(key, "since_year", F.coalesce("n_years", F.lit(0)).cast("int").alias("coverage_years"),
                    F.coalesce("first_year", "since_year").cast("int").alias("first_year"))


def observed_dates(df: DataFrame, keys: Sequence[str] = ("station_id", "obs_date"), source: str = "source",
                   authoritative: Sequence[str] = AUTHORITATIVE_SOURCES) -> DataFrame:
    """Distinct observed keys, flagged when an authoritative source has them."""
    return df.groupBy(*keys).agg(F.max(F.col(source).isin(*authoritative)).alias("has_authoritative"))


def last_authoritative(df: DataFrame, key: str = "station_id", date: str = "obs_date", source: str = "source",
                       authoritative: Sequence[str] = AUTHORITATIVE_SOURCES) -> DataFrame:
    """Last authoritative date per station (null when none: station skipped downstream)."""
    return df.groupBy(key).agg(F.max(F.when(F.col(source).isin(*authoritative), F.col(date))).alias("last_auth_date"))


def coverage_summary(daily: DataFrame, start, end, key: str = "station_id", date: str = "obs_date") -> DataFrame:
    """Actual vs expected days in [start, end] (start/end are columns or literals)."""
    s = F.lit(start).cast("date") if isinstance(start, str) else start
    e = F.lit(end).cast("date") if isinstance(end, str) else end
    d = daily.where((F.col(date) >= s) & (F.col(date) <= e)).withColumn("_exp", F.datediff(e, s) + 1)
    agg = d.groupBy(key).agg(
        F.count(F.lit(1)).alias("actual_days"), F.min(date).alias("min_date"), F.max(date).alias("max_date"),
        F.min("_exp").alias("expected_days"))
    return agg.select(
        key, "actual_days", "expected_days",
        sround(100.0 * F.col("actual_days") / F.col("expected_days"), 1).alias("coverage_pct"),
        (F.col("expected_days") - F.col("actual_days")).alias("missing_days"), "min_date", "max_date")


def baseline_choices(coverage: DataFrame, current_year: int, key: str = "station_id",
                     first_date: str = "first_obs_date") -> DataFrame:
    """The baseline options of every station in one pass.

    Each station row is repeated once per option (``explode`` of a five-entry
    literal list, no join); ``since_year = current_year - n + 1`` and an option
    is disabled when it starts before the station's first observed year.
    Output: key, label, since_year (null for "All"), enabled.
    """
    # Option labels in display order ("All" has no start year).
    opts = [("All", None)] + [(f"{n}yr", int(n)) for n in BASELINE_YEARS]
    arr = F.array(*[F.struct(F.lit(lbl).alias("label"), F.lit(i).alias("pos"),
                             (F.lit(current_year - n + 1) if n is not None else F.lit(None).cast("int")).alias("since_year"))
                    for i, (lbl, n) in enumerate(opts)])
    x = coverage.select(key, F.year(first_date).alias("_fy"), F.explode(arr).alias("_o"))
    disabled = F.col("_fy").isNotNull() & F.col("_o.since_year").isNotNull() & (F.col("_o.since_year") < F.col("_fy"))
    return x.select(key, F.col("_o.label").alias("label"), F.col("_o.pos").alias("position"),
                    F.col("_o.since_year").alias("since_year"), (~disabled).alias("enabled"))


def registry_lookup(requests: DataFrame, stations: DataFrame, key: str = "station_id") -> DataFrame:
    """C14 + H16: station -> wban through the registry (left join); an unknown
    station gives an error row instead of failing the job.  The GHCN id is
    ``"USW000"`` and the last five characters of the wban."""
    st = stations.select(key, "wban")
    j = requests.select(key).distinct().join(st, key, "left")
    found = F.col("wban").isNotNull()
    return j.select(
        key, "wban", F.when(found, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(found, F.concat(F.lit(STATION_ID_PREFIX), F.right(F.col("wban"), F.lit(5)))).alias("ghcn_station_id"),
        F.when(~found, F.concat(F.lit("Station "), F.col(key), F.lit(" not found in registry"))).alias("detail"))
