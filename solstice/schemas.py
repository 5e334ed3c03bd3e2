"""Table schemas (A6) and the fixed parameters of the method.

Keys are enforced by the upsert operator (``operators.store``), not by the
engine.  Column order of each schema is the on-disk order; writers always
``select(*SCHEMA.names)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference method for equal results.
# ---------------------------------------------------------------------------
WINDOW_DAYS = (1, 3, 5, 7, 10, 14, 21, 28, 30, 45, 60, 75, 90, 180, 365)
CLIMATOLOGY_WINDOWS = (1, 3, 5, 7, 10, 14, 21, 28, 30, 45, 60, 90)
LATEST_WINDOWS = (1, 7, 14, 30)
STREAK_WINDOWS = (1, 3, 5, 7, 10, 14, 21, 30, 45, 60, 90)
QUANTILES = (0.02, 0.10, 0.25, 0.50, 0.75, 0.90, 0.98)
QUANTILE_NAMES = ("p02", "p10", "p25", "p50", "p75", "p90", "p98")
QUANTILE_PCTS = (2, 10, 25, 50, 75, 90, 98)
DOY_HALFWIDTH = 7
DOY_SLOTS = 366
MIN_SAMPLES = 10
MIN_COVERAGE_YEARS = 30
MIN_COVERAGE_RATIO = 0.5
RECENT_LOOKBACK_DAYS = 400
ASOF_CANDIDATES = 8
PLAUSIBLE_MIN_C = -90.0
PLAUSIBLE_MAX_C = 65.0
TAVG_MAX_DEVIATION_C = 15.0
GSOD_TEMP_SENTINEL_ABOVE = 900.0
GSOD_PRCP_SENTINEL_ABOVE = 90.0
METRICS = ("tavg_c", "tmax_c", "tmin_c", "prcp_mm")
RECORD_METRICS = ("tavg_c", "tmax_c", "tmin_c")
SEVERITY_CUTS = (5, 15, 35, 65, 85, 95)
SOURCE_PRIORITY = (("ghcn_daily", 1), ("gsod", 2), ("open_meteo", 3))
AUTHORITATIVE_SOURCES = ("ghcn_daily", "gsod")
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
BASELINE_YEARS = (25, 50, 75, 100)
STATION_ID_PREFIX = "USW000"
# ---------------------------------------------------------------------------

DAILY = T.StructType([
    T.StructField("station_id", T.StringType(), False),
    T.StructField("obs_date", T.DateType(), False),
    T.StructField("tmin_c", T.DoubleType()),
    T.StructField("tmax_c", T.DoubleType()),
    T.StructField("tavg_c", T.DoubleType()),
    T.StructField("prcp_mm", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])

STATION = T.StructType([
    T.StructField("station_id", T.StringType(), False),
    T.StructField("wban", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("elevation_m", T.DoubleType()),
    T.StructField("first_obs_date", T.DateType()),
    T.StructField("last_obs_date", T.DateType()),
    T.StructField("coverage_years", T.IntegerType()),
    T.StructField("completeness_pct", T.DoubleType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("updated_at", T.TimestampType()),
])

WINDOW_RECENT = T.StructType([
    T.StructField("station_id", T.StringType(), False),
    T.StructField("window_days", T.IntegerType(), False),
    T.StructField("end_date", T.DateType(), False),
    T.StructField("start_date", T.DateType()),
    T.StructField("tavg_c_mean", T.DoubleType()),
    T.StructField("tmin_c_mean", T.DoubleType()),
    T.StructField("tmax_c_mean", T.DoubleType()),
    T.StructField("prcp_mm_sum", T.DoubleType()),
    T.StructField("coverage_ratio", T.DoubleType()),
    T.StructField("computed_at", T.TimestampType()),
])

CLIMATOLOGY = T.StructType(
    [T.StructField("station_id", T.StringType(), False),
     T.StructField("metric_id", T.StringType(), False),
     T.StructField("window_days", T.IntegerType(), False),
     T.StructField("end_doy", T.IntegerType(), False),
     T.StructField("doy_window_halfwidth", T.IntegerType(), False)]
    + [T.StructField(n, T.DoubleType()) for n in QUANTILE_NAMES]
    + [T.StructField("n_samples", T.LongType()),
       T.StructField("first_year", T.IntegerType()),
       T.StructField("last_year", T.IntegerType()),
       T.StructField("computed_at", T.TimestampType())])

RECORDS = T.StructType([
    T.StructField("station_id", T.StringType(), False),
    T.StructField("metric_id", T.StringType(), False),
    T.StructField("window_days", T.IntegerType(), False),
    T.StructField("record_type", T.StringType(), False),
    T.StructField("value", T.DoubleType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("n_years_considered", T.IntegerType()),
    T.StructField("computed_at", T.TimestampType()),
])

LATEST_INSIGHT = T.StructType([
    T.StructField("station_id", T.StringType(), False),
    T.StructField("window_days", T.IntegerType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("end_date", T.DateType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("normal_value", T.DoubleType()),
    T.StructField("percentile", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("primary_statement", T.StringType()),
    T.StructField("supporting_line", T.StringType()),
    T.StructField("coverage_years", T.IntegerType()),
    T.StructField("first_year", T.IntegerType()),
    T.StructField("since_year", T.IntegerType()),
    T.StructField("computed_at", T.TimestampType()),
])

# Table keys (A6); the metric is part of the latest-insight key (fix Q12).
KEYS = {
    "station": ("station_id",),
    "daily": ("station_id", "obs_date"),
    "window_recent": ("station_id", "window_days", "end_date"),
    "climatology": ("station_id", "metric_id", "window_days", "end_doy", "doy_window_halfwidth"),
    "records": ("station_id", "metric_id", "window_days", "record_type"),
    "latest_insight": ("station_id", "window_days", "metric"),
}

SCHEMAS = {
    "station": STATION,
    "daily": DAILY,
    "window_recent": WINDOW_RECENT,
    "climatology": CLIMATOLOGY,
    "records": RECORDS,
    "latest_insight": LATEST_INSIGHT,
}

# Raw landed-file schemas (explicit, never inferred).
RAW_STATION_CSV = T.StructType([
    T.StructField("STATION", T.StringType()),
    T.StructField("DATE", T.StringType()),
    T.StructField("TMIN", T.StringType()),
    T.StructField("TMAX", T.StringType()),
    T.StructField("TAVG", T.StringType()),
    T.StructField("PRCP", T.StringType()),
])

RAW_GSOD = T.StructType([
    T.StructField("wban", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("mo", T.StringType()),
    T.StructField("da", T.StringType()),
    T.StructField("temp", T.StringType()),
    T.StructField("max", T.StringType()),
    T.StructField("min", T.StringType()),
    T.StructField("prcp", T.StringType()),
])

RAW_OPEN_METEO = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
        T.StructField("temperature_2m_min", T.ArrayType(T.DoubleType())),
        T.StructField("temperature_2m_mean", T.ArrayType(T.DoubleType())),
        T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
    ])),
])

REGISTRY_JSON = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("wban", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("elevation_m", T.DoubleType()),
])
