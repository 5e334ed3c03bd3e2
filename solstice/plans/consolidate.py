"""Two-source consolidation in Fahrenheit.

Primary rows (GSOD, native F) up to their cutoff; calendar gaps and every
date after the cutoff come from the fallback (station files converted to F),
restricted to the missing dates (semi join); both are normalised to
(date, min, max, avg), concatenated, and one row per (station, date) is kept,
the primary first (source names sort "BigQuery" < "GHCN Daily").
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.operators.clean import ghcn_fahrenheit, gsod_native, normalize_schema
from solstice.operators.precedence import calendar, keep_first, restrict_to

# Source labels of the consolidated table.
PRIMARY_LABEL = "BigQuery"
FALLBACK_LABEL = "GHCN Daily"


def consolidate(raw_gsod: DataFrame, raw_station_files: DataFrame, start: str, end: str, cutoff: str) -> DataFrame:
    keys = ["station_id", "date"]
    prim = normalize_schema(gsod_native(raw_gsod)).where(F.col("date") <= F.lit(cutoff).cast("date")).withColumn(
        "source", F.lit(PRIMARY_LABEL))
    stations = raw_gsod.select("station_id").union(raw_station_files.select(F.col("STATION").alias("station_id"))).distinct()
    b = stations.select("station_id", F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"))
    cal = calendar(b, date="date")
    missing = cal.join(prim.select(*keys), keys, "left_anti").unionByName(
        cal.where(F.col("date") > F.lit(cutoff).cast("date"))).distinct()
    fb = normalize_schema(ghcn_fahrenheit(raw_station_files)).withColumn("source", F.lit(FALLBACK_LABEL))
    fb = restrict_to(fb, missing, keys)
    both = prim.unionByName(fb).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return keep_first(both, keys, [F.col("source"), F.col("max"), F.col("min"), F.col("avg")])
