"""Landed-file scans and sinks (A1-A5, A8), and reads of the stored tables.

All scans take an explicit schema (never ``inferSchema``) and read every
file of a folder or glob in one job: one task per file split, not one
request per station.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solstice.schemas import RAW_GSOD, RAW_OPEN_METEO, RAW_STATION_CSV, REGISTRY_JSON


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV files whose columns may differ in order and number, read by name.

    The first line of every file is found in one job; files with the same
    header are one scan (pruned by file path), and the scans are united.  The
    driver holds a path per file, like any file listing.  Columns of ``schema``
    that a file lacks are null, others are left out.
    """
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    files = heads.groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    out = spark.createDataFrame([], schema)
    for r in files:
        names = next(csv.reader([r["header"].lstrip("\ufeff")]))
        text = T.StructType([T.StructField(n.strip(), T.StringType()) for n in names])
        df = spark.read.schema(text).option("header", True).csv(path)
        part = df.where(F.col("_metadata.file_path").isin(r["files"]))
        out = out.unionByName(part.select(*[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]))
    return out


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1/A5: station-daily CSV files (header, text columns), by column name."""
    return read_csv_by_name(spark, path, RAW_STATION_CSV)


def read_gsod(spark: SparkSession, path: str, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """A2/G1: year-partitioned GSOD table (``.../year=YYYY/``); the year bounds
    prune partitions instead of a UNION over year tables."""
    df = read_csv_by_name(spark, path, RAW_GSOD)
    if start_year is not None:
        df = df.where(F.col("year").cast("int") >= start_year)
    if end_year is not None:
        df = df.where(F.col("year").cast("int") <= end_year)
    return df


def read_open_meteo(spark: SparkSession, path: str) -> DataFrame:
    """A3: JSON documents with parallel daily arrays."""
    return spark.read.schema(RAW_OPEN_METEO).json(path)


def zip_daily_arrays(doc: DataFrame, key: str = "station_id") -> DataFrame:
    """A3: ``inline(arrays_zip(...))`` turns the parallel arrays into rows."""
    z = doc.select(key, F.inline(F.arrays_zip(
        F.col("daily.time").alias("time"), F.col("daily.temperature_2m_min").alias("tmin_c"),
        F.col("daily.temperature_2m_max").alias("tmax_c"), F.col("daily.temperature_2m_mean").alias("tavg_c"),
        F.col("daily.precipitation_sum").alias("prcp_mm"))))
    return z.select(key, F.try_to_date("time", "yyyy-MM-dd").alias("obs_date"), "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A4: station registry, a JSON array of objects."""
    return spark.read.schema(REGISTRY_JSON).option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """Sink by format name; an unknown format is an error (not a silent no-op)."""
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_stored(spark: SparkSession, path: str, where: dict | None = None, date_col: str | None = None,
                start=None, end=None) -> DataFrame:
    """Key / point / range read of a stored table.

    ``where`` maps columns to a value or a list of values; ``start``/``end``
    bound ``date_col`` inclusively (B4).  All are plain column predicates, so
    they reach the parquet scan: partition pruning on partition columns
    (e.g. ``station_id`` of the daily table) and row-group statistics on the
    rest.
    """
    df = spark.read.parquet(path)
    for c, v in (where or {}).items():
        df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v))
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date_col) <= F.lit(end).cast("date"))
    return df
