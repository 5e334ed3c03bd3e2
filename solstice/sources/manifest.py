"""Manifest of landed header CSV files (A1, A2, A5, G1): known before a scan opens any of them.

When files land, ``index_landed`` reads each new file once and adds a row:
path, header, and the least and greatest key and year found in it.  ``scan``
picks the files of the wanted keys and years from the manifest and opens only
these, one scan for each distinct header, columns by name.  Files that were
indexed before are not read again.  The driver holds the picked paths, as
Spark's own listing does.

Defined cases: a file without a header line has no row; a file whose key or
year can't be read is never passed over; columns that a file lacks are null and
columns outside the schema are left out; no file picked gives an empty table.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solstice.sources.store import exists

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("header", T.StringType()),
    T.StructField("least_key", T.StringType()), T.StructField("greatest_key", T.StringType()),
    T.StructField("first_year", T.IntegerType()), T.StructField("last_year", T.IntegerType()),
])


def _by_name(spark: SparkSession, header: str, paths: list[str], schema: T.StructType) -> DataFrame:
    """The files of one header: the columns of ``schema``, and ``file``."""
    names = [n.strip() for n in next(csv.reader([header.lstrip("﻿")]))]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(text).option("header", True).csv([unquote(p) for p in paths])
    return df.select(*[(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields],
                     F.col("_metadata.file_path").alias("file"))


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(manifest) if exists(spark, manifest) else spark.createDataFrame([], MANIFEST)


def index_landed(spark: SparkSession, landing: str, manifest: str, schema: T.StructType, key: str, year: Column) -> int:
    """Add the files below ``landing`` that the manifest lacks; returns their number."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(landing).select(
        F.col("_metadata.file_path").alias("path"))
    new = [r.path for r in listed.join(read_manifest(spark, manifest).select("path"), "path", "left_anti").collect()]
    if not new:
        return 0
    lines = spark.read.text([unquote(p) for p in new]).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("header")).collect()
    by_header: dict[str, list[str]] = {}
    for r in heads:
        by_header.setdefault(r.header, []).append(r.path)
    rows = spark.createDataFrame([], MANIFEST)
    for header, paths in by_header.items():
        found = _by_name(spark, header, paths, schema).groupBy("file").agg(
            F.min(key).alias("least_key"), F.max(key).alias("greatest_key"), F.min(year).cast("int").alias("first_year"), F.max(year).cast("int").alias("last_year"))
        rows = rows.unionByName(found.select(F.col("file").alias("path"), F.lit(header).alias("header"), "least_key", "greatest_key", "first_year", "last_year"))
    empty = spark.createDataFrame([(p, h) for h, ps in by_header.items() for p in ps], "path string, header string")
    rows = empty.join(rows.drop("header"), "path", "left").select(*MANIFEST.names)  # files of a header alone, too
    rows.coalesce(1).write.mode("append").parquet(manifest)
    return len(heads)


def scan(spark: SparkSession, manifest: str, schema: T.StructType, keys: Iterable[str] | None = None,
         first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Rows of the files that may hold the wanted keys and years (rows of other keys or years in them included)."""
    m = read_manifest(spark, manifest)
    if keys is not None:
        may = F.lit(False)
        for k in keys:
            may = may | F.lit(k).between(F.col("least_key"), F.col("greatest_key"))
        m = m.where(F.col("least_key").isNull() | may)
    if first_year is not None:
        m = m.where(F.col("last_year").isNull() | (F.col("last_year") >= first_year))
    if last_year is not None:
        m = m.where(F.col("first_year").isNull() | (F.col("first_year") <= last_year))
    by_header: dict[str, list[str]] = {}
    for r in m.select("header", "path").collect():
        by_header.setdefault(r.header, []).append(r.path)
    out = spark.createDataFrame([], schema)
    for header, paths in sorted(by_header.items()):
        out = out.unionByName(_by_name(spark, header, paths, schema).drop("file"))
    return out


def scan_station_csv(spark: SparkSession, manifest: str, stations: Iterable[str] | None = None, start=None, end=None) -> DataFrame:
    """A1: raw station rows by station and days (both bounds included; rows without a readable date stay, for the quarantine)."""
    from solstice.operators.clean import parse_date
    from solstice.schemas import RAW_STATION_CSV
    year = lambda d: None if d is None else int(str(d)[:4])
    rows = scan(spark, manifest, RAW_STATION_CSV, stations, year(start), year(end))
    if stations is not None:
        rows = rows.where(F.col("STATION").isin(*stations))
    day = parse_date("DATE")
    if start is not None:
        rows = rows.where(day.isNull() | (day >= F.lit(str(start)).cast("date")))
    if end is not None:
        rows = rows.where(day.isNull() | (day <= F.lit(str(end)).cast("date")))
    return rows


def scan_gsod(spark: SparkSession, manifest: str, stations: DataFrame, wbans: Iterable[str] | None = None,
              first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """A2/G1: raw rows of the years (both included) with ``station_id``: the station of the registry whose wban ends in the file's."""
    from solstice.schemas import RAW_GSOD
    rows = scan(spark, manifest, RAW_GSOD, wbans, first_year, last_year)
    if wbans is not None:
        rows = rows.where(F.col("wban").isin(*wbans))
    year = F.col("year").try_cast("int")
    if first_year is not None:
        rows = rows.where(year >= first_year)
    if last_year is not None:
        rows = rows.where(year <= last_year)
    known = stations.select("station_id", F.right("wban", F.lit(5)).alias("wban"))
    return rows.join(known, "wban")


def index_station_csv(spark: SparkSession, landing: str, manifest: str) -> int:
    from solstice.schemas import RAW_STATION_CSV
    return index_landed(spark, landing, manifest, RAW_STATION_CSV, "STATION", F.substring("DATE", 1, 4).try_cast("int"))


def index_gsod(spark: SparkSession, landing: str, manifest: str) -> int:
    from solstice.schemas import RAW_GSOD
    return index_landed(spark, landing, manifest, RAW_GSOD, "wban", F.col("year").try_cast("int"))
