"""Daily-series views derived from the benchmark tables.

These give the operators realistic inputs whose size grows with the data:
``lineitem`` rows become station-days, ``orders`` a second series,
``events`` a stream.  All reads are column-pruned parquet scans; every
derived table is a plain DataFrame plan (no caching, no collect).

Join strategy: ``lineitem`` (large) joins ``supplier`` (1/600 of it) and
``nation`` (fixed 25 rows).  We do not force broadcasts: Spark's size
check (``autoBroadcastJoinThreshold`` + AQE runtime stats) broadcasts the
dimension while it is small and falls back to a sort-merge join when it is
not.  Aggregation to (station, day) has a partial (map-side) phase, so a
station holding a third of all rows still ships at most one partial row per
(station, day) per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the data of the benchmark tables ends 2001-11-04.
AS_OF = "2001-11-05"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_station(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """lineitem rows tagged with the station (nation name) of their supplier.

    Fact-to-dimension chain: lineitem joins supplier, then nation.  Joining
    supplier with nation first would make Spark estimate that pair as the
    product of both sizes and pick the column-pruned lineitem as the
    broadcast side.  In this order each dimension is the build side of its
    join, and Spark's size check decides between broadcast (supplier while it
    fits ``autoBroadcastJoinThreshold``; nation, 25 rows) and sort-merge.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", *cols)
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("station_id"))
    j = li.join(sup, li.l_suppkey == sup.s_suppkey)
    return j.join(nat, j.s_nationkey == nat.n_nationkey).drop(
        "l_suppkey", "s_suppkey", "s_nationkey", "n_nationkey")


def daily_series(spark: SparkSession, sf_dir: str, offset: float = -25.0) -> DataFrame:
    """``obs``: (station_id, obs_date, tmin_c, tmax_c, tavg_c, prcp_mm), one row per station-day."""
    j = lineitem_station(spark, sf_dir, "l_shipdate", "l_quantity", "l_discount")
    return j.groupBy("station_id", F.col("l_shipdate").cast("date").alias("obs_date")).agg(
        (F.min("l_quantity") + offset).alias("tmin_c"),
        (F.max("l_quantity") + offset).alias("tmax_c"),
        (F.avg("l_quantity") + offset).alias("tavg_c"),
        (F.sum("l_discount") * 10).alias("prcp_mm"),
    )


def daily_series_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs`` with tavg_c null on days 11, 22 of each month (separates E2 from E3)."""
    return daily_series(spark, sf_dir).withColumn(
        "tavg_c", F.when(F.dayofmonth("obs_date") % 11 == 0, F.lit(None)).otherwise(F.col("tavg_c")))


def date_bounds(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """First and last day of the observations (one aggregate row)."""
    day = F.col("l_shipdate").cast("date")
    lo, hi = read_table(spark, sf_dir, "lineitem").agg(F.min(day), F.max(day)).first()
    return str(lo), str(hi)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension from ``nation``: coordinates and an active flag."""
    n = read_table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_name").alias("station_id"),
        F.format_string("%06d", 94000 + F.col("n_nationkey")).alias("wban"),
        F.col("n_name").alias("name"),
        (F.lit(25.0) + F.col("n_nationkey")).alias("lat"),
        (F.lit(-120.0) + 2 * F.col("n_nationkey")).alias("lon"),
        (F.col("n_nationkey") % 7 != 3).alias("is_active"),
    )


def raw_station_rows(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    """One raw station-file row per lineitem, as landed text (A1 input), with the lineitem columns ``carry``.

    Tenths of a degree; sentinel -9999 (orderkey % 97 = 0), swapped pair
    (% 89), unparsable 'x' (% 101), both temperatures missing (% 103); TAVG
    is null / +20 C / +15 C / midpoint by partkey % 5.
    """
    j = lineitem_station(spark, sf_dir, "l_orderkey", "l_partkey", "l_linenumber",
                         "l_quantity", "l_discount", "l_shipdate")
    tmin0 = (F.col("l_quantity") * 10 - 250).cast("int")
    tmax0 = tmin0 + 10 * F.col("l_linenumber")
    ok = F.col("l_orderkey")
    swapped = ok % 89 == 0
    tmin1 = F.when(ok % 97 == 0, F.lit(-9999)).when(swapped, tmax0).otherwise(tmin0)
    tmax1 = F.when(swapped, tmin0).otherwise(tmax0)
    mid = ((tmin0 + tmax0) / 2).cast("int")
    pk = F.col("l_partkey") % 5
    tavg = F.when(pk == 0, F.lit(None)).when(pk == 1, mid + 200).when(pk == 2, mid + 150).otherwise(mid)
    gone = ok % 103 == 0
    return j.select(
        F.col("station_id").alias("STATION"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("DATE"),
        F.when(gone, F.lit(None)).otherwise(tmin1.cast("string")).alias("TMIN"),
        F.when(gone, F.lit(None)).when(ok % 101 == 0, F.lit("x")).otherwise(tmax1.cast("string")).alias("TMAX"),
        tavg.cast("string").alias("TAVG"),
        F.round(F.col("l_discount") * 1000).cast("int").cast("string").alias("PRCP"), *carry,
    )


# The feed's deliveries end before these days; authoritative rows come 15 days late.
FEED_WAVES = ("1996-01-01", "1999-01-01")
FEED_LAG_DAYS = 15
FEED_AS_OF = "2001-10-20"


def landed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed text rows of three sources in three deliveries (``wave``).

    Provisional rows (open_meteo) come with their day, authoritative ones 15
    days later; the third wave holds stations before 'K' only and repeats some
    rows of the first with another minimum.  Some rows have no readable date
    (orderkey % 107 = 0) or name no known station (% 109).
    """
    r = raw_station_rows(spark, sf_dir, "l_orderkey", "l_linenumber", "l_shipdate")
    day, line = F.col("l_shipdate").cast("date"), F.col("l_linenumber")
    source = F.when(line <= 3, "ghcn_daily").when(line <= 5, "gsod").otherwise("open_meteo")
    known = F.when(source == "open_meteo", day).otherwise(F.date_add(day, FEED_LAG_DAYS))
    wave = F.when(known < F.lit(FEED_WAVES[0]).cast("date"), 0).when(known < F.lit(FEED_WAVES[1]).cast("date"), 1).otherwise(2)
    r = r.withColumn("source", source).withColumn("wave", wave).where((F.col("wave") < 2) | (F.col("STATION") < "K"))
    late = r.where((F.col("wave") == 0) & (F.col("source") == "ghcn_daily") & (F.col("l_orderkey") % 50 == 0) & (F.col("STATION") < "K"))
    both = r.unionByName(late.withColumn("wave", F.lit(2)).withColumn("TMIN", F.lit("-100")))
    return both.select(
        F.when(F.col("l_orderkey") % 109 == 0, "NOWHERE").otherwise(F.col("STATION")).alias("STATION"),
        F.when(F.col("l_orderkey") % 107 == 0, "n/a").otherwise(F.col("DATE")).alias("DATE"),
        "TMIN", "TMAX", "TAVG", "PRCP", "source", "wave")


def sourced_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources with conflicting rows per (station, day): source from l_returnflag."""
    j = lineitem_station(spark, sf_dir, "l_shipdate", "l_quantity", "l_discount", "l_returnflag")
    src = F.expr("CASE l_returnflag WHEN 'A' THEN 'ghcn_daily' WHEN 'N' THEN 'gsod' ELSE 'open_meteo' END")
    return j.groupBy("station_id", F.col("l_shipdate").cast("date").alias("obs_date"), src.alias("source")).agg(
        (F.min("l_quantity") - 25).alias("tmin_c"),
        (F.max("l_quantity") - 25).alias("tmax_c"),
        (F.avg("l_quantity") - 25).alias("tavg_c"),
        (F.sum("l_discount") * 10).alias("prcp_mm"),
    )


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second daily series with other keys: (o_orderpriority, day) -> AVG(o_totalprice)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("station_id"),
                     F.col("o_orderdate").cast("date").alias("obs_date")).agg(
        F.avg("o_totalprice").alias("value"))


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event table pre-aggregated to (event_type, day)."""
    e = read_table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return e.groupBy(F.col("event_type").alias("station_id"), F.col("ts").cast("date").alias("obs_date")).agg(
        F.avg("value").alias("value"), F.count("value").alias("n"))


def raw_gsod_rows(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    """One GSOD-style row per lineitem (F / inch as text): sentinel 9999.9 temp
    (orderkey % 97), both extremes missing (% 103), 99.99 precip (% 89),
    impossible date Feb 30 (% 101)."""
    j = lineitem_station(spark, sf_dir, "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")
    ok = F.col("l_orderkey")
    bad_date = ok % 101 == 0
    t = F.col("l_quantity") + 20
    gone = ok % 103 == 0
    return j.select(
        "station_id",
        F.year("l_shipdate").cast("string").alias("year"),
        F.when(bad_date, F.lit("2")).otherwise(F.month("l_shipdate").cast("string")).alias("mo"),
        F.when(bad_date, F.lit("30")).otherwise(F.dayofmonth("l_shipdate").cast("string")).alias("da"),
        F.when(ok % 97 == 0, F.lit("9999.9")).otherwise(t.cast("string")).alias("temp"),
        F.when(gone, F.lit("9999.9")).otherwise((t + F.col("l_linenumber")).cast("string")).alias("max"),
        F.when(gone, F.lit("9999.9")).otherwise((t - F.col("l_linenumber")).cast("string")).alias("min"),
        F.when(ok % 89 == 0, F.lit("99.99")).otherwise(F.col("l_discount").cast("string")).alias("prcp"), *carry,
    )


def open_meteo_documents(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Open-Meteo style documents: one per (station, month) with parallel daily
    arrays built from the ``open_meteo`` source rows; mean missing on days
    divisible by 5, extremes missing on days divisible by 7.  A document holds
    at most 31 days (bounded collect).  ``rows``: other daily rows to spell so."""
    s = sourced_daily(spark, sf_dir).where(F.col("source") == "open_meteo") if rows is None else rows
    d = F.dayofmonth("obs_date")
    rows = s.select("station_id", "obs_date",
                    F.when(d % 7 == 0, F.lit(None)).otherwise(F.col("tmin_c")).alias("tmin_c"),
                    F.when(d % 7 == 0, F.lit(None)).otherwise(F.col("tmax_c")).alias("tmax_c"),
                    F.when(d % 5 == 0, F.lit(None)).otherwise(F.col("tavg_c")).alias("tavg_c"),
                    "prcp_mm")
    g = rows.groupBy("station_id", F.trunc("obs_date", "month").alias("month")).agg(
        F.array_sort(F.collect_list(F.struct("obs_date", "tmin_c", "tmax_c", "tavg_c", "prcp_mm"))).alias("a"))
    return g.select("station_id", F.struct(
        F.transform("a", lambda x: F.date_format(x["obs_date"], "yyyy-MM-dd")).alias("time"),
        F.transform("a", lambda x: x["tmax_c"]).alias("temperature_2m_max"),
        F.transform("a", lambda x: x["tmin_c"]).alias("temperature_2m_min"),
        F.transform("a", lambda x: x["tavg_c"]).alias("temperature_2m_mean"),
        F.transform("a", lambda x: x["prcp_mm"]).alias("precipitation_sum")).alias("daily"))


# The day from which a landed source has no rows.
STATION_FILES_END, GSOD_FILES_END, DOCUMENTS_START = "2001-08-01", "2001-09-15", "2001-07-01"


#: Tasks that write the files of one station or year.
FILE_TASKS = 8


def land_files(spark: SparkSession, sf_dir: str, base: str) -> None:
    """Landed files of every kind under ``base``: registry (JSON array), station files (lines 1-3 of the orders),
    GSOD files by year (lines 4 and more), documents of the last months.  A station's or year's rows are spread over
    several files, so that no task writes all of a large one."""
    st = stations(spark, sf_dir).select("station_id", "wban", "name", F.lit(None).cast("string").alias("city"), "lat", "lon")
    array = st.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*st.columns)))), ","), F.lit("]")).alias("value"))
    array.coalesce(1).write.text(f"{base}/registry")  # the dimension
    day = F.col("l_shipdate").cast("date")
    part = F.pmod("l_orderkey", F.lit(FILE_TASKS))
    raw = raw_station_rows(spark, sf_dir, "l_orderkey", "l_linenumber", "l_shipdate")
    first = raw.where((F.col("l_linenumber") <= 3) & (day < F.lit(STATION_FILES_END).cast("date"))).drop("l_linenumber", "l_shipdate")
    first = first.withColumn("file", F.col("STATION")).repartition("file", part).drop("l_orderkey")
    first.write.partitionBy("file").option("header", True).csv(f"{base}/station_csv")
    gsod = raw_gsod_rows(spark, sf_dir, "l_orderkey", "l_linenumber", "l_shipdate").where((F.col("l_linenumber") > 3) & (day < F.lit(GSOD_FILES_END).cast("date")))
    gsod = gsod.join(st.select("station_id", F.right("wban", F.lit(5)).alias("wban")), "station_id")
    gsod = gsod.select("wban", "mo", "da", "year", "temp", "max", "min", "prcp", "l_orderkey").withColumn("file", F.col("year"))
    gsod.repartition("file", part).drop("l_orderkey").write.partitionBy("file").option("header", True).csv(f"{base}/gsod")
    recent = daily_series(spark, sf_dir).where(F.col("obs_date") >= F.lit(DOCUMENTS_START).cast("date"))
    open_meteo_documents(spark, sf_dir, recent).write.json(f"{base}/open_meteo")
