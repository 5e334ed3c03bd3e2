"""Cleaning chains for landed daily rows.

Station-daily files run B1 -> B7 -> B8 -> B9 -> B10 -> B11 in that order;
GSOD runs B3, B2, B5, B6, B11; the Open-Meteo feed only B10, B11.  Every
rule is a Column expression, so a chain is one projection inside whole-stage
codegen.  Flags for the data-quality report (B12) are computed beside the
values, so counting them costs no second pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstice.functions.numeric import f_to_c, inch_to_mm, tenths
from solstice.schemas import (
    GSOD_PRCP_SENTINEL_ABOVE, GSOD_TEMP_SENTINEL_ABOVE, PLAUSIBLE_MAX_C, PLAUSIBLE_MIN_C, TAVG_MAX_DEVIATION_C,
)


def lenient_double(c) -> Column:
    """B2: text -> double, unparsable -> null (ANSI-safe)."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def parse_date(text) -> Column:
    """ISO text -> DATE; a bad date becomes null (row quarantined), never an error."""
    return F.try_to_date(F.col(text) if isinstance(text, str) else text, "yyyy-MM-dd")


def date_from_parts(y, m, d) -> Column:
    """B3 from parts; Feb 30 etc. give null (``make_date`` would raise under ANSI)."""
    s = F.concat_ws("-", F.lpad(F.col(y).cast("string"), 4, "0"), F.lpad(F.col(m).cast("string"), 2, "0"),
                    F.lpad(F.col(d).cast("string"), 2, "0"))
    return F.try_to_date(s, "yyyy-MM-dd")


def plausible(c: Column) -> Column:
    """Outside [-90, 65] C -> null; the bounds themselves are kept."""
    return F.when(c.between(PLAUSIBLE_MIN_C, PLAUSIBLE_MAX_C), c)


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` with every column of ``df`` computed once per row.

    A plain filter after a chain of dependent ``withColumn`` steps is pushed
    below the projections with each alias substituted by its definition, so
    the whole nested chain is re-evaluated inside the predicate (about 10x the
    cost of the projection here).  A filter on a generator's output cannot
    move below the generator, so the row is materialised once through a
    one-element ``inline`` and filtered after it.
    """
    cols = df.columns
    row = df.select(F.inline(F.array(F.struct(*cols, cond.alias("_keep")))))
    return row.where(F.col("_keep")).select(*cols)


def clean_station_daily(raw: DataFrame, station: str = "STATION", flags: bool = False,
                        carry: Sequence[str] = ()) -> DataFrame:
    """A1 + B1..B11 over landed station-daily rows (all stations at once).

    Input columns (text): STATION, DATE, TMIN, TMAX, TAVG, PRCP in tenths.
    Output: station_id, obs_date, tmin_c, tmax_c, tavg_c, prcp_mm; with
    ``flags`` also the per-row quality flags used by ``quality_counters``, and
    the columns of ``carry`` as they came.
    """
    r = raw.select(
        F.col(station).alias("station_id"), parse_date("DATE").alias("obs_date"),
        tenths("TMIN").alias("t0min"), tenths("TMAX").alias("t0max"), tenths("TAVG").alias("t0avg"),
        tenths("PRCP").alias("prcp_mm"), *carry)
    r = r.select("*", *[plausible(F.col(f"t0{k}")).alias(f"t1{k}") for k in ("min", "max", "avg")])
    swapped = F.col("t1min").isNotNull() & F.col("t1max").isNotNull() & (F.col("t1min") > F.col("t1max"))
    r = r.withColumn("f_swapped", swapped)
    for k in ("min", "max", "avg"):
        r = r.withColumn(f"t2{k}", F.when(~F.col("f_swapped"), F.col(f"t1{k}")))
    mid = (F.col("t2min") + F.col("t2max")) / 2.0
    allv = F.col("t2min").isNotNull() & F.col("t2max").isNotNull() & F.col("t2avg").isNotNull()
    corrected = allv & (F.abs(F.col("t2avg") - mid) > TAVG_MAX_DEVIATION_C)
    r = r.withColumn("f_corrected", corrected).withColumn("t3avg", F.when(F.col("f_corrected"), mid).otherwise(F.col("t2avg")))
    filled = F.col("t3avg").isNull() & F.col("t2min").isNotNull() & F.col("t2max").isNotNull()
    r = r.withColumn("f_filled", filled).withColumn("t4avg", F.when(F.col("f_filled"), mid).otherwise(F.col("t3avg")))
    r = r.withColumn("f_dropped", (F.col("t2min").isNull() & F.col("t2max").isNull()) | F.col("obs_date").isNull())
    out = [F.col("station_id"), F.col("obs_date"), F.col("t2min").alias("tmin_c"), F.col("t2max").alias("tmax_c"),
           F.col("t4avg").alias("tavg_c"), F.col("prcp_mm")]
    if flags:
        out += [(F.col("t0min").isNotNull() & F.col("t1min").isNull()).alias("f_bad_tmin"),
                (F.col("t0max").isNotNull() & F.col("t1max").isNull()).alias("f_bad_tmax"),
                (F.col("t0avg").isNotNull() & F.col("t1avg").isNull()).alias("f_bad_tavg"),
                "f_swapped", "f_corrected", "f_filled", "f_dropped", *carry]
        return r.select(*out)
    kept = keep_where(r.select(*out, "f_dropped"), ~F.col("f_dropped"))
    return kept.select("station_id", "obs_date", "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


def quality_counters(flagged: DataFrame, key: str = "station_id") -> DataFrame:
    """Per-station counts of the cleaning actions (logged only by the method)."""
    return flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if("f_bad_tmin").alias("implausible_tmin"),
        F.count_if("f_bad_tmax").alias("implausible_tmax"),
        F.count_if("f_bad_tavg").alias("implausible_tavg"),
        F.count_if("f_swapped").alias("swapped_pairs"),
        F.count_if("f_corrected").alias("corrected_tavg"),
        F.count_if("f_filled").alias("filled_tavg"),
        F.count_if("f_dropped").alias("dropped_rows"))


def clean_gsod(raw: DataFrame, key: str = "station_id") -> DataFrame:
    """A2 + B3, B2, B5, B6, B11: GSOD rows in F / inch with 9999.9 / 99.99 sentinels."""
    def temp(c):
        v = lenient_double(c)
        return F.when(v <= GSOD_TEMP_SENTINEL_ABOVE, v)
    p = lenient_double("prcp")
    r = raw.select(
        F.col(key).alias("station_id"), date_from_parts("year", "mo", "da").alias("obs_date"),
        f_to_c(temp("min")).alias("tmin_c"), f_to_c(temp("max")).alias("tmax_c"),
        f_to_c(temp("temp")).alias("tavg_c"), inch_to_mm(F.when(p <= GSOD_PRCP_SENTINEL_ABOVE, p)).alias("prcp_mm"))
    return keep_where(r, F.col("obs_date").isNotNull() & (F.col("tmin_c").isNotNull() | F.col("tmax_c").isNotNull()))


def clean_open_meteo_rows(rows: DataFrame) -> DataFrame:
    """B10 + B11 on rows already zipped out of the parallel arrays (A3)."""
    mid = (F.col("tmin_c") + F.col("tmax_c")) / 2.0
    r = rows.withColumn("tavg_c", F.when(F.col("tavg_c").isNull() & F.col("tmin_c").isNotNull()
                                         & F.col("tmax_c").isNotNull(), mid).otherwise(F.col("tavg_c")))
    return r.where(F.col("tmin_c").isNotNull() | F.col("tmax_c").isNotNull())


def ghcn_fahrenheit(raw: DataFrame, station: str = "STATION") -> DataFrame:
    """Tenths C -> F (``t*9/50+32``), TAVG else midpoint, keep rows with any
    temperature (a TAVG-only row is kept here, unlike B11)."""
    def f(c):
        return lenient_double(c) * 9 / 50 + 32
    r = raw.select(F.col(station).alias("station_id"), parse_date("DATE").alias("date"),
                   f("TMAX").alias("max_temp_f"), f("TMIN").alias("min_temp_f"), f("TAVG").alias("_avg"))
    r = r.withColumn("temp_f", F.coalesce(F.col("_avg"), (F.col("max_temp_f") + F.col("min_temp_f")) / 2)).drop("_avg")
    r = keep_where(r, F.col("date").isNotNull() & F.coalesce("max_temp_f", "min_temp_f", "temp_f").isNotNull())
    return r.select("station_id", "date", F.year("date").alias("year"), F.month("date").alias("month"),
                    F.dayofmonth("date").alias("day"), "temp_f", "max_temp_f", "min_temp_f")


def gsod_native(raw: DataFrame, key: str = "station_id") -> DataFrame:
    """A10: GSOD in native F with date assembly and renames; no sentinel handling."""
    return raw.select(
        F.col(key).alias("station_id"), date_from_parts("year", "mo", "da").alias("date"),
        lenient_double("year").cast("int").alias("year"), lenient_double("mo").cast("int").alias("month"),
        lenient_double("da").cast("int").alias("day"), lenient_double("temp").alias("temp_f"),
        lenient_double("max").alias("max_temp_f"), lenient_double("min").alias("min_temp_f")).where(
        F.col("date").isNotNull())


def normalize_schema(df: DataFrame) -> DataFrame:
    """(date, min, max, avg) from either known input shape; unknown -> error."""
    cols = set(df.columns)
    if {"min_temp_f", "max_temp_f", "temp_f"} <= cols:
        return df.select(*([c for c in ("station_id",) if c in cols]), F.col("date").cast("date").alias("date"),
                         F.col("min_temp_f").alias("min"), F.col("max_temp_f").alias("max"), F.col("temp_f").alias("avg"))
    if {"date", "min", "max", "avg"} <= cols:
        return df.select(*([c for c in ("station_id",) if c in cols]), F.col("date").cast("date").alias("date"),
                         "min", "max", "avg")
    raise ValueError(f"Unknown schema: {sorted(cols)}")
