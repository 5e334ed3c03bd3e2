"""Overview board (J12: C13, F4, H12, D17, D18).

The leaderboard is a global order: it is expressed with ``orderBy`` (a
range-partitioned distributed sort), not a row_number over one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.functions.classify import deviation, severity_display
from solstice.operators.clean import keep_where


def board_rows(stations: DataFrame, insights: DataFrame, window_days: int) -> DataFrame:
    """C13 + H12 + sort keys of F4 (status order)."""
    ins = insights.where(F.col("window_days") == window_days).drop("window_days")
    j = stations.select("station_id", "name").join(ins, "station_id", "left")
    sev_order = (F.when(F.col("severity") == "extreme", 0).when(F.col("severity") == "unusual", 1)
                 .when(F.col("severity") == "a_bit", 2).when(F.col("severity") == "normal", 3)
                 .when(F.col("severity") == "insufficient_data", 4).otherwise(5))
    dir_order = F.when(F.col("direction") == "cold", 0).when(F.col("direction") == "warm", 1).otherwise(2)
    return j.select(
        "station_id", "name", F.col("end_date").isNotNull().alias("has_data"), "severity", "direction", "percentile",
        "value", "normal_value", deviation("value", "normal_value").alias("deviation"),
        severity_display(F.col("severity"), F.col("direction")).alias("display_label"),
        sev_order.alias("sev_order"), dir_order.alias("dir_order"),
        F.coalesce(F.abs(F.col("percentile") - 50), F.lit(0.0)).alias("pct_distance"))


def leaderboard(rows: DataFrame, ascending: bool = True) -> DataFrame:
    """no-data rows last; then severity, cold<warm<other, |p-50| desc (all flipped when descending)."""
    if ascending:
        keys = [F.col("sev_order").asc(), F.col("dir_order").asc(), F.col("pct_distance").desc()]
    else:
        keys = [F.col("sev_order").desc(), F.col("dir_order").desc(), F.col("pct_distance").asc()]
    return rows.orderBy(F.col("has_data").desc(), *keys, F.col("station_id"))


def outlier_summary(rows: DataFrame) -> DataFrame:
    """Stations off normal, and how many have a percentile."""
    # keep_where: the percentile is a long CASE chain; a plain filter would be
    # pushed into the insight plan and evaluate it again inside the predicate.
    with_p = keep_where(rows, F.col("percentile").isNotNull())
    return with_p.agg(F.count_if(~F.col("severity").isin("normal", "insufficient_data")).alias("outliers"),
                      F.count(F.lit(1)).alias("with_percentile"))


def percentile_histogram(rows: DataFrame) -> DataFrame:
    """bin = clamp(round_half_up(p / 2) * 2, 0, 100) and its zone."""
    b = F.greatest(F.lit(0), F.least(F.lit(100), (F.floor(F.col("percentile") / 2 + 0.5) * 2).cast("int")))
    h = keep_where(rows, F.col("percentile").isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Zone labels and their upper bounds.
    zone = (F.when(F.col("bin") < 5, "Extremely Cold").when(F.col("bin") < 15, "Unusually Cold")
            .when(F.col("bin") < 35, "A Bit Colder").when(F.col("bin") < 65, "Normal")
            .when(F.col("bin") < 85, "A Bit Warmer").when(F.col("bin") < 95, "Unusually Warm")
            .otherwise("Extremely Warm"))
    return h.withColumn("zone", zone)
