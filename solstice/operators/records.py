"""All-time records and the record check.

Arg-extremes use ``max_by``/``min_by`` with a struct key (value, date), so
ties resolve to the earliest date deterministically and the aggregate has a
partial (map-side) phase.  The value in the key is rounded to 9 decimals:
float sums taken in another order (another engine, another frame
implementation) then still see a tie as a tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.functions.numeric import sround
from solstice.operators.rolling import rolling
from solstice.schemas import WINDOW_DAYS


def all_time_extremes(long: DataFrame, windows: Sequence[int] = WINDOW_DAYS, frame: str = "rows_nonnull",
                      keys: Sequence[str] = ("station_id", "metric_id"), value: str = "value",
                      date: str = "obs_date", digits: int | None = 4) -> DataFrame:
    """Highest and lowest rolling mean per (keys, window) with its dates.

    ``n_years_considered`` = last - first year + 1 of the non-null series.
    ``frame="rows_nullable"`` gives the streak variant (E10, nulls kept).
    Output: keys..., window_days, record_type, value, start_date, end_date,
    n_years_considered.
    """
    # Year span of the non-null input: a tiny partial aggregate joined back after
    # the extremes (not a window, which would add a second shuffle before rolling).
    span = long.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        (F.max(F.year(date)) - F.min(F.year(date)) + 1).alias("n_years_considered"))
    r = rolling(long.select(*keys, date, value), windows, frame, value=value, keys=keys, date=date)
    k = sround(F.col(value), 9)
    ud = F.unix_date(F.col(date))
    agg = r.groupBy(*keys, "window_days").agg(
        F.max_by(F.struct(F.col(date).alias("d"), F.col(value).alias("v")), F.struct(k, -ud)).alias("hi"),
        F.min_by(F.struct(F.col(date).alias("d"), F.col(value).alias("v")), F.struct(k, ud)).alias("lo"))
    agg = agg.join(span, list(keys))
    rnd = (lambda c: sround(c, digits)) if digits is not None else (lambda c: c)
    recs = agg.select(*keys, "window_days", "n_years_considered", F.explode(F.array(
        F.struct(F.lit("highest").alias("record_type"), F.col("hi").alias("r")),
        F.struct(F.lit("lowest").alias("record_type"), F.col("lo").alias("r")))).alias("_x"))
    return recs.select(
        *keys, "window_days", F.col("_x.record_type").alias("record_type"), rnd(F.col("_x.r.v")).alias("value"),
        F.date_sub(F.col("_x.r.d"), F.col("window_days") - 1).alias("start_date"),
        F.col("_x.r.d").alias("end_date"), F.col("n_years_considered").cast("int").alias("n_years_considered"))


def record_check(current: DataFrame, records: DataFrame,
                 keys: Sequence[str] = ("station_id", "metric_id", "window_days"),
                 value: str = "value") -> DataFrame:
    """Current value vs stored records (C10): ``>=`` highest, else ``<=`` lowest.

    Ties count as a new record and the highest record is tested first (Q20
    parity).  Records are pivoted to one row per key (a conditional
    aggregate), then equi-joined: no theta join.  Adds record_type,
    record_value, record_start, record_end, is_new_record.
    """
    piv = records.groupBy(*keys).agg(
        F.max(F.when(F.col("record_type") == "highest", F.struct("value", "start_date", "end_date"))).alias("_hi"),
        F.max(F.when(F.col("record_type") == "lowest", F.struct("value", "start_date", "end_date"))).alias("_lo"))
    j = current.join(piv, list(keys), "left")
    v = F.col(value)
    hit_hi = F.col("_hi").isNotNull() & v.isNotNull() & (v >= F.col("_hi.value"))
    hit_lo = F.col("_lo").isNotNull() & v.isNotNull() & (v <= F.col("_lo.value"))
    rec = F.when(hit_hi, F.struct(F.lit("highest").alias("t"), F.col("_hi").alias("r"))).when(
        hit_lo, F.struct(F.lit("lowest").alias("t"), F.col("_lo").alias("r")))
    return j.withColumn("_rec", rec).select(
        *[c for c in current.columns],
        F.col("_rec.t").alias("record_type"), F.col("_rec.r.value").alias("record_value"),
        F.col("_rec.r.start_date").alias("record_start"), F.col("_rec.r.end_date").alias("record_end"),
        F.col("_rec").isNotNull().alias("is_new_record"))
