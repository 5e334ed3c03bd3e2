"""Source precedence, dedupe, gap filling and keyed upsert.

Keep-one-per-key is a ``groupBy`` with ``max_by``/``min_by`` over a struct
ordering key rather than ``row_number`` over a sorted window: the aggregate
has a map-side partial phase, so a key repeated many times (one station, one
day, many deliveries) is reduced before the shuffle, and the choice is
deterministic (``dropDuplicates`` is not).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstice.schemas import AUTHORITATIVE_SOURCES, SOURCE_PRIORITY


def priority_of(source: Column, priorities=SOURCE_PRIORITY) -> Column:
    expr = None
    for name, p in priorities:
        expr = F.when(source == name, F.lit(p)) if expr is None else expr.when(source == name, F.lit(p))
    return expr.otherwise(F.lit(max(p for _, p in priorities) + 1))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the smallest by ``order``."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in cols])


def resolve_precedence(df: DataFrame, keys: Sequence[str] = ("station_id", "obs_date"), source: str = "source",
                       ingested_at: str | None = "ingested_at", priorities=SOURCE_PRIORITY) -> DataFrame:
    """Per key the row of the best source; among equals the latest delivery.

    Authoritative rows are never replaced by provisional ones, whatever the
    arrival order (fix Q10, Q23).
    """
    order = [priority_of(F.col(source), priorities)]
    if ingested_at and ingested_at in df.columns:
        order.append(-F.unix_micros(F.col(ingested_at).cast("timestamp")))
    return keep_first(df, keys, order)


def gap_fill(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = ("station_id", "obs_date")) -> DataFrame:
    """Secondary rows only for keys absent from the primary (anti join)."""
    return secondary.join(primary.select(*keys), list(keys), "left_anti")


def provisional_fill(existing: DataFrame, provisional: DataFrame, as_of, key: str = "station_id",
                     date: str = "obs_date", source: str = "source",
                     authoritative: Sequence[str] = AUTHORITATIVE_SOURCES) -> DataFrame:
    """Provisional rows after the station's last authoritative date and
    before ``as_of`` (partial-day guard, I3), minus authoritative keys.
    Stations without any authoritative date are skipped (D9 null)."""
    auth = existing.where(F.col(source).isin(*authoritative))
    last = auth.groupBy(key).agg(F.max(date).alias("_last"))
    cap = F.lit(as_of).cast("date")
    p = provisional.join(last, key).where((F.col(date) > F.col("_last")) & (F.col(date) < cap)).drop("_last")
    return p.join(auth.select(key, date), [key, date], "left_anti")


def calendar(bounds: DataFrame, key: str = "station_id", start: str = "start_date", end: str = "end_date",
             date: str = "obs_date") -> DataFrame:
    """Daily calendar per key between two dates (size = days in the range)."""
    return bounds.select(key, F.explode(F.sequence(F.col(start), F.col(end))).alias(date))


def calendar_gaps(daily: DataFrame, start, end, cutoff=None, key: str = "station_id",
                  date: str = "obs_date", stations: DataFrame | None = None) -> DataFrame:
    """Expected dates in [start, end] minus observed ones, plus every
    date after ``cutoff`` (set union).  ``stations`` names all keys; a key
    without any row misses every date."""
    keys = (daily if stations is None else stations).select(key).distinct()
    b = keys.select(key, F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"))
    cal = calendar(b, key, date=date)
    missing = cal.join(daily.select(key, date), [key, date], "left_anti")
    if cutoff is not None:
        after = cal.where(F.col(date) > F.lit(cutoff).cast("date"))
        missing = missing.unionByName(after).distinct()
    return missing


def restrict_to(df: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("station_id", "obs_date")) -> DataFrame:
    """C4: rows whose key is in ``wanted`` (left semi join)."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """A7 as a plan: ``new`` deduplicated on the key replaces ``old`` rows with the same key."""
    if order is not None:
        new = keep_first(new, keys, order)
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
