"""Backward as-of with tolerance.

"Latest end date within the last N days whose window has any data": the N
candidate dates per series are generated (``sequence``), their windows
computed by ``window_at`` (equi-join fan-out, no range join), and the newest
candidate with data wins through ``max_by`` (partial aggregation, no sort).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.operators.rolling import window_at
from solstice.schemas import ASOF_CANDIDATES


def latest_dates(series: DataFrame, as_of, key: Sequence[str] = ("station_id",), date: str = "obs_date") -> DataFrame:
    """Newest row date per series, capped at the day before ``as_of`` (I3: no partial day)."""
    cap = F.date_sub(F.lit(as_of).cast("date"), 1)
    return series.groupBy(*key).agg(F.least(F.max(date), cap).alias("latest_date"))


def latest_window(series: DataFrame, windows: Sequence[int], as_of, value: str = "value",
                  keys: Sequence[str] = ("station_id",), date: str = "obs_date",
                  candidates: int = ASOF_CANDIDATES, latest: DataFrame | None = None) -> DataFrame:
    """Per (keys, window): the newest of ``candidates`` end dates whose calendar
    window holds a valid value.  Output as ``window_at`` plus ``latest_date``."""
    if latest is None:
        latest = latest_dates(series, as_of, keys, date)
    wins = F.array(*[F.lit(int(w)) for w in windows])
    cands = latest.select(*keys, "latest_date", F.explode(wins).alias("window_days"),
                          F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("_i")).select(
        *keys, "latest_date", "window_days", F.date_sub("latest_date", F.col("_i")).alias("end_date"))
    w = window_at(series, cands, value=value, keys=keys, date=date).where(F.col("n_valid") > 0)
    best = w.groupBy(*keys, "window_days").agg(
        F.max_by(F.struct(*[c for c in w.columns if c not in (*keys, "window_days")]), F.col("end_date")).alias("_b"))
    return best.select(*keys, "window_days", "_b.*").join(latest, list(keys))
