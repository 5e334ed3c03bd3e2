"""Backfill (J1): landed files to all stored tables, as a job graph that can be started again.

The steps run in order for all stations at once, each one commit of the store:
the table and the step's rows of the run ledger (D16) change together.  A run
that was killed is called again with its ``run_id``: an interrupted commit is
finished, steps that the ledger has are skipped, the rest follows.  Every table
goes through its contract (A6) and the keyed merge (A7), so another run over
the same files leaves the same rows.

``seed`` merges the registry into the dimension by column groups (A4): the
registry's columns are replaced, measured coverage stays, stations that left
the registry are kept but inactive.  ``ingest`` reads station files (A1), GSOD
files for the days they lack (A2, C1) and provisional documents after each
station's last authoritative day (A3, C2); rejected rows go to the quarantine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.operators.clean import clean_gsod, clean_open_meteo_rows, clean_station_daily
from solstice.operators.climatology import climatology
from solstice.operators.precedence import gap_fill, priority_of, provisional_fill
from solstice.operators.records import all_time_extremes
from solstice.operators.rolling import recent_windows, rolling, to_long
from solstice.plans.insights import latest_insights
from solstice.schemas import CLIMATOLOGY_WINDOWS, METRICS, RECORD_METRICS, REGISTRY_JSON, WINDOW_DAYS
from solstice.sources.files import read_open_meteo, read_registry, zip_daily_arrays
from solstice.sources.manifest import index_gsod, index_station_csv, scan_gsod, scan_station_csv
from solstice.sources.store import Store, station_coverage_of
from solstice.streaming.refresh import coverage_change, coverage_rows, ledger_rows, rejected_row

DAILY_COLUMNS = ("station_id", "obs_date", "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


@dataclass(frozen=True)
class Landed:
    """Folders of landed files; None: not delivered.  ``manifests``: where the manifests of the CSV files are kept."""

    registry: str
    station_csv: str
    manifests: str
    gsod: str | None = None
    open_meteo: str | None = None


@dataclass(frozen=True)
class Run:
    store: Store
    landed: Landed
    run_id: str
    as_of: str
    at: str


#: A step's staged tables, and rows (station_id, rows, source, errors) for the ledger.
Step = Callable[[Run], tuple[dict[str, str], DataFrame]]


def seeded(store: Store, registry: DataFrame) -> DataFrame:
    """A4: the dimension after a registry delivery (the first of repeated entries by column order; rows without id are left out)."""
    cols = [c for c in REGISTRY_JSON.names if c != "station_id"]
    one = registry.where("station_id is not null").groupBy("station_id").agg(F.min(F.struct(*cols)).alias("new"))
    old = store.read("station")
    rest = [c for c in store.tables["station"].schema.names if c not in ("station_id", "is_active", *cols)]
    j = old.join(one, "station_id", "full")
    present = F.col("new").isNotNull()
    return j.select("station_id", *[F.when(present, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in cols], *rest, present.alias("is_active"))


def _whole(run: Run, name: str, rows: DataFrame, order=()) -> tuple[dict[str, str], DataFrame]:
    """Merge computed rows into their table; the ledger counts them by station."""
    checked = run.store.written(run.store.conform(name, rows, run.at))
    good = checked.where(F.size("problems") == 0)
    merged = run.store.merge(name, good, order)
    counts = good.groupBy("station_id").agg(F.count(F.lit(1)).alias("rows"))
    staged = {} if merged is None else {name: run.store.stage(name, merged.select(*run.store.tables[name].stored.names))}
    return staged, counts.select("station_id", "rows", F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("errors"))


def _seed(run: Run) -> tuple[dict[str, str], DataFrame]:
    return _whole(run, "station", seeded(run.store, read_registry(run.store.spark, run.landed.registry)))


def _active(run: Run) -> DataFrame:
    return run.store.read("station").where("is_active").select("station_id", "wban")


def _ingest(run: Run) -> tuple[dict[str, str], DataFrame]:
    store, landed, spark = run.store, run.landed, run.store.spark
    stations, known = _active(run), store.read("station").select("station_id", "is_active")
    index_station_csv(spark, landed.station_csv, f"{landed.manifests}/station_csv")
    raw = scan_station_csv(spark, f"{landed.manifests}/station_csv")
    rows = clean_station_daily(raw.withColumn("landed", F.struct(*raw.columns)), flags=True, carry=("landed",)).join(known, "station_id", "left")
    problem = (F.when(F.col("is_active").isNull(), "unknown station").when(F.col("obs_date").isNull(), "unreadable date").when(F.col("f_dropped"), "no temperature"))
    rows = store.written(rows.where(F.coalesce("is_active", F.lit(True))).withColumn("problem", problem).select(*DAILY_COLUMNS, "problem", rejected_row()))
    before = F.col("obs_date") < F.lit(run.as_of).cast("date")
    primary = rows.where("problem is null").where(before).select(*DAILY_COLUMNS, F.lit("ghcn_daily").alias("source"))
    sourced = primary
    if landed.gsod is not None:
        index_gsod(spark, landed.gsod, f"{landed.manifests}/gsod")
        span = primary.groupBy("station_id").agg(F.year(F.min("obs_date")).alias("_y0"), F.year(F.max("obs_date")).alias("_y1"))
        bounds = span.agg(F.min("_y0"), F.max("_y1")).first()
        if bounds[0] is not None:  # years of the primary source: files of other years are not opened
            second = clean_gsod(scan_gsod(spark, f"{landed.manifests}/gsod", stations, None, bounds[0], bounds[1])).where(before)
            second = second.join(span, "station_id").where(F.year("obs_date").between(F.col("_y0"), F.col("_y1"))).select(*DAILY_COLUMNS, F.lit("gsod").alias("source"))
            sourced = primary.unionByName(store.written(gap_fill(primary, second), "gap-fill"))  # read by the provisional fill, too
    if landed.open_meteo is not None:
        recent = clean_open_meteo_rows(zip_daily_arrays(read_open_meteo(spark, landed.open_meteo)))
        recent = recent.join(stations.select("station_id"), "station_id", "left_semi").select(*DAILY_COLUMNS, F.lit("open_meteo").alias("source"))
        sourced = sourced.unionByName(provisional_fill(sourced, recent, run.as_of))
    checked = store.written(store.conform("daily", sourced, run.at))
    merged = store.merge("daily", checked.where(F.size("problems") == 0), [-priority_of(F.col("source"))])
    broken = checked.where(F.size("problems") > 0).select("station_id", F.array_join("problems", "; ").alias("problem"), F.lit(None).cast("string").alias("row"))
    bad = rows.where("problem is not null").select("station_id", "problem", "row").unionByName(broken)
    staged = {"quarantine": store.stage("quarantine", bad.select(F.lit(run.run_id).alias("run_id"), F.lit(0).cast("long").alias("batch"), "station_id", "problem", "row"))}
    change = None
    if merged is not None:
        staged["daily"] = store.stage("daily", merged)
        change = store.written(coverage_change(spark.read.parquet(staged["daily"])))
        staged["coverage"] = store.stage("coverage", coverage_rows(store, change))
    return staged, ledger_rows(spark, change, bad)


def _coverage(run: Run) -> tuple[dict[str, str], DataFrame]:
    """The dimension's measured columns from the maintained counts."""
    store = run.store
    known = station_coverage_of(store.read("coverage")).withColumnRenamed("completeness_temp_pct", "completeness_pct")
    cols = ("first_obs_date", "last_obs_date", "coverage_years", "completeness_pct")
    return _whole(run, "station", store.read("station").drop(*cols).join(known.select("station_id", *cols), "station_id", "left"))


def _daily(run: Run) -> DataFrame:
    return run.store.read("daily").select(*DAILY_COLUMNS)


STEPS: tuple[tuple[str, Step], ...] = (
    ("seed", _seed),
    ("ingest", _ingest),
    ("coverage", _coverage),
    ("climatology", lambda run: _whole(run, "climatology", climatology(rolling(to_long(_daily(run), METRICS), CLIMATOLOGY_WINDOWS, "rows_nonnull")))),
    ("records", lambda run: _whole(run, "records", all_time_extremes(to_long(_daily(run), RECORD_METRICS), WINDOW_DAYS))),
    ("recent", lambda run: _whole(run, "window_recent", recent_windows(_daily(run), WINDOW_DAYS))),
    ("insights", lambda run: _whole(run, "latest_insight", latest_insights(_daily(run), run.as_of, stored_climatology=run.store.read("climatology")))),
)


def backfill(store: Store, landed: Landed, run_id: str, as_of: str, at: str, steps: tuple[tuple[str, Step], ...] = STEPS) -> list[str]:
    """Run the steps that ``run_id`` has not finished; returns their names.  ``at``: the stamp of the run's rows."""
    store.recover()
    run = Run(store, landed, run_id, as_of, at)
    done = {r.step for r in store.read("ledger").where(F.col("run_id") == run_id).select("step").distinct().collect()}  # a few names
    ran = []
    for name, step in steps:
        if name in done:
            continue
        staged, counts = step(run)
        ledger = counts.select(F.lit(run_id).alias("run_id"), F.lit(0).cast("long").alias("batch"), F.lit(name).alias("step"), "station_id",
                               F.col("rows").cast("long").alias("rows"), "source", "errors", F.lit(at).cast("timestamp").alias("at"))
        store.commit(f"{run_id}/{name}", {**staged, "ledger": store.stage("ledger", ledger)})
        ran.append(name)
    return ran
