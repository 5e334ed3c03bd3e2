"""Incremental ingest (I1) and refresh (I4): landed text rows -> daily table, coverage, quarantine, run ledger -> latest insights.

One micro-batch has two dependent sinks, each one commit of the store:

1. *ingest*: rows are cleaned (B1-B11); rows without a readable date, without
   a temperature or of an unknown station go to the quarantine with the reason;
   rows of inactive stations (B15) and of the running day (I3) are passed over.
   Every station starts where its state ends (D9): authoritative rows from the
   last authoritative date on (one day of overlap for corrections), provisional
   rows after it.  What is left is merged into the daily table by precedence.
   The merge says what stood at each key before, so the coverage counts are
   kept up to date from the difference, without a pass over the history.
2. *insights*: J3 for the stations of the batch alone (semi join), over the
   years that its baseline needs; other stations' folders are not rewritten.

A batch that was replayed looks at the store's last commit: a half-done commit
is finished, a finished step is not run again, and the step after it is.  The
run ledger (D16) gets its rows from the same commits: per station the rows
written and their sources, and the rejected rows by reason.  The rows that came
and were rejected are counted while the batch is stored (``observe``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solstice.operators.clean import clean_station_daily, keep_where
from solstice.operators.precedence import priority_of
from solstice.plans.insights import latest_insights
from solstice.schemas import AUTHORITATIVE_SOURCES, LATEST_WINDOWS
from solstice.session import scratch_path
from solstice.sources.store import Store

#: Years of the baseline before the year of ``as_of``.
BASELINE = 24


def _checked(batch: DataFrame, stations: DataFrame, as_of: str) -> DataFrame:
    """Cleaned rows of active stations before ``as_of`` with ``problem`` (null: none) and the landed ``row`` of those that have one."""
    landed = batch.withColumn("landed", F.struct(*batch.columns))
    rows = clean_station_daily(landed, flags=True, carry=("source", "landed"))
    running = F.col("obs_date") >= F.lit(as_of).cast("date")
    cols = ("station_id", "obs_date", "tmin_c", "tmax_c", "tavg_c", "prcp_mm", "source")
    rows = keep_where(rows.select(*cols, "f_dropped", "landed"), ~F.coalesce(running, F.lit(False)))
    known = stations.select(F.col("station_id").alias("_known"), F.coalesce("is_active", F.lit(False)).alias("_active")).distinct()
    rows = rows.join(known, rows["station_id"] == known["_known"], "left")
    problem = (F.when(F.col("_known").isNull(), "unknown station").when(F.col("obs_date").isNull(), "unreadable date")
               .when(F.col("f_dropped"), "no temperature"))
    active = F.col("_known").isNull() | F.col("_active")
    return rows.where(active).withColumn("problem", problem).select(*cols, "problem", rejected_row())


def rejected_row() -> Column:
    """``row``: the landed row as JSON if it has a ``problem``; accepted rows need no second copy of their text."""
    return F.when(F.col("problem").isNotNull(), F.to_json("landed")).alias("row")


def _in_bounds(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows from where their station's state ends; provisional rows of a station without authoritative date are skipped."""
    auth = F.col("source").isin(*AUTHORITATIVE_SOURCES)
    state = coverage.select("station_id", F.col("last_auth_date").alias("_start"))
    new = rows.where(auth).groupBy("station_id").agg(F.max("obs_date").alias("_new"))
    j = rows.join(state, "station_id", "left").join(new, "station_id", "left")
    old_enough = F.col("_start").isNull() | (F.col("obs_date") >= F.col("_start"))
    after = F.col("obs_date") > F.greatest("_start", "_new")
    return j.where(F.when(auth, old_enough).otherwise(F.coalesce(after, F.lit(False)))).drop("_start", "_new")


def coverage_change(merged: DataFrame) -> DataFrame:
    """Per station: the coverage columns as differences (counts) and bounds (dates), and the rows written by source."""
    new = F.col("before").isNull()
    gained = lambda c: F.sum(F.col(c).isNotNull().cast("long") - F.col(f"before.{c}").isNotNull().cast("long"))
    auth = F.col("source").isin(*AUTHORITATIVE_SOURCES)
    return merged.where("delivered").groupBy("station_id").agg(
        F.sum(new.cast("long")).alias("n_days"), gained("tavg_c").alias("n_tavg"), gained("prcp_mm").alias("n_prcp"),
        F.min("obs_date").alias("first_obs_date"), F.max("obs_date").alias("last_obs_date"),
        F.max(F.when(auth, F.col("obs_date"))).alias("last_auth_date"),
        F.count(F.lit(1)).alias("rows"),
        F.array_join(F.array_sort(F.collect_set(F.concat(priority_of(F.col("source")).cast("string"), F.lit(":"), "source"))), "+").alias("source"))


def _ingest(store: Store, batch: DataFrame, run_id: str, n: int, stations: DataFrame, as_of: str, at: str, commit_id: str) -> dict:
    counts = Observation()
    arrived = scratch_path(store.spark, "refresh-arrived")
    rows = _checked(batch, stations, as_of).observe(counts, F.count(F.lit(1)).alias("rows"), F.count("problem").alias("rejected"))
    rows.write.parquet(arrived)
    rows = store.spark.read.schema(rows.schema).parquet(arrived)

    accepted = store.conform("daily", _in_bounds(rows.where("problem is null"), store.read("coverage")), at)
    good = store.written(accepted)
    merged = store.merge("daily", good.where(F.size("problems") == 0), [-priority_of(F.col("source"))])
    bad = rows.where("problem is not null").select("station_id", "problem", "row")
    broken = good.where(F.size("problems") > 0).select("station_id", F.array_join("problems", "; ").alias("problem"), F.lit(None).cast("string").alias("row"))
    staged, change = {}, None
    quarantine = bad.unionByName(broken).select(F.lit(run_id).alias("run_id"), F.lit(n).cast("long").alias("batch"), "station_id", "problem", "row")
    if merged is not None:
        staged["daily"] = store.stage("daily", merged)
        merged = store.spark.read.parquet(staged["daily"])
        change = store.written(coverage_change(merged))
        staged["coverage"] = store.stage("coverage", coverage_rows(store, change))
    ledger = ledger_rows(store.spark, change, quarantine).select(
        F.lit(run_id).alias("run_id"), F.lit(n).cast("long").alias("batch"), F.lit("ingest").alias("step"), "station_id", "rows", "source", "errors",
        F.lit(at).cast("timestamp").alias("at"))
    staged["ledger"] = store.stage("ledger", ledger)
    seen = counts.get
    if seen["rejected"]:
        staged["quarantine"] = store.stage("quarantine", quarantine)
    store.commit(commit_id, staged)
    return seen


def ledger_rows(spark: SparkSession, change: DataFrame | None, bad: DataFrame) -> DataFrame:
    """Per station: rows written and their sources (by precedence, joined by +), and the rejected rows by reason."""
    errors = bad.groupBy("station_id", "problem").agg(F.count(F.lit(1)).alias("k")).groupBy("station_id").agg(
        F.array_sort(F.collect_list(F.concat_ws(": ", "problem", "k"))).alias("errors"))  # a station has a few reasons
    if change is None:
        change = spark.createDataFrame([], "station_id string, rows long, source string")
    names = F.array_join(F.transform(F.split("source", r"\+"), lambda s: F.substring_index(s, ":", -1)), "+")
    both = change.select("station_id", "rows", names.alias("source")).withColumnRenamed("station_id", "_s").join(
        errors, F.col("_s").eqNullSafe(F.col("station_id")), "full")
    return both.select(F.coalesce("station_id", "_s").alias("station_id"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "source",
                       F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def coverage_rows(store: Store, change: DataFrame) -> DataFrame:
    """New content of the coverage folders of the changed stations: the old state plus the change."""
    cols = store.tables["coverage"].schema.names
    new = store.conform("coverage", change.select(*cols)).drop("problems")
    old = store.read("coverage").join(new.select("bucket").distinct(), "bucket", "left_semi")
    both = old.select(*cols, "bucket").unionByName(new.select(*cols, "bucket"))
    return both.groupBy("station_id", "bucket").agg(
        *[F.sum(c).alias(c) for c in ("n_days", "n_tavg", "n_prcp")], F.min("first_obs_date").alias("first_obs_date"),
        *[F.max(c).alias(c) for c in ("last_obs_date", "last_auth_date")]).select(*cols, "bucket")


def _insights(store: Store, run_id: str, n: int, as_of: str, at: str, windows: Sequence[int], commit_id: str) -> None:
    """J3 of the stations that the batch's ingest wrote, over the baseline's years."""
    mine = store.read("ledger").where((F.col("run_id") == run_id) & (F.col("batch") == n) & (F.col("step") == "ingest") & (F.col("rows") > 0))
    touched = mine.select("station_id")
    since = int(as_of[:4]) - BASELINE
    history = store.read("daily").where(F.col("obs_month") >= since * 100 + 1).join(touched, "station_id", "left_semi")
    series = store.written(history.select("station_id", "obs_date", "tavg_c"), "refresh-series")  # read by the as-of search and the baseline
    stored = store.read("climatology")
    rows = latest_insights(series, as_of, windows=windows, since_year=since, stored_climatology=stored)
    checked = store.written(store.conform("latest_insight", rows, at), "refresh-insights")
    good = checked.where(F.size("problems") == 0)
    merged = store.merge("latest_insight", good)
    per_station = good.groupBy("station_id").agg(F.count(F.lit(1)).alias("rows"))
    ledger = per_station.select(F.lit(run_id).alias("run_id"), F.lit(n).cast("long").alias("batch"), F.lit("insights").alias("step"), "station_id", "rows",
                                F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("errors"), F.lit(at).cast("timestamp").alias("at"))
    staged = {"ledger": store.stage("ledger", ledger)}
    if merged is not None:
        staged["latest_insight"] = store.stage("latest_insight", merged)
    store.commit(commit_id, staged)


def refresh_batch(store: Store, batch: DataFrame, n: int, run_id: str, stations: DataFrame, as_of: str, at: str,
                  windows: Sequence[int] = LATEST_WINDOWS, insights: bool = True) -> dict | None:
    """Both steps of micro-batch ``n``, each at most once; returns what ``observe`` counted (None: ingested before)."""
    ids = [f"{run_id}/{n}/{step}" for step in ("ingest", "insights")]
    last = store.recover()
    seen = None
    if last not in ids:
        seen = _ingest(store, batch, run_id, n, stations, as_of, at, ids[0])
    if insights and last != ids[1]:
        _insights(store, run_id, n, as_of, at, windows, ids[1])
    return seen


def start_refresh(store: Store, landing: str, schema, checkpoint: str, run_id: str, stations: DataFrame, as_of: str, at: str,
                  max_files: int | None = None, insights: bool = True) -> StreamingQuery:
    """``availableNow`` stream over landed rows (text columns STATION, DATE, TMIN, TMAX, TAVG, PRCP and source).

    ``run_id`` belongs to the checkpoint: a new checkpoint needs a new one.  ``at``: the stamp of this run's rows.
    """
    spark: SparkSession = store.spark
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def each(batch: DataFrame, n: int) -> None:
        refresh_batch(store, batch, n, run_id, stations, as_of, at, insights=insights)

    return (reader.parquet(landing).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_totals(ledger: DataFrame) -> DataFrame:
    """D16 of whole runs: per run, batch and step the stations, rows and stations with errors."""
    return ledger.groupBy("run_id", "batch", "step").agg(
        F.count_if(F.col("rows") > 0).alias("stations"), F.sum("rows").alias("rows"), F.count_if(F.size("errors") > 0).alias("stations_with_errors"))

