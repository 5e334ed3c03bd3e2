"""Registered queries: one per operator / job, each over the whole benchmark
tables (``sf_dir``).  ``__spark_entry__.queries()`` exposes this mapping; the
matching DuckDB SQL lives in ``oracle_sql.py`` at the repository root."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.functions.numeric import sround
from solstice.operators.climatology import climatology
from solstice.operators.records import all_time_extremes
from solstice.operators.rolling import calendar_windows, recent_windows, rolling, since_filter, to_long
from solstice.plans.insights import latest_insights
from solstice.schemas import CLIMATOLOGY_WINDOWS, LATEST_WINDOWS, METRICS, RECORD_METRICS, WINDOW_DAYS
from solstice.sources import tables as T

AS_OF = T.AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r4(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, sround(F.col(c), digits))
    return df


@register("a6_daily_series")
def q_daily_series(spark, sf):
    return _r4(T.daily_series(spark, sf), "tavg_c", "prcp_mm")


@register("e1_recent_windows")
def q_recent_windows(spark, sf):
    return _r4(recent_windows(T.daily_series(spark, sf), WINDOW_DAYS),
               "tavg_c_mean", "tmin_c_mean", "tmax_c_mean", "prcp_mm_sum", "coverage_ratio")


@register("e2_rolling_nonnull")
def q_rolling_nonnull(spark, sf):
    long = to_long(T.daily_series_with_nulls(spark, sf), ["tavg_c"])
    return _r4(rolling(long, WINDOW_DAYS, "rows_nonnull"), "value")


@register("e3_rolling_nullable")
def q_rolling_nullable(spark, sf):
    long = to_long(T.daily_series_with_nulls(spark, sf), ["tavg_c"])
    return _r4(rolling(long, WINDOW_DAYS, "rows_nullable"), "value")


@register("e4_calendar_windows")
def q_calendar_windows(spark, sf):
    long = to_long(T.daily_series_with_nulls(spark, sf), METRICS)
    return _r4(calendar_windows(long, LATEST_WINDOWS), "value", "coverage_ratio")


@register("d5_climatology")
def q_climatology(spark, sf):
    long = to_long(T.daily_series(spark, sf), METRICS)
    rolled = rolling(long, CLIMATOLOGY_WINDOWS, "rows_nonnull")
    return climatology(rolled)


@register("d10_records")
def q_records(spark, sf):
    long = to_long(T.daily_series(spark, sf), RECORD_METRICS)
    return all_time_extremes(long, WINDOW_DAYS)


@register("j3_latest_insights")
def q_latest_insights(spark, sf):
    return latest_insights(T.daily_series(spark, sf), AS_OF)


# --- coverage and bookkeeping -------------------------------------------------
from solstice.operators import coverage as COV  # noqa: E402
from solstice.operators import precedence as PR  # noqa: E402
from solstice.operators import rankings as RK  # noqa: E402

BASELINES = (None, 1996, 1998, 2000)


@register("d2_station_coverage")
def q_station_coverage(spark, sf):
    st = T.stations(spark, sf)
    return COV.update_station_coverage(st, T.daily_series_with_nulls(spark, sf))


@register("d3_date_range")
def q_date_range(spark, sf):
    return COV.date_range(T.daily_series(spark, sf))


@register("d4_baseline_years")
def q_baseline_years(spark, sf):
    return COV.baseline_years(T.daily_series(spark, sf), BASELINES, T.stations(spark, sf))


@register("d8_observed_dates")
def q_observed_dates(spark, sf):
    return COV.observed_dates(T.sourced_daily(spark, sf))


@register("d9_last_authoritative")
def q_last_authoritative(spark, sf):
    return COV.last_authoritative(T.sourced_daily(spark, sf))


@register("d15_coverage_summary")
def q_coverage_summary(spark, sf):
    d = T.daily_series(spark, sf)
    first = d.groupBy("station_id").agg(F.min("obs_date").alias("_s"))
    j = d.join(first, "station_id")
    return COV.coverage_summary(j, F.col("_s"), F.date_sub(F.lit(AS_OF).cast("date"), 1))


# --- precedence, gaps, upsert -------------------------------------------------
#: Last day that the primary source is trusted for.
PRIMARY_CUTOFF = "2001-06-30"


@register("e11_keep_first")
def q_keep_first(spark, sf):
    s = T.sourced_daily(spark, sf)
    return _r4(PR.keep_first(s, ["station_id", "obs_date"], [F.col("source")]), "tavg_c", "prcp_mm")


@register("i2_precedence")
def q_precedence(spark, sf):
    s = T.sourced_daily(spark, sf)
    return _r4(PR.resolve_precedence(s, ingested_at=None), "tavg_c", "prcp_mm")


@register("c1_gap_fill")
def q_gap_fill(spark, sf):
    s = T.sourced_daily(spark, sf)
    prim = s.where(F.col("source") == "ghcn_daily")
    sec = s.where(F.col("source") == "gsod")
    return _r4(PR.gap_fill(prim, sec), "tavg_c", "prcp_mm")


@register("c2_provisional_fill")
def q_provisional_fill(spark, sf):
    s = T.sourced_daily(spark, sf)
    existing = s.where(F.col("source") != "open_meteo")
    prov = s.where(F.col("source") == "open_meteo")
    return _r4(PR.provisional_fill(existing, prov, AS_OF), "tavg_c", "prcp_mm")


@register("c3_calendar_gaps")
def q_calendar_gaps(spark, sf):
    s = T.sourced_daily(spark, sf).where(F.col("source") == "ghcn_daily")
    return PR.calendar_gaps(s.select("station_id", "obs_date"), *T.date_bounds(spark, sf), cutoff=PRIMARY_CUTOFF,
                            stations=T.stations(spark, sf))


@register("c4_restrict_to_missing")
def q_restrict(spark, sf):
    s = T.sourced_daily(spark, sf)
    ghcn = s.where(F.col("source") == "ghcn_daily").select("station_id", "obs_date")
    missing = PR.calendar_gaps(ghcn, *T.date_bounds(spark, sf), stations=T.stations(spark, sf))
    return _r4(PR.restrict_to(s.where(F.col("source") == "gsod"), missing), "tavg_c", "prcp_mm")


@register("a7_upsert")
def q_upsert(spark, sf):
    s = T.sourced_daily(spark, sf)
    old = s.where(F.col("source") == "open_meteo")
    new = s.where(F.col("source") != "open_meteo")
    out = PR.upsert(old, new, ["station_id", "obs_date"], order=[PR.priority_of(F.col("source"))])
    return _r4(out, "tavg_c", "prcp_mm")


# --- rankings ------------------------------------------------------------------
def _tavg_long(spark, sf):
    d = T.daily_series(spark, sf)
    return d.select("station_id", "obs_date", F.lit("tavg_c").alias("metric_id"), F.col("tavg_c").alias("value"))


def _latest_targets(spark, sf):
    return T.daily_series(spark, sf).groupBy("station_id").agg(F.max("obs_date").alias("end_date"))


@register("j5_seasonal_ranking")
def q_seasonal_ranking(spark, sf):
    return RK.seasonal_rankings(_tavg_long(spark, sf), _latest_targets(spark, sf), 7)


@register("j6_extremes_cold")
def q_extremes_cold(spark, sf):
    return RK.extremes_rankings(_tavg_long(spark, sf), _latest_targets(spark, sf), 7, "cold")


@register("j6_extremes_warm")
def q_extremes_warm(spark, sf):
    return RK.extremes_rankings(_tavg_long(spark, sf), _latest_targets(spark, sf), 30, "warm", since_year=1996)


@register("e12_ranking_excerpt")
def q_ranking_excerpt(spark, sf):
    return RK.ranking_excerpt(RK.seasonal_rankings(_tavg_long(spark, sf), _latest_targets(spark, sf), 14))


def _latest_values(spark, sf):
    d = T.daily_series(spark, sf)
    last = d.groupBy("station_id").agg(F.max("obs_date").alias("obs_date"))
    return d.join(last, ["station_id", "obs_date"]).select("station_id", F.col("tavg_c").alias("value"))


@register("d11_percent_below")
def q_percent_below(spark, sf):
    vals = T.daily_series(spark, sf).select("station_id", F.col("tavg_c").alias("value"))
    return _r4(RK.percent_below(vals, _latest_values(spark, sf)), "pct_below")


@register("d12_percentile_of_score")
def q_percentile_of_score(spark, sf):
    vals = T.daily_series(spark, sf).select("station_id", F.col("tavg_c").alias("value"))
    return _r4(RK.percentile_of_score(vals, _latest_values(spark, sf)), "percentile")


# --- landed rows: cleaning chains and raw formats -------------------------------
from solstice.operators import clean as CL  # noqa: E402
from solstice.plans.consolidate import consolidate  # noqa: E402
from solstice.sources import files as FS  # noqa: E402


@register("b_clean_station_daily")
def q_clean_station_daily(spark, sf):
    return _r4(CL.clean_station_daily(T.raw_station_rows(spark, sf)), "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


@register("b12_quality_counters")
def q_quality_counters(spark, sf):
    return CL.quality_counters(CL.clean_station_daily(T.raw_station_rows(spark, sf), flags=True))


@register("b_clean_gsod")
def q_clean_gsod(spark, sf):
    return _r4(CL.clean_gsod(T.raw_gsod_rows(spark, sf)), "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


@register("a3_open_meteo_arrays")
def q_open_meteo(spark, sf):
    rows = FS.zip_daily_arrays(T.open_meteo_documents(spark, sf))
    return _r4(CL.clean_open_meteo_rows(rows), "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


@register("a9_ghcn_fahrenheit")
def q_ghcn_fahrenheit(spark, sf):
    return _r4(CL.ghcn_fahrenheit(T.raw_station_rows(spark, sf)), "temp_f", "max_temp_f", "min_temp_f")


@register("a10_gsod_native")
def q_gsod_native(spark, sf):
    return CL.gsod_native(T.raw_gsod_rows(spark, sf))


@register("j9_consolidation")
def q_consolidation(spark, sf):
    out = consolidate(T.raw_gsod_rows(spark, sf), T.raw_station_rows(spark, sf), *T.date_bounds(spark, sf),
                      PRIMARY_CUTOFF)
    return _r4(out, "min", "max", "avg")


# --- reports -------------------------------------------------------------------
from solstice.operators.asof import latest_window  # noqa: E402
from solstice.operators.records import record_check  # noqa: E402
from solstice.plans.insights import window_insights, window_series  # noqa: E402
from solstice.schemas import STREAK_WINDOWS  # noqa: E402

J2_WINDOWS = (1, 7, 30)


def _stored_climatology(spark, sf, metrics=("tavg_c",), windows=CLIMATOLOGY_WINDOWS):
    long = to_long(T.daily_series(spark, sf), list(metrics))
    return climatology(rolling(long, windows, "rows_nonnull"))


@register("j2_window_insight")
def q_window_insight(spark, sf):
    d = T.daily_series(spark, sf)
    clim = _stored_climatology(spark, sf, windows=J2_WINDOWS)
    recs = all_time_extremes(to_long(d, ["tavg_c"]), J2_WINDOWS)
    return window_insights(d, clim, recs, COV.station_coverage(d), J2_WINDOWS)


def _window_insight(spark, sf, windows, metrics):
    d = T.daily_series(spark, sf)
    recs = all_time_extremes(to_long(d, [m for m in metrics if m in RECORD_METRICS]), windows)
    return window_insights(d, _stored_climatology(spark, sf, metrics, windows), recs, COV.station_coverage(d), windows, metrics)


@register("j2_window_insight_windows")
def q_window_insight_windows(spark, sf):
    """J2 over all windows that have a climatology."""
    return _window_insight(spark, sf, CLIMATOLOGY_WINDOWS, ("tavg_c",))


@register("j2_window_insight_metrics")
def q_window_insight_metrics(spark, sf):
    """J2 over all metrics."""
    return _window_insight(spark, sf, J2_WINDOWS, METRICS)


@register("j2_window_insight_since")
def q_window_insight_since(spark, sf):
    """J2 against the years since 1997 (D7 climatology, D4 coverage)."""
    d = T.daily_series(spark, sf)
    long = to_long(since_filter(d, 1997), ["tavg_c"])
    clim = climatology(rolling(long, J2_WINDOWS, "rows_nonnull"))
    years = COV.baseline_years(d, (1997,), d.select("station_id"))
    recs = all_time_extremes(to_long(d, ["tavg_c"]), J2_WINDOWS)
    return window_insights(d, clim, recs, COV.station_coverage(d), J2_WINDOWS, since_year=1997, baseline=years,
                           current_year=int(AS_OF[:4]))


@register("j4_series_bands_since")
def q_series_bands_since(spark, sf):
    """J4 against the years since 1997 (D7 climatology)."""
    d = T.daily_series_with_nulls(spark, sf)
    long = to_long(since_filter(d, 1997), ["tavg_c"])
    return window_series(d, climatology(rolling(long, (7,), "rows_nonnull")), 7)


@register("j4_series_bands")
def q_series_bands(spark, sf):
    clim = _stored_climatology(spark, sf, windows=(7,))
    return window_series(T.daily_series_with_nulls(spark, sf), clim, 7)


@register("j7_records_report")
def q_records_report(spark, sf):
    recs = all_time_extremes(to_long(T.daily_series(spark, sf), RECORD_METRICS), WINDOW_DAYS, digits=None)
    return recs.withColumn("value", sround(F.col("value"), 2)).orderBy("station_id", "metric_id", "window_days",
                                                                      "record_type")


@register("c10_record_check")
def q_record_check(spark, sf):
    d = T.daily_series(spark, sf)
    long = d.select("station_id", "obs_date", F.col("tavg_c").alias("value"))
    cur = latest_window(long, LATEST_WINDOWS, AS_OF).select(
        "station_id", F.lit("tavg_c").alias("metric_id"), "window_days", "end_date",
        sround(F.col("value"), 4).alias("value"))
    recs = all_time_extremes(to_long(d, ["tavg_c"]), LATEST_WINDOWS)
    return record_check(cur, recs)


@register("e10_extreme_streaks")
def q_extreme_streaks(spark, sf):
    d = T.daily_series_with_nulls(spark, sf)
    long = d.select("station_id", "obs_date", F.lit("tavg_f").alias("metric_id"),
                    (F.col("tavg_c") * 9.0 / 5.0 + 32.0).alias("value"))
    r = all_time_extremes(long, STREAK_WINDOWS, frame="rows_nullable", digits=None)
    return r.select("station_id", "window_days", "record_type", sround(F.col("value"), 1).alias("value_f"),
                    "start_date", "end_date")


# --- streaming -----------------------------------------------------------------
from solstice.session import scratch_path  # noqa: E402
from solstice.streaming.ingest import land_in_waves, start_precedence_ingest  # noqa: E402
from solstice.streaming.windows import start_windowed_means  # noqa: E402


@register("i2_stream_precedence")
def q_stream_precedence(spark, sf):
    """Provisional rows land first, authoritative ones later, in separate drops;
    the streamed table must equal the batch precedence result (I2)."""
    s = T.sourced_daily(spark, sf)
    base = scratch_path(spark, "i2-stream")
    land_in_waves(s, f"{base}/landing", "source", ["open_meteo", "gsod", "ghcn_daily"])
    q = start_precedence_ingest(spark, f"{base}/landing/*", s.schema, f"{base}/table", f"{base}/ckpt", max_files=4)
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/table").select(*s.columns)
    return _r4(out, "tavg_c", "prcp_mm")


@register("i5_stream_window_means")
def q_stream_window_means(spark, sf):
    """Event stream -> 7-day sliding means per event type with a 5-day watermark."""
    ev = T.read_table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    base = scratch_path(spark, "i5-stream")
    ev.write.mode("overwrite").parquet(f"{base}/landing")
    q = start_windowed_means(spark, f"{base}/landing", ev.schema, 7, f"{base}/table", f"{base}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/table").select("event_type", "window_start", "window_end", "mean_value", "n")
    return _r4(out, "mean_value")


# --- spatial, period comparison, board -------------------------------------------
from solstice.operators.spatial import nearby  # noqa: E402
from solstice.plans import board as BD  # noqa: E402
from solstice.plans.period import period_bands, period_verdicts  # noqa: E402


def _customer_points(spark, sf):
    c = T.read_table(spark, sf, "customer").select("c_custkey")
    return c.select(F.col("c_custkey").alias("point_id"),
                    (F.lit(25.0) + (F.col("c_custkey") % 250) / 10.0).alias("lat"),
                    (F.lit(-120.0) + (F.col("c_custkey") % 500) / 10.0).alias("lon"))


@register("j8_nearby_stations")
def q_nearby(spark, sf):
    return nearby(_customer_points(spark, sf), T.stations(spark, sf), radius_km=300.0, limit=3)


def _periods(spark, sf):
    d = T.daily_series(spark, sf)
    return d.groupBy("station_id").agg(F.max("obs_date").alias("end_date")).select(
        "station_id", F.date_sub("end_date", 29).alias("start_date"), "end_date")


@register("j10_period_bands")
def q_period_bands(spark, sf):
    return period_bands(T.daily_series(spark, sf), _periods(spark, sf))


@register("j10_period_verdict")
def q_period_verdict(spark, sf):
    return period_verdicts(T.daily_series(spark, sf), _periods(spark, sf))


def _board_rows(spark, sf):
    return BD.board_rows(T.stations(spark, sf), latest_insights(T.daily_series(spark, sf), AS_OF), 7)


@register("j12_leaderboard")
def q_leaderboard(spark, sf):
    return BD.leaderboard(_board_rows(spark, sf))


@register("d17_outlier_summary")
def q_outliers(spark, sf):
    return BD.outlier_summary(_board_rows(spark, sf))


@register("d18_percentile_histogram")
def q_histogram(spark, sf):
    return BD.percentile_histogram(_board_rows(spark, sf))


# --- baselines, station bundle ---------------------------------------------------
from solstice.functions.text import headline  # noqa: E402
from solstice.operators.climatology import baseline_climatology  # noqa: E402


@register("d6_baseline_climatology")
def q_baseline_climatology(spark, sf):
    return baseline_climatology(_tavg_long(spark, sf), (1996, 1998, 2000), (7,))


@register("j11_station_bundle")
def q_station_bundle(spark, sf):
    """Newest 7-day insight + seasonal ranking of the same period, and the card headline."""
    d = T.daily_series(spark, sf)
    clim = _stored_climatology(spark, sf, windows=(7,))
    recs = all_time_extremes(to_long(d, ["tavg_c"]), (7,))
    ins = window_insights(d, clim, recs, COV.station_coverage(d), (7,))
    tg = _latest_targets(spark, sf)
    ins = ins.join(tg, ["station_id", "end_date"], "left_semi")
    rk = RK.seasonal_rankings(_tavg_long(spark, sf), tg, 7).where(F.col("is_current")).select(
        "station_id", "end_date", F.col("rank").alias("seasonal_rank"), "total_years")
    j = ins.join(rk, ["station_id", "end_date"], "left")
    return j.select("station_id", "end_date", "window_days", "percentile", "severity", "seasonal_rank", "total_years",
                    headline(F.col("window_days"), F.col("severity"), F.col("percentile"), F.col("seasonal_rank"),
                             F.col("total_years")).alias("headline"))


# --- baseline options, registry lookup -------------------------------------------


@register("h17_baseline_choices")
def q_baseline_choices(spark, sf):
    cov = COV.station_coverage(T.daily_series(spark, sf))
    return COV.baseline_choices(cov, int(AS_OF[:4]))


@register("c14_registry_lookup")
def q_registry_lookup(spark, sf):
    """Requested stations: every customer's nation (known) and every order
    priority (not a station: error rows)."""
    cust = T.read_table(spark, sf, "customer").select("c_nationkey")
    nat = T.read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    known = cust.join(nat, cust.c_nationkey == nat.n_nationkey).select(F.col("n_name").alias("station_id"))
    unknown = T.read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("station_id"))
    return COV.registry_lookup(known.unionByName(unknown), T.stations(spark, sf))


# --- incremental ingest and refresh (I1, I4), run ledger (D16), last update (D19) ----
from solstice.sources.store import Store, last_updated  # noqa: E402
from solstice.streaming.refresh import start_refresh  # noqa: E402

#: Stamp of the run after each delivery of the feed.
FEED_RUNS = ("1996-01-01 06:00:00", "1999-01-01 06:00:00", "2001-10-20 06:00:00")


def _refreshed(spark, sf, insights=True) -> Store:
    """The feed's deliveries, each followed by a run of the same stream."""
    base = scratch_path(spark, "refresh")
    store, feed = Store(spark, f"{base}/store"), T.landed_feed(spark, sf)
    rows = feed.drop("wave")
    for wave, at in enumerate(FEED_RUNS):
        feed.where(F.col("wave") == wave).drop("wave").write.parquet(f"{base}/landing/drop={wave}")
        start_refresh(store, f"{base}/landing/*", rows.schema, f"{base}/checkpoint", "feed", T.stations(spark, sf), T.FEED_AS_OF, at,
                      insights=insights).awaitTermination()
    return store


@register("i1_incremental")
def q_incremental(spark, sf):
    return _r4(_refreshed(spark, sf, insights=False).read("daily").select(
        "station_id", "obs_date", "tmin_c", "tmax_c", "tavg_c", "prcp_mm", "source",
        F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at")), "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


@register("i4_refresh")
def q_refresh(spark, sf):
    rows = _refreshed(spark, sf).read("latest_insight")
    return rows.drop("bucket").withColumn("computed_at", F.date_format("computed_at", "yyyy-MM-dd HH:mm:ss"))


@register("d16_run_summary")
def q_run_summary(spark, sf):
    ledger = _refreshed(spark, sf, insights=False).read("ledger").where("step = 'ingest'")
    return ledger.select("batch", "station_id", "rows", "source", F.array_join("errors", "; ").alias("errors"),
                         F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@register("d19_last_updated")
def q_last_updated(spark, sf):
    return last_updated(_refreshed(spark, sf)).select(F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


# --- landed files: manifest scans (A1, A2), registry seed (A4), restartable backfill (J1) ----
from solstice.plans.backfill import Landed, backfill, seeded  # noqa: E402
from solstice.sources import manifest as MF  # noqa: E402


def _landed(spark, sf) -> Landed:
    base = scratch_path(spark, "landed")
    T.land_files(spark, sf, base)
    return Landed(f"{base}/registry", f"{base}/station_csv", f"{base}/manifests", f"{base}/gsod", f"{base}/open_meteo")


@register("a1_station_csv")
def q_station_csv(spark, sf):
    """Station files from 1995 on: files that end before are not opened."""
    landed = _landed(spark, sf)
    MF.index_station_csv(spark, landed.station_csv, f"{landed.manifests}/station_csv")
    raw = MF.scan_station_csv(spark, f"{landed.manifests}/station_csv", start="1995-01-01")
    return _r4(CL.clean_station_daily(raw), "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


@register("a2_gsod_years")
def q_gsod_years(spark, sf):
    """GSOD files of 1994 to 1997, stations through the registry."""
    landed = _landed(spark, sf)
    MF.index_gsod(spark, landed.gsod, f"{landed.manifests}/gsod")
    raw = MF.scan_gsod(spark, f"{landed.manifests}/gsod", T.stations(spark, sf), None, 1994, 1997)
    return _r4(CL.clean_gsod(raw), "tmin_c", "tmax_c", "tavg_c", "prcp_mm")


@register("a4_registry_seed")
def q_registry_seed(spark, sf):
    """Two registry deliveries with measured coverage between them: some stations left, some are new."""
    store = Store(spark, scratch_path(spark, "seed"))
    st = T.stations(spark, sf).withColumn("k", F.right("wban", F.lit(3)).cast("int"))
    old = st.where(F.col("k") % 5 != 0).select("station_id", "wban", F.lower("name").alias("name"), F.lit(0.0).alias("lat"), "lon")
    new = st.where(F.col("k") % 5 != 1).select("station_id", "wban", "name", "lat", "lon")
    lacking = [F.lit(None).cast(t).alias(c) for c, t in (("city", "string"), ("location", "string"), ("elevation_m", "double"))]
    store.upsert("station", seeded(store, old.select("*", *lacking)), "seed-1", at="2001-01-01 00:00:00")
    cov = COV.station_coverage(T.daily_series(spark, sf)).select("station_id", "first_obs_date", "last_obs_date", "coverage_years",
                                                                 F.col("completeness_temp_pct").alias("completeness_pct"))
    measured = store.read("station").drop(*cov.columns[1:]).join(cov, "station_id")
    store.upsert("station", measured, "coverage", at="2001-01-02 00:00:00")
    store.upsert("station", seeded(store, new.select("*", *lacking)), "seed-2", at="2001-01-03 00:00:00")
    return store.read("station").select("station_id", "wban", "name", "lat", "lon", "first_obs_date", "last_obs_date", "coverage_years", "completeness_pct", "is_active")


@register("j1_backfill")
def q_backfill(spark, sf):
    """The computed tables after a backfill from landed files, in one shape."""
    store = Store(spark, scratch_path(spark, "backfill"))
    backfill(store, _landed(spark, sf), "first", AS_OF, "2001-11-05 06:00:00")
    parts = [
        ("climatology", F.col("metric_id"), F.col("end_doy").cast("string"), F.col("p50"), F.col("n_samples")),
        ("records", F.col("metric_id"), F.col("record_type"), F.col("value"), F.col("n_years_considered")),
        ("window_recent", F.lit("tavg_c"), F.col("end_date").cast("string"), sround(F.col("tavg_c_mean"), 4), F.lit(0)),
        ("latest_insight", F.col("metric"), F.col("severity"), F.col("percentile"), F.col("coverage_years")),
    ]
    out = None
    for name, metric, item, value, n in parts:
        rows = store.read(name).select(F.lit(name).alias("stored_table"), "station_id", metric.alias("metric_id"), "window_days",
                                       item.alias("item"), value.alias("value"), n.cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
