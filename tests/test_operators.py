
import datetime as dt

import pytest
from pyspark.sql import functions as F

from solstice.operators.clean import clean_station_daily
from solstice.operators.climatology import climatology
from solstice.operators.coverage import station_coverage
from solstice.operators.precedence import resolve_precedence, upsert
from solstice.operators.rankings import extremes_rankings, seasonal_rankings
from solstice.operators.records import all_time_extremes
from solstice.operators.rolling import calendar_windows, rolling

D = dt.date


def _series(spark, days_values, station="S"):
    rows = [(station, "m", D(2024, 1, d), float(v) if v is not None else None) for d, v in days_values]
    return spark.createDataFrame(rows, "station_id string, metric_id string, obs_date date, value double")


def test_e1_e4_gappy_rows_vs_calendar(spark):
    s = _series(spark, [(1, 1), (2, 2), (3, 3), (5, 5), (6, 6)])
    rows = {r["obs_date"].day: r["value"] for r in rolling(s, [3], "rows_nonnull").collect()}
    cal = {r["end_date"].day: r["value"] for r in calendar_windows(s, [3]).collect()}
    assert rows[5] == pytest.approx(10 / 3)
    assert cal[5] == pytest.approx(4.0)
    part = {r["obs_date"].day: r["value"] for r in rolling(s, [3], "rows_partial").collect()}
    assert part[1] == 1.0 and part[2] == 1.5


def test_e2_vs_e3_nulls(spark):
    s = _series(spark, [(1, 1), (2, None), (3, 3), (4, 4), (5, 5)])
    e2 = {r["obs_date"].day: r["value"] for r in rolling(s, [2], "rows_nonnull").collect()}
    e3 = {r["obs_date"].day: r["value"] for r in rolling(s, [2], "rows_nullable").collect()}
    assert e2 == {3: 2.0, 4: 3.5, 5: 4.5}          # nulls skipped: day 3 pairs with day 1
    assert e3 == {4: 3.5, 5: 4.5}                  # a null inside the frame gives no point


def test_d2_calendar_year_span(spark):
    df = spark.createDataFrame([("S", D(2020, 12, 31), 1.0, 1.0), ("S", D(2021, 1, 1), None, 1.0)],
                               "station_id string, obs_date date, tavg_c double, prcp_mm double")
    r = station_coverage(df).first()
    assert r["coverage_years"] == 2 and r["completeness_temp_pct"] == 50.0


def test_d10_ties_pick_earliest(spark):
    s = _series(spark, [(1, 5), (2, 1), (3, 5), (4, 1)])
    recs = {r["record_type"]: r for r in all_time_extremes(s, [1]).collect()}
    assert recs["highest"]["end_date"] == D(2024, 1, 1)
    assert recs["lowest"]["end_date"] == D(2024, 1, 2)
    assert recs["highest"]["n_years_considered"] == 1


def test_climatology_monotone_and_min_samples(spark):
    rows = [("S", "m", D(2000, 1, 1) + dt.timedelta(days=i), float((i * 37) % 23)) for i in range(3 * 366)]
    s = spark.createDataFrame(rows, "station_id string, metric_id string, obs_date date, value double")
    c = climatology(rolling(s, [1], "rows_nonnull"), min_samples=10).collect()
    assert len(c) == 366
    for r in c:
        qs = [r[n] for n in ("p02", "p10", "p25", "p50", "p75", "p90", "p98")]
        assert qs == sorted(qs)
        assert r["n_samples"] >= 10
    none = climatology(rolling(s, [1], "rows_nonnull"), min_samples=10_000).count()
    assert none == 0


def test_quantiles_equal_numpy(spark):
    import numpy as np
    vals = [1.0, 2.0, 4.0, 8.0, 16.0]
    from solstice.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([("k", v) for v in vals], "k string, value double")
    r = exact_quantiles(df, ["k"], quantiles=(0.02, 0.5), names=("a", "b")).first()
    assert r["a"] == pytest.approx(np.quantile(vals, 0.02)) and r["b"] == pytest.approx(4.0)


def test_b_rules(spark):
    raw = spark.createDataFrame([
        ("S", "2024-01-01", "-900", "650", None, "0"),       # bounds kept
        ("S", "2024-01-02", "-901", "651", "1", "0"),        # out of range -> null, row dropped
        ("S", "2024-01-03", "80", "20", "50", "0"),          # tmin > tmax -> dropped
        ("S", "2024-01-04", "-30", "40", "-178", "0"),       # (-3, 4, -17.8): deviation 18.3 -> midpoint 0.5
        ("S", "2024-01-05", None, None, "100", "0"),         # tavg only -> dropped
        ("S", "2024-01-06", "-30", "40", "155", "0"),        # deviation exactly 15 kept
        ("S", "2024-02-30", "10", "20", None, "0"),          # bad date quarantined
    ], "STATION string, DATE string, TMIN string, TMAX string, TAVG string, PRCP string")
    out = {r["obs_date"].day: r for r in clean_station_daily(raw).collect()}
    assert set(out) == {1, 4, 6}
    assert out[1]["tmin_c"] == -90.0 and out[1]["tmax_c"] == 65.0
    assert out[4]["tavg_c"] == pytest.approx(0.5)
    assert out[6]["tavg_c"] == pytest.approx(15.5)


def test_i2_precedence_both_orders_and_idempotent_upsert(spark):
    cols = "station_id string, obs_date date, source string, tavg_c double, ingested_at timestamp"
    prov = ("S", D(2024, 1, 1), "open_meteo", 1.0, dt.datetime(2024, 1, 2))
    auth = ("S", D(2024, 1, 1), "ghcn_daily", 2.0, dt.datetime(2024, 1, 5))
    for rows in ([prov, auth], [auth, prov]):
        r = resolve_precedence(spark.createDataFrame(rows, cols)).collect()
        assert len(r) == 1 and r[0]["source"] == "ghcn_daily"
    old = spark.createDataFrame([prov], cols)
    new = spark.createDataFrame([auth], cols)
    once = upsert(old, new, ["station_id", "obs_date"])
    twice = upsert(once, new, ["station_id", "obs_date"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_rankings_stable_ties_and_current(spark):
    rows = []
    for y in range(2000, 2011):
        v = 5.0 if y in (2003, 2004) else float(y - 2000)
        rows.append(("S", "m", D(y, 6, 1), v))
    s = spark.createDataFrame(rows, "station_id string, metric_id string, obs_date date, value double")
    t = spark.createDataFrame([("S", D(2010, 6, 1))], "station_id string, end_date date")
    r = seasonal_rankings(s, t, 1).orderBy("rank").collect()
    assert r[0]["year"] == 2010 and r[0]["direction"] == "warm" and r[0]["current_rank"] == 1
    years = [x["year"] for x in r]
    assert years.index(2003) + 1 == years.index(2004)          # ties keep year order
    cold = extremes_rankings(s, t, 1, "cold").orderBy("rank").collect()
    assert cold[0]["year"] == 2000 and cold[-1]["is_current"]


def test_keep_where_matches_plain_filter(spark):
    from pyspark.sql import functions as F
    from solstice.operators.clean import keep_where
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0)], "k int, v double").withColumn("w", F.col("v") * 2)
    got = keep_where(df, F.col("w") > 5).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(3, 5.0, 10.0)]
    assert keep_where(df, F.col("w").isNotNull()).columns == ["k", "v", "w"]


def test_baseline_choices_disable_options_before_first_year(spark):
    import datetime as dt
    from solstice.operators.coverage import baseline_choices
    cov = spark.createDataFrame([("a", dt.date(1950, 3, 1)), ("b", None)], "station_id string, first_obs_date date")
    got = {(r.station_id, r.label): (r.since_year, r.enabled) for r in baseline_choices(cov, 2024).collect()}
    assert got[("a", "All")] == (None, True)
    assert got[("a", "50yr")] == (1975, True)
    assert got[("a", "75yr")] == (1950, True)
    assert got[("a", "100yr")] == (1925, False)
    assert all(v[1] for k, v in got.items() if k[0] == "b")


def test_registry_lookup_unknown_station_is_error_row(spark):
    from solstice.operators.coverage import registry_lookup
    st = spark.createDataFrame([("x", "12345")], "station_id string, wban string")
    req = spark.createDataFrame([("x",), ("x",), ("y",)], "station_id string")
    got = {r.station_id: r for r in registry_lookup(req, st).collect()}
    assert got["x"].status == "ok" and got["x"].ghcn_station_id == "USW00012345"
    assert got["y"].status == "error" and got["y"].detail == "Station y not found in registry"
