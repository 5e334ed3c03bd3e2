"""Rules that a shared oracle can't show: wide boxes, NaN days, several periods, missing stations, read errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from solstice.operators.precedence import calendar_gaps
from solstice.operators.rolling import calendar_windows, rolling, window_at
from solstice.operators.spatial import nearby
from solstice.plans.period import period_bands, period_verdicts
from solstice.sources.store import exists


def test_wide_and_polar_boxes_equal_the_plain_box(spark):
    stations = [(f"s{i}", -85.0 + (i * 37) % 175, -179.0 + (i * 53) % 358, i % 4 != 0) for i in range(300)]
    points = [(1, 89.5, -170.0), (2, 0.0, 0.0), (3, -84.0, 179.0), (4, 45.0, 10.0)]
    st = spark.createDataFrame(stations, "station_id string, lat double, lon double, is_active boolean")
    pt = spark.createDataFrame(points, "point_id int, lat double, lon double")
    for radius in (50.0, 300.0, 2000.0):
        got = {(r.point_id, r.station_id) for r in nearby(pt, st, radius_km=radius, limit=1000).collect()}
        want = set()
        from math import cos, radians
        for p, lat, lon in points:
            dy, dx = radius / 111.0, radius / (111.0 * max(cos(radians(lat)), 0.01))
            want |= {(p, s) for s, a, o, on in stations if on and abs(a - lat) <= dy and abs(o - lon) <= dx}
        assert got == want, radius


def test_a_nan_day_is_a_missing_day(spark):
    rows = [("a", "m", dt.date(2024, 1, d), v) for d, v in ((1, 1.0), (2, float("nan")), (3, 3.0), (4, 5.0))]
    df = spark.createDataFrame(rows, "station_id string, metric_id string, obs_date date, value double")
    got = {r.obs_date.day: r.value for r in rolling(df, [2], "rows_nonnull").collect()}
    assert got == {3: 2.0, 4: 4.0}
    got = {r.end_date.day: (r.value, r.n_valid) for r in calendar_windows(df, [2]).collect()}
    assert got == {1: (1.0, 1), 2: (1.0, 1), 3: (3.0, 1), 4: (4.0, 2)}
    ends = spark.createDataFrame([("a", "m", dt.date(2024, 1, d), 2) for d in (2, 3)], "station_id string, metric_id string, end_date date, window_days int")
    got = {r.end_date.day: (r.value, r.n_valid) for r in window_at(df, ends, keys=("station_id", "metric_id")).collect()}
    assert got == {2: (1.0, 1), 3: (3.0, 1)}


def test_two_periods_of_a_station_stay_apart(spark):
    rows = [("a", dt.date(y, m, d), base + y - 2000.0) for y in range(2000, 2006) for m, base in ((1, 0.0), (7, 100.0)) for d in (1, 2, 3)]
    series = spark.createDataFrame(rows, "station_id string, obs_date date, tavg_c double")
    periods = spark.createDataFrame([("a", dt.date(2005, 1, 1), dt.date(2005, 1, 3)), ("a", dt.date(2005, 7, 1), dt.date(2005, 7, 3))],
                                    "station_id string, start_date date, end_date date")
    bands = {(r.start_date.month, r.day_offset): (r.p50, r.n_years) for r in period_bands(series, periods).collect()}
    assert bands[1, 0] == (2.0, 5) and bands[7, 2] == (102.0, 5)
    v = {r.start_date.month: (r.current_avg, r.rank_warm, r.total_years) for r in period_verdicts(series, periods).collect()}
    assert v == {1: (5.0, 1, 6), 7: (105.0, 1, 6)}


def test_a_station_without_rows_misses_every_date(spark):
    daily = spark.createDataFrame([("a", dt.date(2024, 1, 1))], "station_id string, obs_date date")
    every = spark.createDataFrame([("a",), ("b",)], "station_id string")
    got = calendar_gaps(daily, "2024-01-01", "2024-01-02", stations=every).groupBy("station_id").agg(F.count("*").alias("n")).collect()
    assert {r.station_id: r.n for r in got} == {"a": 1, "b": 2}


def test_the_last_delivery_wins_and_other_months_keep_their_files(spark, tmp_path):
    from solstice.streaming.ingest import precedence_order, upsert_partitions, with_month
    table = f"{tmp_path}/daily"

    def deliver(*rows):
        df = spark.createDataFrame([(s, dt.date(2024, m, 1), src, v) for s, m, src, v in rows],
                                   "station_id string, obs_date date, source string, tavg_c double")
        return upsert_partitions(spark, with_month(df), table, ["station_id", "obs_date"], ["obs_month"], precedence_order())

    def stored():
        return {(r.station_id, r.obs_date.month): (r.source, r.tavg_c) for r in spark.read.parquet(table).collect()}

    assert deliver(("a", 1, "gsod", 1.0), ("b", 1, "open_meteo", 1.0), ("a", 2, "gsod", 5.0)) == 3
    february = {p.name for p in (tmp_path / "daily" / "obs_month=202402").iterdir()}
    assert deliver(("a", 1, "gsod", 2.0), ("b", 1, "gsod", 3.0)) == 2  # a correction, and a better source
    assert deliver(("b", 1, "open_meteo", 9.0)) == 1  # a worse source never replaces
    assert deliver() == 0
    assert stored() == {("a", 1): ("gsod", 2.0), ("b", 1): ("gsod", 3.0), ("a", 2): ("gsod", 5.0)}
    assert {p.name for p in (tmp_path / "daily" / "obs_month=202402").iterdir()} == february


def test_only_a_missing_table_is_absent(spark, tmp_path):
    assert not exists(spark, f"{tmp_path}/none")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        exists(spark, f"{tmp_path}/bad")


def test_station_files_are_read_by_column_name(spark, tmp_path):
    from solstice.sources.files import read_csv_by_name
    (tmp_path / "a.csv").write_text('"STATION","DATE","PRCP","TMAX","TMIN"\n"s1","2024-01-01","25","50","-10"\n')
    (tmp_path / "b.csv").write_text('DATE,STATION,TMIN,OTHER\n2024-01-02,s2,7,x\n')
    got = read_csv_by_name(spark, str(tmp_path), StructType([StructField(c, StringType()) for c in ("STATION", "DATE", "TMIN", "TMAX", "PRCP")]))
    assert {tuple(r) for r in got.collect()} == {("s1", "2024-01-01", "-10", "50", "25"), ("s2", "2024-01-02", "7", None, None)}
