"""Store contract and commits, incremental ingest and refresh: crashes, replays, bad rows, bounds."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solstice.operators.coverage import station_coverage
from solstice.plans.insights import latest_insights
from solstice.sources.store import Store, Table, last_updated, station_coverage_of
from solstice.streaming import refresh as R

AS_OF = "2020-03-10"
LANDED = "STATION string, DATE string, TMIN string, TMAX string, TAVG string, PRCP string, source string"


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame([("A", True), ("B", True), ("C", True), ("OFF", False), ("NUL", None)], "station_id string, is_active boolean")


def landed(spark, rows):
    """(station, date, tmin, source) rows; the other columns follow."""
    out = [(s, d, t, str(int(t) + 100) if t.lstrip("-").isdigit() else None, None, "5", src) for s, d, t, src in rows]
    return spark.createDataFrame(out, LANDED)


def run(store, spark, n, rows, stations, at=None, **kw):
    return R.refresh_batch(store, landed(spark, rows), n, "r", stations, AS_OF, at or f"2020-03-10 0{n}:00:00", **kw)


def test_contract(spark, store):
    df = spark.createDataFrame(
        [("A", "2020-01-01", "1.5", "nan", "x"), ("B", "no date", "1", None, "x"), (None, "2020-01-01", None, None, "x"), ("C", "2020-02-30", "cold", None, "x")],
        "station_id string, obs_date string, tmin_c string, tavg_c string, other string")
    out = {r.station_id: r for r in store.conform("daily", df, "2020-05-01 00:00:00").collect()}
    assert out["A"].problems == [] and out["A"].tmin_c == 1.5 and out["A"].tavg_c is None and out["A"].obs_month == 202001
    assert out["A"].prcp_mm is None and str(out["A"].ingested_at) == "2020-05-01 00:00:00" and "other" not in out["A"]
    assert out["B"].problems == ["obs_date: not date"]
    assert out[None].problems == ["station_id: missing"]
    assert out["C"].problems == ["obs_date: not date", "tmin_c: not double"]
    lacking = store.conform("daily", spark.createDataFrame([("A",)], "station_id string")).first()
    assert lacking.problems == ["obs_date: missing"]


def test_duplicate_keys_and_a_column_gained_later(spark, tmp_path):
    old = Table(T.StructType([T.StructField("k", T.StringType(), False), T.StructField("p", T.IntegerType()), T.StructField("v", T.DoubleType())]), ("k",), ("p",))
    new = Table(T.StructType([*old.schema.fields, T.StructField("note", T.StringType())]), ("k",), ("p",))
    first = Store(spark, str(tmp_path / "s"), {"t": old})
    first.upsert("t", spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 2, 3.0), ("z", 3, 9.0)], "k string, p int, v double"), "1")
    assert rows_of(first.read("t"), "k", "v") == [("a", 2.0), ("b", 3.0), ("z", 9.0)]
    again = Store(spark, str(tmp_path / "s"), {"t": new})
    rejected = again.upsert("t", spark.createDataFrame([("b", 2, "4", "n"), (None, 2, "5", "n"), ("c", 1, "bad", "n")], "k string, p int, v string, note string"), "2")
    assert rows_of(again.read("t"), "k", "v", "note") == [("a", 2.0, None), ("b", 4.0, "n"), ("z", 9.0, None)]
    assert rows_of(rejected, "k", "problems") == [("c", ["v: not double"]), (None, ["k: missing"])]
    assert rejected.count() == 2 and again.upsert("t", rejected.limit(0), "3").count() == 0


@pytest.mark.parametrize("after", [0, 1])
def test_crash_while_swapping(spark, tmp_path, monkeypatch, after):
    """Killed before the first or between two tables' swaps: the next run finishes that commit, and then its own."""
    t = Table(T.StructType([T.StructField("k", T.StringType(), False), T.StructField("p", T.IntegerType())]), ("k",), ("p",))
    s = Store(spark, str(tmp_path / "s"), {"x": t, "y": t})
    one, two = (spark.createDataFrame([(c, i)], "k string, p int") for i, c in enumerate("ab"))
    s.commit("1", {n: s.stage(n, one) for n in "xy"})
    calls, swap = [], Store.swap

    def dies(self, name, staged):
        if len(calls) == after:
            raise RuntimeError("killed")
        calls.append(name)
        swap(self, name, staged)

    monkeypatch.setattr(Store, "swap", dies)
    with pytest.raises(RuntimeError):
        s.commit("2", {n: s.stage(n, two) for n in "xy"})
    monkeypatch.setattr(Store, "swap", swap)
    s = Store(spark, s.base, s.tables)
    assert s.last_commit()["state"] == "staged" and s.recover() == "2" and s.last_commit()["state"] == "done"
    for n in "xy":
        assert rows_of(s.read(n), "k", "p") == [("a", 0), ("b", 1)]
    assert s.recover() == "2"


BATCHES = [
    [("A", "2020-01-01", "10", "ghcn_daily"), ("A", "2020-01-02", "20", "ghcn_daily"), ("A", "2020-01-02", "25", "ghcn_daily"), ("A", "2020-01-04", "40", "open_meteo"),
     ("A", "2020-01-02", "99", "open_meteo"), ("B", "2020-01-02", "10", "gsod"), ("C", "2020-01-02", "10", "open_meteo"), ("OFF", "2020-01-02", "10", "gsod"),
     ("NUL", "2020-01-02", "10", "gsod"), ("X", "2020-01-02", "10", "gsod"), ("B", "??", "10", "gsod"), ("B", "2020-01-03", "x", "gsod"), ("B", "2020-03-10", "1", "gsod"),
     (None, "2020-01-01", "1", "gsod"), ("B", None, "1", None)],
    [("A", "2020-01-01", "77", "ghcn_daily"), ("A", "2020-01-02", "22", "ghcn_daily"), ("A", "2020-01-04", "44", "gsod"), ("A", "2020-01-05", "50", "open_meteo")],
    [("A", "2020-01-04", "45", "ghcn_daily"), ("A", "2020-01-04", "1", "open_meteo"), ("A", "2020-01-05", "51", "open_meteo")],
]
#: After each batch: station, day, minimum, source.
WANT = [
    [("A", "2020-01-01", 1.0, "ghcn_daily"), ("A", "2020-01-02", 2.5, "ghcn_daily"), ("A", "2020-01-04", 4.0, "open_meteo"), ("B", "2020-01-02", 1.0, "gsod")],
    [("A", "2020-01-01", 1.0, "ghcn_daily"), ("A", "2020-01-02", 2.2, "ghcn_daily"), ("A", "2020-01-04", 4.4, "gsod"), ("A", "2020-01-05", 5.0, "open_meteo"),
     ("B", "2020-01-02", 1.0, "gsod")],
    [("A", "2020-01-01", 1.0, "ghcn_daily"), ("A", "2020-01-02", 2.2, "ghcn_daily"), ("A", "2020-01-04", 4.5, "ghcn_daily"), ("A", "2020-01-05", 5.1, "open_meteo"),
     ("B", "2020-01-02", 1.0, "gsod")],
]


def daily(store):
    return rows_of(store.read("daily"), "station_id", F.col("obs_date").cast("string"), "tmin_c", "source")


def coverage_is_right(store):
    cols = ("station_id", "first_obs_date", "last_obs_date", "coverage_years", "completeness_temp_pct", "completeness_prcp_pct")
    assert rows_of(station_coverage_of(store.read("coverage")), *cols) == rows_of(station_coverage(store.read("daily")), *cols)


def test_incremental_batches(spark, store, stations):
    for n, (rows, want) in enumerate(zip(BATCHES, WANT)):
        seen = run(store, spark, n, rows, stations, insights=False)
        assert daily(store) == want
        coverage_is_right(store)
        if n == 0:
            assert seen == {"rows": 12, "rejected": 5}
            assert rows_of(store.read("quarantine"), "station_id", "problem") == [
                ("B", "no temperature"), ("B", "unreadable date"), ("B", "unreadable date"), ("X", "unknown station"), (None, "unknown station")]
    ledger = store.read("ledger")
    assert rows_of(ledger, "batch", "station_id", "rows", "source", F.array_join("errors", "; ")) == [
        (0, "A", 3, "ghcn_daily+open_meteo", ""), (0, "B", 1, "gsod", "no temperature: 1; unreadable date: 2"), (0, "X", 0, None, "unknown station: 1"),
        (0, None, 0, None, "unknown station: 1"), (1, "A", 3, "ghcn_daily+gsod+open_meteo", ""), (2, "A", 2, "ghcn_daily+open_meteo", "")]
    assert rows_of(R.run_totals(ledger), "batch", "stations", "rows", "stations_with_errors") == [(0, 2, 4, 3), (1, 1, 3, 0), (2, 1, 2, 0)]


def test_only_rejected_rows_keep_their_text(spark, stations):
    rows = R._checked(landed(spark, [("A", "2020-01-01", "10", "ghcn_daily"), ("A", "??", "10", "ghcn_daily"), ("X", "2020-01-01", "10", "gsod")]), stations, AS_OF)
    text = '{{"STATION":"{}","DATE":"{}","TMIN":"10","TMAX":"110","PRCP":"5","source":"{}"}}'
    assert rows_of(rows, "problem", "row") == [("unknown station", text.format("X", "2020-01-01", "gsod")), ("unreadable date", text.format("A", "??", "ghcn_daily")), (None, None)]


def test_a_replayed_batch_changes_nothing(spark, store, stations):
    for n in (0, 1):
        run(store, spark, n, BATCHES[n], stations, insights=False)
    before = rows_of(store.read("coverage"), "*"), daily(store)
    assert run(store, spark, 1, BATCHES[1], stations, insights=False) is None
    assert (rows_of(store.read("coverage"), "*"), daily(store)) == before


def test_a_batch_whose_marker_was_lost(spark, store, stations):
    """Ingested again: the same rows replace themselves, and the coverage counts see no difference."""
    run(store, spark, 0, BATCHES[0], stations, insights=False)
    before = rows_of(store.read("coverage"), "*"), daily(store)
    store._mark("other", "done", {})
    run(store, spark, 0, BATCHES[0], stations, insights=False)
    assert (rows_of(store.read("coverage"), "*"), daily(store)) == before


def test_empty_and_hopeless_batches(spark, store, stations):
    run(store, spark, 0, [], stations)
    run(store, spark, 1, [("X", "2020-01-02", "10", "gsod"), ("OFF", "2020-01-02", "10", "gsod")], stations)
    assert daily(store) == [] and rows_of(store.read("ledger"), "batch", "station_id", "rows") == [(1, "X", 0)]
    assert store.read("latest_insight").count() == 0 and last_updated(store).first().last_updated is None


def files(store):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{store.path('latest_insight')}/bucket=*/*.parquet")}


def test_refresh_touches_its_stations_only(spark, store, stations, monkeypatch):
    days = [f"2020-02-{d:02d}" for d in range(1, 29)]
    run(store, spark, 0, [(s, d, str(10 * i + ord(s)), "gsod") for s in "ABC" for i, d in enumerate(days)], stations)
    assert store.read("latest_insight").select("station_id").distinct().count() == 3
    before = files(store)
    more = [("A", "2020-03-01", "300", "gsod"), ("A", "2020-03-02", "310", "gsod")]

    def dies(*a, **k):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # the second sink dies, the replay completes it
        m.setattr(R, "latest_insights", dies)
        with pytest.raises(RuntimeError):
            run(store, spark, 1, more, stations)
    assert files(store) == before
    ingested = daily(store)
    assert run(store, spark, 1, more, stations) is None and daily(store) == ingested
    after = files(store)
    mine = {r.bucket for r in store.read("latest_insight").where("station_id = 'A'").collect()}
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all(any(f"/bucket={b}/" in f for b in mine) for f in changed)
    cols = ["station_id", "window_days", "end_date", "value", "percentile", "severity", "primary_statement", "supporting_line"]
    assert rows_of(store.read("latest_insight"), *cols) == rows_of(latest_insights(store.read("daily"), AS_OF), *cols)
    stamps = dict(rows_of(store.read("latest_insight"), "station_id", F.col("computed_at").cast("string")))
    assert stamps == {"A": "2020-03-10 01:00:00", "B": "2020-03-10 00:00:00", "C": "2020-03-10 00:00:00"}
    assert str(last_updated(store).first().last_updated) == "2020-03-10 01:00:00"


