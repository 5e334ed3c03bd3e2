"""J1 from landed files on sf0.001: restart, idempotence row by row, point reads; manifests of landed files; registry seed."""

import json

import pytest
from pyspark.sql import functions as F

from solstice.operators.climatology import climatology
from solstice.operators.coverage import station_coverage
from solstice.operators.rolling import rolling, to_long
from solstice.plans import backfill as B
from solstice.plans.insights import latest_insights
from solstice.schemas import CLIMATOLOGY_WINDOWS, METRICS
from solstice.sources import manifest as MF
from solstice.sources import tables as T
from solstice.sources.files import read_registry, read_stored
from solstice.sources.store import Store

SF = "/root/testdata/sf0.001"
AT = "2001-11-05 06:00:00"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landed"))
    T.land_files(spark, SF, base)
    return B.Landed(f"{base}/registry", f"{base}/station_csv", f"{base}/manifests", f"{base}/gsod", f"{base}/open_meteo")


def test_a_killed_backfill_goes_on_and_another_run_changes_nothing(spark, landed, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    swap = Store.swap

    def dies(self, name, staged):
        if name == "climatology":
            raise RuntimeError("killed")
        swap(self, name, staged)

    with monkeypatch.context() as m:
        m.setattr(Store, "swap", dies)
        with pytest.raises(RuntimeError):
            B.backfill(store, landed, "first", T.AS_OF, AT)
    assert store.last_commit()["state"] == "staged"
    assert B.backfill(store, landed, "first", T.AS_OF, AT) == ["records", "recent", "insights"]  # the interrupted commit was finished
    assert B.backfill(store, landed, "first", T.AS_OF, AT) == []

    daily = store.read("daily")
    assert daily.count() == daily.select("station_id", "obs_date").distinct().count() > 1000
    assert {r.source for r in daily.select("source").distinct().collect()} == {"ghcn_daily", "gsod", "open_meteo"}
    series = daily.select(*B.DAILY_COLUMNS)
    clim = climatology(rolling(to_long(series, METRICS), CLIMATOLOGY_WINDOWS, "rows_nonnull"))
    assert rows(store.read("climatology").select(*clim.columns)) == rows(clim)
    insights = latest_insights(series, T.AS_OF, stored_climatology=store.read("climatology"))
    assert rows(store.read("latest_insight").select(*insights.columns)) == rows(insights)
    cov = station_coverage(daily).select("station_id", "first_obs_date", "last_obs_date", "coverage_years", F.col("completeness_temp_pct").alias("completeness_pct"))
    assert rows(store.read("station").where("coverage_years is not null").select(*cov.columns)) == rows(cov)

    sid = daily.first()["station_id"]
    point = read_stored(spark, store.path("daily"), {"station_id": sid, "obs_month": 199501})
    assert rows(point.select("obs_date")) == rows(daily.where((F.col("station_id") == sid) & (F.col("obs_month") == 199501)).select("obs_date"))
    assert "PartitionFilters: [isnotnull(obs_month" in point._jdf.queryExecution().executedPlan().toString()

    ledger = store.read("ledger").where("run_id = 'first'")
    assert {r.step for r in ledger.select("step").distinct().collect()} == {n for n, _ in B.STEPS}
    assert ledger.where("step = 'ingest'").agg(F.sum("rows")).first()[0] == daily.count()
    assert store.read("quarantine").where("problem = 'no temperature'").count() > 0

    tables = ("daily", "station", "coverage", "records", "latest_insight")
    before = {t: rows(store.read(t)) for t in tables}
    assert B.backfill(store, landed, "second", T.AS_OF, AT, tuple(s for s in B.STEPS if s[0] not in ("climatology", "recent"))) != []
    assert {t: rows(store.read(t)) for t in tables} == before


def test_landed_files_are_parsed_once_and_written_by_several_tasks(spark, tmp_path, monkeypatch):
    base, seen = str(tmp_path / "in"), []
    monkeypatch.setattr(B, "provisional_fill", lambda existing, *rest, fill=B.provisional_fill: seen.append(existing) or fill(existing, *rest))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.land_files(spark, SF, base)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for kind in ("gsod", "station_csv"):
        assert all(len(list(d.glob("*.csv"))) > 1 for d in (tmp_path / "in" / kind).glob("file=*"))
    store = Store(spark, str(tmp_path / "store"))
    files = B.Landed(f"{base}/registry", f"{base}/station_csv", f"{base}/manifests", f"{base}/gsod", f"{base}/open_meteo")
    B.backfill(store, files, "first", T.AS_OF, AT, B.STEPS[:2])
    assert seen and not [f for f in seen[0].inputFiles() if f.endswith(".csv")]
    kept = store.read("quarantine").where("problem = 'no temperature'").select(F.get_json_object("row", "$.STATION").alias("s"), "station_id")
    assert kept.count() == kept.where("s = station_id").count() > 0


def test_manifest_opens_the_wanted_files_only(spark, tmp_path):
    a, b, c = tmp_path / "in" / "file=A B", tmp_path / "in" / "file=C", tmp_path / "in" / "x"
    for d in (a, b, c):
        d.mkdir(parents=True)
    (a / "1.csv").write_text("STATION,DATE,TMIN,TMAX\nA B,1999-05-01,10,50\nA B,2003-01-01,11,51\n")
    (b / "1.csv").write_text('DATE,"STATION",TAVG,EXTRA\n2010-01-01,C,5,x\n')
    (c / "late.csv").write_text("STATION,DATE,TMIN,TMAX\nD,??,1,2\n")
    (c / "empty.csv").write_text("")
    folder, manifest = str(tmp_path / "in"), str(tmp_path / "manifest")
    assert MF.index_station_csv(spark, folder, manifest) == 3
    assert MF.index_station_csv(spark, folder, manifest) == 0

    def opened(**kw):
        df = MF.scan_station_csv(spark, manifest, **kw)
        return {f.rsplit("/in/", 1)[1] for f in df.inputFiles()}, {tuple(r) for r in df.collect()}

    every, got = opened()
    assert len(every) == 3 and got == {("A B", "1999-05-01", "10", "50", None, None), ("A B", "2003-01-01", "11", "51", None, None),
                                       ("C", "2010-01-01", None, None, "5", None), ("D", "??", "1", "2", None, None)}
    files, got = opened(stations=["C", "Z"])
    assert files == {"file=C/1.csv"} and {r[0] for r in got} == {"C"}
    files, got = opened(stations=["A B"], start="2000-01-01")
    assert files == {"file=A%20B/1.csv"} and {r[1] for r in got} == {"2003-01-01"}
    files, _ = opened(start="2005-01-01")  # a file without a readable year is never passed over
    assert files == {"file=C/1.csv", "x/late.csv"}
    (c / "new.csv").write_text("DATE,STATION\n2011-01-01,E\n")
    assert MF.index_station_csv(spark, folder, manifest) == 1
    assert opened(stations=["E"])[1] == {("E", "2011-01-01", None, None, None, None)}
    assert MF.scan_station_csv(spark, str(tmp_path / "none")).collect() == []


def test_gsod_years_and_registry_numbers(spark, landed):
    MF.index_gsod(spark, landed.gsod, f"{landed.manifests}/gsod-test")
    df = MF.scan_gsod(spark, f"{landed.manifests}/gsod-test", T.stations(spark, SF), None, 1995, 1996)
    assert {r.year for r in df.select("year").distinct().collect()} == {"1995", "1996"}
    assert all("file=1995" in f or "file=1996" in f for f in df.inputFiles() if "/gsod/" in f)
    assert df.select("station_id").distinct().count() > 5


def test_registry_deliveries(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def deliver(n, *stations):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"station_id": s, "name": name, "lat": lat} for s, name, lat in stations]))
        store.upsert("station", B.seeded(store, read_registry(spark, str(tmp_path / f"{n}.json"))), f"seed-{n}", at=AT)

    deliver(1, ("a", "old", 1.0), ("b", "b", 2.0), (None, "nobody", 0.0))
    measured = store.read("station").withColumn("coverage_years", F.lit(30))
    store.upsert("station", measured, "coverage", at=AT)
    deliver(2, ("a", "new", None), ("c", "z", 3.0), ("c", "c", 4.0))
    got = rows(store.read("station").select("station_id", "name", "lat", "coverage_years", "is_active"))
    assert got == [("a", "new", None, 30, True), ("b", "b", 2.0, 30, False), ("c", "c", 4.0, None, True)]
    deliver(3)
    assert {r.is_active for r in store.read("station").collect()} == {False}
