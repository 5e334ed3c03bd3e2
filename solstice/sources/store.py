"""The stored tables (A6): rows that keep a table's contract, merged by key (A7), swapped in by commits that survive a crash.

A *contract* is a schema, a key and a layout.  ``Store.conform`` is the only
way into a table: columns are selected by the schema and cast, NaN becomes null
(B19), the time stamp is the caller's parameter (no clock), and a row that
can't be cast, or lacks a required value, gets its problems listed instead of
being written.  Columns that a table gained later are null in older files.

``Store.merge`` joins delivered rows with the stored rows of the partitions
they touch and keeps one row per key; it also says what stood there before, so
that counts can be kept up to date from the difference.

``Store.commit`` makes several tables change together.  Everything is written
to a staging folder first; then a one-row marker names the commit, its tables
and their staging folders; then the partitions are swapped in, and the marker
is set to done.  An overwrite of several partitions is not atomic, but it can
be repeated: ``Store.recover`` finishes a commit whose marker says ``staged``.
A crash before the marker leaves the tables as they were, a crash after it is
completed by the next run.  A marker lost while it is being replaced does no
harm: the commit before it was done, or all its tables were.  One writer per
store at a time, as with any plain Parquet folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solstice import schemas as S
from solstice.session import scratch_path

#: Folders of a table that is laid out by station.
BUCKETS = 256

COVERAGE = T.StructType([
    T.StructField("station_id", T.StringType(), False),
    T.StructField("n_days", T.LongType()),
    T.StructField("n_tavg", T.LongType()),
    T.StructField("n_prcp", T.LongType()),
    T.StructField("first_obs_date", T.DateType()),
    T.StructField("last_obs_date", T.DateType()),
    T.StructField("last_auth_date", T.DateType()),
])
QUARANTINE = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("batch", T.LongType(), False),
    T.StructField("station_id", T.StringType()),
    T.StructField("problem", T.StringType(), False),
    T.StructField("row", T.StringType()),
])
LEDGER = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("batch", T.LongType(), False),
    T.StructField("step", T.StringType(), False),
    T.StructField("station_id", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("at", T.TimestampType()),
])


def _month() -> Column:
    return F.year("obs_date") * 100 + F.month("obs_date")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("station_id"), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Table:
    """Contract of a table: ``derived`` are layout columns computed from a row, ``layout`` all folder columns."""

    schema: T.StructType
    keys: tuple[str, ...]
    layout: tuple[str, ...]
    derived: tuple[tuple[str, Callable[[], Column]], ...] = ()
    stamp: str | None = None

    @property
    def stored(self) -> T.StructType:
        """Schema of the files with the layout columns, all nullable."""
        return T.StructType([T.StructField(f.name, f.dataType) for f in self.schema.fields]
                            + [T.StructField(n, T.IntegerType()) for n, _ in self.derived])


_BY_STATION = (("bucket", _bucket),)
TABLES: dict[str, Table] = {
    "daily": Table(S.DAILY, S.KEYS["daily"], ("obs_month",), (("obs_month", _month),), "ingested_at"),
    "station": Table(S.STATION, S.KEYS["station"], ("bucket",), _BY_STATION, "updated_at"),
    "window_recent": Table(S.WINDOW_RECENT, S.KEYS["window_recent"], ("bucket",), _BY_STATION, "computed_at"),
    "climatology": Table(S.CLIMATOLOGY, S.KEYS["climatology"], ("metric_id", "window_days"), (), "computed_at"),
    "records": Table(S.RECORDS, S.KEYS["records"], ("bucket",), _BY_STATION, "computed_at"),
    "latest_insight": Table(S.LATEST_INSIGHT, S.KEYS["latest_insight"], ("bucket",), _BY_STATION, "computed_at"),
    "coverage": Table(COVERAGE, ("station_id",), ("bucket",), _BY_STATION),
    "quarantine": Table(QUARANTINE, (), ("run_id", "batch")),
    "ledger": Table(LEDGER, ("run_id", "batch", "step", "station_id"), ("run_id", "batch", "step"), (), "at"),
}


def exists(spark: SparkSession, path: str) -> bool:
    """False only where the path is missing or empty; any other read error is raised."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


class Store:
    """Stored tables under one folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, base: str, tables: Mapping[str, Table] = TABLES, marker: str = "_commit"):
        self.spark, self.base, self.tables, self.marker = spark, base.rstrip("/"), dict(tables), marker

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read(self, name: str) -> DataFrame:
        """All rows with the layout columns; an empty table where none was committed."""
        schema = self.tables[name].stored
        if not exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self.path(name))
        return df.select(*schema.names)

    # -- rows that keep the contract -------------------------------------------------

    def conform(self, name: str, df: DataFrame, at: str | None = None, problems: str = "problems") -> DataFrame:
        """The table's columns, its layout columns and ``problems``: why a row can't be written (empty: it can)."""
        t, out, wrong = self.tables[name], [], []
        for f in t.schema.fields:
            raw = F.col(f.name) if f.name in df.columns else F.lit(None)
            value = F.lit(at).cast("timestamp") if f.name == t.stamp and at is not None else raw.try_cast(f.dataType)
            if f.name in df.columns and f.name != t.stamp:
                wrong.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}")))
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                value = F.when(~F.isnan(value), value)
            if not f.nullable:
                missing = F.col(f.name).isNull() if f.name in df.columns else F.lit(True)
                wrong.append(F.when(missing, F.lit(f"{f.name}: missing")))
            out.append(value.alias(f.name))
        checked = df.select(*out, F.array_compact(F.array(*wrong)).alias(problems))
        for n, made in t.derived:
            checked = checked.withColumn(n, made())
        return checked

    # -- merge by key ------------------------------------------------------------------

    def merge(self, name: str, batch: DataFrame, order: Sequence[Column] = ()) -> DataFrame | None:
        """Whole new content of the partitions that ``batch`` touches, with ``delivered`` (the row is the batch's) and
        ``before`` (the other columns of the stored row of that key); None for an empty batch.

        Per key the row with the greatest ``order`` wins, then a delivered row, then the greatest other columns.
        ``batch`` must be stored: it is read several times.
        """
        t = self.tables[name]
        cols = t.stored.names
        rest = [c for c in cols if c not in t.keys]
        bounds = batch.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(t.layout)
                                                           for k, f in (("lo", F.min), ("hi", F.max))]).first()
        if not bounds["n"]:
            return None
        old = self.read(name)
        for i, c in enumerate(t.layout):  # literal bounds prune folders, the semi join is exact
            old = old.where(F.col(c).isNull() | F.col(c).between(F.lit(bounds[f"lo{i}"]), F.lit(bounds[f"hi{i}"])))
        touched = batch.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(t.layout)]).distinct()
        old = old.join(touched, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(t.layout)], "left_semi")
        both = old.select(*cols, F.lit(False).alias("delivered")).unionByName(batch.select(*cols, F.lit(True).alias("delivered")))
        row = F.struct(*rest)
        best = both.groupBy(*t.keys).agg(
            F.max_by(F.struct(*rest, "delivered"), F.struct(*order, "delivered", *rest)).alias("_best"),
            F.max(F.when(~F.col("delivered"), row)).alias("before"))
        return best.select(*t.keys, "_best.*", "before").select(*cols, "delivered", "before")

    # -- commits -----------------------------------------------------------------------

    def stage(self, name: str, rows: DataFrame) -> str:
        """Write the new content of some partitions of a table beside it; returns the folder."""
        t, path = self.tables[name], scratch_path(self.spark, f"staged-{name}")
        rows.hint("rebalance", *t.layout).write.parquet(path)
        return path

    def _marker(self) -> str:
        return f"{self.base}/{self.marker}"

    def last_commit(self) -> dict | None:
        """Commit id, state and staged folders of the last commit."""
        schema = "commit_id string, state string, staged map<string, string>"
        try:
            row = self.spark.read.schema(schema).json(self._marker()).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return row.asDict() if row else None

    def _mark(self, commit_id: str, state: str, staged: Mapping[str, str]) -> None:
        schema = "commit_id string, state string, staged map<string, string>"
        self.spark.createDataFrame([(commit_id, state, dict(staged))], schema).coalesce(1).write.mode("overwrite").json(self._marker())

    def swap(self, name: str, staged: str) -> None:
        t = self.tables[name]
        rows = self.spark.read.parquet(staged).select(*t.stored.names)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*t.layout).parquet(self.path(name)))

    def commit(self, commit_id: str, staged: Mapping[str, str]) -> None:
        """Swap the staged partitions of all tables in; repeated by ``recover`` if it is interrupted."""
        self._mark(commit_id, "staged", staged)
        self._finish(commit_id, staged)

    def _finish(self, commit_id: str, staged: Mapping[str, str]) -> None:
        for name, path in staged.items():
            self.swap(name, path)
        self._mark(commit_id, "done", staged)
        for name, path in staged.items():  # the rows are in the table now: free the folder
            self.spark.createDataFrame([], self.tables[name].stored).write.mode("overwrite").parquet(path)

    def recover(self) -> str | None:
        """Finish an interrupted commit; returns the id of the last commit, which is done then."""
        last = self.last_commit()
        if last is not None and last["state"] == "staged":
            self._finish(last["commit_id"], last["staged"])
        return last and last["commit_id"]

    def upsert(self, name: str, df: DataFrame, commit_id: str, at: str | None = None, order: Sequence[Column] = (),
               extra: Mapping[str, str] | None = None) -> DataFrame:
        """Conform, merge and commit ``df`` (with other tables already staged, ``extra``); returns the rejected rows."""
        self.recover()
        checked = self.written(self.conform(name, df, at))
        merged = self.merge(name, checked.where(F.size("problems") == 0).drop("problems"), order)
        staged = dict(extra or {})
        if merged is not None:
            staged[name] = self.stage(name, merged.select(*self.tables[name].stored.names))
        if staged:
            self.commit(commit_id, staged)
        return checked.where(F.size("problems") > 0)

    def written(self, df: DataFrame, name: str = "arrived") -> DataFrame:
        """``df`` computed once, in the shared scratch folder."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def last_updated(store: Store) -> DataFrame:
    """The newest ``computed_at`` of the latest insights (null: none)."""
    return store.read("latest_insight").agg(F.max("computed_at").alias("last_updated"))


def station_coverage_of(coverage: DataFrame) -> DataFrame:
    """D2 from the maintained counts."""
    from solstice.functions.numeric import sround
    return coverage.select(
        "station_id", "first_obs_date", "last_obs_date",
        (F.year("last_obs_date") - F.year("first_obs_date") + 1).cast("int").alias("coverage_years"),
        sround(100.0 * F.col("n_tavg") / F.col("n_days"), 1).alias("completeness_temp_pct"),
        sround(100.0 * F.col("n_prcp") / F.col("n_days"), 1).alias("completeness_prcp_pct"))
