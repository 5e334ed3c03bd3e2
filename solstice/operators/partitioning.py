"""Series-level partitioning.

Every per-series job (rolling frames, DOY fan-out, per-DOY quantile sort,
per-series arg-extremes) clusters on a *superset* of the series key.  So the
daily table is hash-partitioned once by the series key and every later
``Window``/``groupBy`` on (series, window_days, end_doy, ...) is satisfied
without another exchange; the x15 DOY fan-out never crosses the network.

The partition count is explicit (``spark.sql.shuffle.partitions`` unless
given): AQE sizes partitions by the bytes *entering* the exchange and would
merge them into a handful of tasks, although the work after it (frames x
windows x 15 fan-out) is many times larger.  A series holds at most one row
per calendar day, so no single key can dominate a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def default_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        n = max(n, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no SparkContext
        pass
    return n


def cluster_by_series(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Hash-partition by the series key with an explicit partition count."""
    return df.repartition(partitions or default_partitions(df), *keys)
