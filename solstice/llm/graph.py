"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here, a lost executor costs nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u, v (long).  Returns node, label: the smallest node reachable.

    Every step keeps per-node minima (partial aggregates) and joins them back,
    so a node with very many edges is never gathered in one task.  Nodes
    without an edge to another node are not returned.
    """
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "cc")
    mark = _mark(e)
    while mark[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
