"""Exact interpolated quantiles over calendar-bounded groups.

Every caller groups a daily series by something that bounds the group by
the calendar, not by data volume: (series, day-of-year band) holds at most
15 values per year of history, (series, day offset) one per year.  Such a
group is collected into one array (``collect_list`` has a map-side partial
phase), sorted in place (``array_sort``), and the two order statistics
around each position are interpolated:

    pos = q * (n - 1);  x[floor(pos)] + (pos - floor(pos)) * (x[ceil(pos)] - x[floor(pos)])

which is the linear rule of numpy's default quantile and of SQL
``percentile_cont``.  Sorting a few hundred doubles per group in an array is
cheaper than a window sort over the exploded rows (one row object per
value) and than ``percentile``, which keeps a hash map of counts per group.
``approx_percentile`` is not a substitute: it does not interpolate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstice.schemas import QUANTILE_NAMES, QUANTILES


def interpolated(sorted_arr: Column, quantiles: Sequence[float] = QUANTILES,
                 names: Sequence[str] = QUANTILE_NAMES) -> list[Column]:
    """Linear-interpolation quantiles of an ascending array (null when empty)."""
    n = F.size(sorted_arr)
    outs = []
    for q, name in zip(quantiles, names):
        p = F.lit(float(q)) * (n - 1)
        lo = F.element_at(sorted_arr, (F.floor(p) + 1).cast("int"))
        hi = F.element_at(sorted_arr, (F.ceil(p) + 1).cast("int"))
        outs.append(F.when(n > 0, lo + (p - F.floor(p)) * (hi - lo)).alias(name))
    return outs


def _alias_of(c: Column) -> str:
    return c._jc.toString().split(" AS ")[-1].strip("`")  # noqa: SLF001


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str = "value",
                    quantiles: Sequence[float] = QUANTILES, names: Sequence[str] = QUANTILE_NAMES,
                    extra_aggs: Sequence = (), count_name: str = "n_samples") -> DataFrame:
    """Per group of ``keys``: one column per quantile, the count, and ``extra_aggs``.

    Null values are ignored.  Output: keys..., names..., count_name, extras...
    The caller guarantees calendar-bounded groups (see module doc).
    """
    agg = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(value)).alias("_s"), *extra_aggs)
    return agg.select(*keys, *interpolated(F.col("_s"), quantiles, names),
                      F.size("_s").cast("long").alias(count_name), *[F.col(_alias_of(a)) for a in extra_aggs])
