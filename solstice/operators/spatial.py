"""Nearby-station search (C9, F1, H4) as a grid-cell equi-join.

Stations are bucketed into square cells of ``radius / 111`` degrees; each
query point enumerates the cells its search box covers (3 rows of cells, a
few columns), so the join is an equi-join on (cell_y, cell_x) instead of a
nested-loop theta join, and a point only meets stations of nearby cells.  A box
near a pole spans very many columns; such points join on the row of cells
alone.  Only active stations are searched (B15).
Then the box predicate (parity: the method filters by the box only, Q15),
the great-circle distance and a per-point top-k (``row_number``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solstice.functions.geo import bbox_deltas, haversine_km
from solstice.functions.numeric import sround
from solstice.schemas import KM_PER_DEGREE

#: A box over more columns of cells joins on its rows of cells alone.
WIDE_COLUMNS = 64


def nearby(points: DataFrame, stations: DataFrame, radius_km: float = 50.0, limit: int = 10,
           exact_radius: bool = False, point_key: str = "point_id") -> DataFrame:
    """points (point_key, lat, lon) x stations (station_id, lat, lon) ->
    (point_key, station_id, distance_km, rank) for the ``limit`` nearest in the box."""
    cell = radius_km / KM_PER_DEGREE
    if "is_active" in stations.columns:
        stations = stations.where(F.col("is_active"))
    st = stations.select("station_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"),
                         F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx"))
    dlat, dlon = bbox_deltas(F.col("lat"), radius_km)
    p = points.select(point_key, "lat", "lon", dlat.alias("_dlat"), dlon.alias("_dlon"))
    y0, y1 = F.floor((F.col("lat") - F.col("_dlat")) / cell), F.floor((F.col("lat") + F.col("_dlat")) / cell)
    x0 = F.floor((F.col("lon") - F.col("_dlon")) / cell)
    x1 = F.floor((F.col("lon") + F.col("_dlon")) / cell)
    p = p.withColumn("_x0", x0).withColumn("_x1", x1).withColumn("cy", F.explode(F.sequence(y0, y1)))
    wide = (F.col("_x1") - F.col("_x0")) >= WIDE_COLUMNS
    narrow = p.where(~wide).withColumn("cx", F.explode(F.sequence("_x0", "_x1"))).drop("_x0", "_x1")
    j = narrow.join(st, ["cy", "cx"]).unionByName(p.where(wide).drop("_x0", "_x1").join(st, "cy"))
    box = (F.col("s_lat").between(F.col("lat") - F.col("_dlat"), F.col("lat") + F.col("_dlat"))
           & F.col("s_lon").between(F.col("lon") - F.col("_dlon"), F.col("lon") + F.col("_dlon")))
    j = j.where(box).withColumn("distance_km", haversine_km("lat", "lon", "s_lat", "s_lon"))
    if exact_radius:
        j = j.where(F.col("distance_km") <= radius_km)
    w = Window.partitionBy(point_key).orderBy(sround(F.col("distance_km"), 6), F.col("station_id"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        point_key, "station_id", sround(F.col("distance_km"), 2).alias("distance_km"), "rank")
