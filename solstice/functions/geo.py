"""Great-circle distance and bounding-box pre-filter (H4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from solstice.schemas import EARTH_RADIUS_KM, KM_PER_DEGREE


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Spherical law of cosines with the argument clamped to [-1, 1]."""
    la1, la2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    arg = F.cos(la1) * F.cos(la2) * F.cos(dl) + F.sin(la1) * F.sin(la2)
    return F.lit(EARTH_RADIUS_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), arg)))


def bbox_deltas(lat, radius_km: float) -> tuple[Column, Column]:
    """(dlat, dlon) in degrees of the search box around a point."""
    dlat = F.lit(radius_km / KM_PER_DEGREE)
    dlon = F.lit(radius_km) / (F.lit(KM_PER_DEGREE) * F.greatest(F.cos(F.radians(_c(lat))), F.lit(0.01)))
    return dlat, dlon
