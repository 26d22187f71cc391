"""Great-circle distances as Spark Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txguard.schemas import EARTH_RADIUS_KM


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def deg2rad(x) -> Column:
    return F.radians(_c(x))


def _hav_a(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
            + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
            * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine in km, arcsin form (batch path).

    ``a`` is clamped to 1 so rounding noise cannot produce NaN.
    """
    a = _hav_a(lat1, lon1, lat2, lon2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_km_atan2(lat1, lon1, lat2, lon2) -> Column:
    """Haversine in km, atan2 form (online path)."""
    a = _hav_a(lat1, lon1, lat2, lon2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))
