"""Column-returning helpers (all JVM-side expressions, no Python UDFs)."""

from txguard.functions.geo import haversine_km, haversine_km_atan2, deg2rad  # noqa: F401
from txguard.functions.arrays import array_median, array_mean, array_stddev  # noqa: F401
