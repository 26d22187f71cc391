"""Unit vectors (deg2rad, distance, median, sample std) on Spark expressions."""

import math

from pyspark.sql import functions as F

from txguard.functions import array_median, array_stddev, deg2rad, haversine_km, haversine_km_atan2


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_deg2rad(spark):
    assert math.isclose(one(spark, deg2rad(F.lit(180.0))), math.pi)
    assert math.isclose(one(spark, deg2rad(F.lit(90.0))), math.pi / 2)


def test_distance_same_point(spark):
    assert one(spark, haversine_km_atan2(F.lit(40.7128), F.lit(-74.0060), F.lit(40.7128), F.lit(-74.0060))) == 0
    assert one(spark, haversine_km(F.lit(40.7128), F.lit(-74.0060), F.lit(40.7128), F.lit(-74.0060))) == 0


def test_distance_new_york_london(spark):
    for fn in (haversine_km, haversine_km_atan2):
        d = one(spark, fn(F.lit(40.7128), F.lit(-74.0060), F.lit(51.5074), F.lit(-0.1278)))
        assert 5500 < d < 5650


def arr(spark, values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def test_median(spark):
    assert one(spark, array_median(arr(spark, []))) == 0
    assert one(spark, array_median(arr(spark, [3, 1, 4, 1, 5]))) == 3
    assert one(spark, array_median(arr(spark, [3, 1, 4, 2]))) == 2.5


def test_stddev(spark):
    assert one(spark, array_stddev(arr(spark, []))) == 0
    assert one(spark, array_stddev(arr(spark, [5]))) == 0
    v = one(spark, array_stddev(arr(spark, [2, 4, 4, 4, 5, 5, 7, 9]), F.lit(5.0)))
    assert math.isclose(v, 2.138089935299395, rel_tol=1e-12)


def test_to_fixed(spark):
    from txguard.functions.text import to_fixed
    assert one(spark, to_fixed(F.lit(12.25), 1)) == "12.3"
    assert one(spark, to_fixed(F.lit(0.04), 1)) == "0.0"
    assert one(spark, to_fixed(F.lit(1814.7), 0)) == "1815"
    assert one(spark, to_fixed(F.lit(100.0), 1)) == "100.0"
