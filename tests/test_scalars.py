"""Scalar functions on known values, and against Python's own rules."""

import math
import random

from pyspark.sql import functions as F

from shutterlake.functions import scalars as S


def values(spark, column, xs, kind="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in df.select(column.alias("y"), "i").orderBy("i").select("y").collect()]


def test_round_exact_is_python_round(spark):
    random.seed(1)
    xs = [0.15, 0.35, 27.25, 2.5, 0.25, -0.15, 1e-7, 0.0, 123456.785] + [1 / n for n in range(1, 3000)] + [random.uniform(0, 500) for _ in range(2000)] + [random.randrange(10**5) / 1000 for _ in range(2000)]
    for places in (1, 2, 6):
        assert values(spark, S.round_exact("x", places), xs) == [round(x, places) for x in xs]


def test_snap(spark):
    assert values(spark, S.snap_focal("x"), [23.4, 33.0, 51.2, 3.0, 1200.0, 0.0, -1.0]) == [24, 35, 50, 8, 1200, 0, 0]
    assert values(spark, S.snap_fstop("x"), [1.79, 5.5, 11.4, 200.0, 0.0]) == [1.8, 5.6, 11.0, 32.0, 0.0]
    assert values(spark, S.snap_iso("x"), [160, 1234, 0, 500000], "int") == [160, 1250, 0, 500000]


def test_shutter(spark):
    xs = [1 / 250, 1 / 60, 1.0, 30.0, 2.5, 1 / 8000, 0.0, None, 1 / 127, 2.25]
    assert values(spark, S.format_shutter("x"), xs) == ["1/250", "1/60", "1s", "30s", "2.5s", "1/8000", "?", "?", "1/125", "2.2s"]
    assert values(spark, S.shutter_stop("x"), [1 / 250, 1.0, 0.0, 1e-9, None]) == [-8, 0, None, -30, None]
    assert values(spark, S.shutter_label("x"), [-8, -15, -16, 0, 3], "int") == ["1/250", "1/32000", "1/65500", "1s", "8s"]


def test_coordinates(spark):
    got = values(spark, S.round_coord("x", 2), [151.2093, -151.2093, -0.001, 39.985, -10.005])
    assert got == [151.21, -151.21, 0.0, 39.99, -10.01] and math.copysign(1, got[2]) == 1
    df = spark.range(1).select(S.format_coordinate(F.lit(-33.86), F.lit(151.21), 2), S.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522)))
    text, km = df.first()
    assert text == "33.86 S, 151.21 E" and abs(km - 343.6) < 0.5


def test_trim_and_derived(spark):
    assert values(spark, S.trim("x"), [1.8, 8.0, 10.0, 0.04, 2.25]) == ["1.8", "8", "10", "0", "2.2"]
    r = spark.sql("SELECT timestamp_ntz'2024-06-21 01:00:00' AS taken, 90 AS tz_minutes, 6000 AS width, 4000 AS height").select(S.iso_time(S.taken_utc()), S.megapixels()).first()
    assert tuple(r) == ("2024-06-20 23:30:00", 24.0)


def test_twilight(spark):
    """London, New York and Sydney by published almanacs (UTC hours, a quarter of an hour); the poles."""
    rows = [(51.51, -0.13, 172, 2.93, 21.18), (51.51, -0.13, 355, 7.4, 16.58), (40.71, -74.01, 172, 8.87, 25.07), (-33.87, 151.21, 172, -3.53, 7.37)]
    df = spark.createDataFrame(rows, "lat double, lon double, day int, dawn double, dusk double").select("*", S.civil_twilight("lat", "lon", "day").alias("sun"))
    for r in df.collect():
        assert abs(r["sun"]["dawn"] - r["dawn"]) < 0.25 and abs(r["sun"]["dusk"] - r["dusk"]) < 0.25
    polar = spark.createDataFrame([(80.0, 0.0, 172), (80.0, 0.0, 355), (90.0, 0.0, 80), (91.0, 0.0, 80)], "lat double, lon double, day int")
    assert [r[0] for r in polar.select(S.civil_twilight("lat", "lon", "day")).collect()] == [None] * 4


def test_golden(spark):
    hours = spark.range(24).select("id", S.in_golden(F.col("id"), F.lit(5.2), F.lit(20.0)).alias("g"))
    assert [r["id"] for r in hours.collect() if r["g"]] == [6, 19, 20]
