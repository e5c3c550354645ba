"""Operators on small tables: bands, runs, buckets, absences, zooms, places, habits."""

import itertools
import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import calendar, counters, exposure, gear, habits, ordered, places
from shutterlake.operators.frames import Options, keyed, photos
from shutterlake.schema import BRONZE

BASE = {"status": "ok", "bytes_read": 512, "container": "jpeg", "camera": "FUJIFILM X-T4", "lens": "XF23mmF1.4 R", "focal": 23.0, "fnumber": 1.4, "exposure": 1 / 250, "iso": 400, "taken": datetime(2024, 6, 21, 7, 30), "tz_minutes": 60}
NAMES = [x.split(" ")[0] for x in BRONZE.split(", ")]


def bronze(spark, rows):
    full = [dict.fromkeys(NAMES) | BASE | {"path": f"/p/{i}.jpg"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], BRONZE)


def frames(spark, rows, o=Options()):
    return keyed(photos(bronze(spark, rows), o), o)


def counter(spark, table, key="focal", kind="double"):
    return spark.createDataFrame([(k if kind != "double" else float(k), n) for k, n in table.items()], f"{key} {kind}, n bigint")


def band(table, share=0.5):
    ks, total = sorted(table), sum(table.values())
    best = min(((b - a, b, a) for a, b in itertools.combinations_with_replacement(ks, 2) if sum(table[k] for k in ks if a <= k <= b) >= share * total), key=lambda x: (x[0], x[1], -x[2]))
    n = sum(table[k] for k in ks if best[2] <= k <= best[1])
    return best[2], best[1], n


def test_band(spark):
    got = ordered.narrowest_band(counter(spark, {24: 450, 25: 100, 70: 450}), "focal").first()
    assert (got["low"], got["high"], got["n"]) == (24, 25, 550)
    got = ordered.narrowest_band(counter(spark, {33: 100, 35: 800, 37: 100}), "focal").first()
    assert got["low"] == got["high"] == 35
    random.seed(4)
    for _ in range(12):
        table = {float(k): random.randint(1, 50) for k in random.sample(range(10, 90), random.randint(1, 15))}
        got = ordered.narrowest_band(counter(spark, table), "focal").first()
        assert (got["low"], got["high"], got["n"]) == band(table)
    assert ordered.narrowest_band(counter(spark, {}), "focal").count() == 0


def test_ranks(spark):
    got = counters.ranks(counter(spark, {100: 10, 200: 10, 400: 10, 800: 10}), "focal", a=0.25, b=0.5, c=0.95).first()
    assert tuple(got) == (100, 200, 800)
    assert tuple(counters.ranks(counter(spark, {}), "focal", a=0.5).first()) == (None,)


def test_runs(spark):
    def runs(xs, m=None):
        return [tuple(r) for r in ordered.runs(spark.createDataFrame([(x,) for x in xs], "h int"), "h", m).collect()]

    assert runs([1, 2, 3, 7, 8]) == [(1, 3), (7, 8)]
    assert runs([0, 1, 2, 3, 22, 23], 24) == [(22, 3)]
    assert runs([0, 5, 23], 24) == [(23, 0), (5, 5)]
    assert runs(range(24), 24) == [(0, 23)]
    assert runs([]) == []


def test_buckets_are_named_after_a_dominant_member(spark):
    got = ordered.focal_histogram(counter(spark, {23: 60})).first()
    assert (got["label"], got["bucket"]) == ("23mm", 24)
    got = ordered.focal_histogram(counter(spark, {23: 10, 23.5: 10, 24: 10, 24.5: 10, 25: 10})).first()
    assert got["label"] == "24mm"


def test_absences(spark):
    found = lambda t, total: {(r["value"], r["n"]) for r in ordered.absences(counter(spark, t), "focal", [14, 24, 35, 50, 200], F.lit(total)).collect()}
    assert found({24: 990, 35: 5, 70: 5}, 1000) == {(35.0, 5), (50.0, 0)}
    assert 35.0 not in {v for v, _ in found({24: 500, 34: 400, 70: 100}, 1000)}
    assert found({}, 10) == set()


def test_filters(spark):
    rows = [{"taken": None}, {"taken": datetime(2024, 1, 1)}, {"camera": None}, {"camera": "Nikon %_ Z"}, {"status": "no-exif"}, {"lens": "X"}]
    b = bronze(spark, rows)
    kept = lambda **o: photos(b, Options(**o)).count()
    assert kept() == 5
    assert kept(since=date(2024, 6, 21)) == 3 and kept(until=date(2024, 1, 1)) == 1
    assert kept(camera="nikon") == 1 and kept(camera="%_") == 1 and kept(lens="xf23") == 4
    row = counters.scan_counters(b, Options(since=date(2024, 6, 21))).first()
    assert (row["files_seen"], row["photos"], row["filtered_out"], row["no_exif"]) == (6, 3, 2, 1)


def test_zoom_verdicts(spark):
    def verdict(focals):
        rows = [{"lens": "Z", "lens_min": 24.0, "lens_max": 70.0, "focal": float(f)} for f in focals]
        return gear.zoom_usage(frames(spark, rows)).first()

    assert verdict([24, 25, 66, 70] * 25)["verdict"] == "shot at both ends"
    assert verdict([24, 25, 26, 40] * 25)["verdict"] == "lives at the wide end"
    assert verdict([66, 68, 70, 40] * 25)["verdict"] == "lives at the long end"
    assert verdict([24, 35, 45, 55, 70] * 20)["verdict"] == "uses the range"
    r = verdict([30, 32, 35, 40] * 10)
    assert (r["unused_long_declared"], r["unused_long_reached"], r["unused_wide_reached"]) == (70, 40, 30)
    assert verdict([24, 25, 66] * 25) is None


def test_declared_range_is_of_the_last_frame(spark):
    rows = [{"lens_min": 10.0, "lens_max": 20.0, "taken": datetime(2024, 1, 2)}, {"lens_min": 24.0, "lens_max": 70.0, "taken": datetime(2024, 1, 3)}, {"lens_min": 1.0, "lens_max": 2.0, "taken": None}, {"taken": datetime(2025, 1, 1)}]
    for order in (rows, rows[::-1]):
        r = gear.lenses(frames(spark, order)).first()
        assert (r["declared_low"], r["declared_high"], r["n"]) == (24, 70, 4)


def test_wide_open(spark):
    rows = [{"lens": "A", "fnumber": f} for f in [1.4] * 5 + [1.5] * 2 + [2.8] * 4] + [{"lens": "B", "fnumber": 2.0}] * 9
    r = gear.wide_open(frames(spark, rows)).first()
    assert (r["known"], r["wide"]) == (11, 7)
    assert gear.wide_open(frames(spark, [{}] * 3)).first()["share"] is None


def test_zero_values_are_no_values(spark):
    f = frames(spark, [{"focal": 0.0, "fnumber": 0.0, "exposure": 0.0, "iso": 0}] * 2 + [{}])
    for key in ("focal", "fnumber", "exposure", "iso"):
        assert [r["n"] for r in counters.counter(f, key).collect()] == [1]
    assert exposure.shutter_histogram(counters.counter(frames(spark, [{"exposure": 1e-9}, {}]), "exposure")).count() == 1


def test_iso_ceiling(spark):
    r = exposure.iso_ceiling(counter(spark, {400: 990, 25600: 10}, "iso", "int")).first()
    assert (r["highest"], r["ceiling"], r["above_ceiling"], r["base"]) == (25600, 400, 10, 400)


def test_reciprocal_uses_recorded_values(spark):
    rows = [{"focal": 50.0, "exposure": 1 / 40}, {"focal": 50.0, "exposure": 1 / 60}, {"focal": 20.0, "focal35": 60.0, "exposure": 1 / 50}, {"focal": 50.0, "focal35": 0.0, "exposure": 1 / 60}, {"focal": None, "exposure": 1.0}, {"exposure": None}]
    r = exposure.reciprocal(frames(spark, rows)).first()
    assert (r["known"], r["slow"]) == (4, 2)


def test_calendar_fills_gaps(spark):
    f = frames(spark, [{"taken": datetime(2020, 5, 1)}, {"taken": datetime(2020, 5, 1)}, {"taken": datetime(2023, 1, 1)}, {"taken": None}])
    days = calendar.days(f)
    assert [tuple(r) for r in calendar.years(days).collect()] == [(2020, 2, 1, 2), (2021, 0, 0, 0), (2022, 0, 0, 0), (2023, 1, 1, 1)]
    assert calendar.busiest_day(days).first()["day"] == date(2020, 5, 1)
    assert calendar.frames_per_day(days).first()[0] == 1
    s = calendar.span(f).first()
    assert (s["days"], s["active_days"], s["years"]) == (976, 2, [2020, 2023])
    none = calendar.days(frames(spark, [{"taken": None}]))
    assert calendar.years(none).count() == 0 and calendar.frames_per_day(none).first()[0] is None
    assert len(calendar.hours(frames(spark, [{"taken": None}])).collect()) == 24


def brute_clusters(points, radius):
    import itertools as it

    def km(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(x)))

    root = list(range(len(points)))
    for i, j in it.combinations(range(len(points)), 2):
        if km(points[i], points[j]) <= radius:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    return sorted(sorted(points[i] for i in range(len(points)) if root[i] == r) for r in set(root))


def test_clusters(spark):
    rows = [{"latitude": 51.50, "longitude": -0.12}] * 10 + [{"latitude": 51.51, "longitude": -0.13}] * 5 + [{"latitude": 48.0, "longitude": 2.0}]
    got = places.clusters(places.cells(frames(spark, rows))).collect()
    assert [(r["n"], r["cells"], r["days"]) for r in got] == [(15, 2, 1), (1, 1, 1)]
    rows = [{"latitude": 50.0, "longitude": 0.001}] * 9 + [{"latitude": 50.1, "longitude": 0.001}]
    got = places.clusters(places.cells(frames(spark, rows)), 50).first()
    assert abs(got["latitude"] - 50.01) < 1e-9


@pytest.mark.parametrize("radius", [5.0, 25.0, 400.0])
def test_exact_clusters_miss_nothing(spark, radius):
    """Far from Greenwich, at the antimeridian and near the poles."""
    random.seed(int(radius))
    points = set()
    for lat, lon in ((-33.8, 151.2), (65.0, 179.9), (65.0, -179.95), (89.2, 10.0), (89.2, -170.0), (-89.9, 90.0), (0.0, 0.0)):
        points |= {(round(max(-90, min(90, lat + random.uniform(-0.4, 0.4))), 2) + 0.0, round((lon + random.uniform(-0.4, 0.4) + 180) % 360 - 180, 2) + 0.0) for _ in range(25)}
    points = sorted(points)
    cells = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "id bigint, latitude double, longitude double")
    edges = {(r["u"], r["v"]) for r in places.links(cells, radius, exact=True).collect()}
    root = list(range(len(points)))
    for i, j in edges:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    assert sorted(sorted(points[i] for i in range(len(points)) if root[i] == r) for r in set(root)) == brute_clusters(points, radius)


def test_positions_are_rounded_before_anything_else(spark):
    f = frames(spark, [{"latitude": 51.507351, "longitude": -0.127758}])
    r = f.first()
    assert (r["latitude"], r["longitude"]) == (51.51, -0.13)
    off = frames(spark, [{"latitude": 51.507351, "longitude": -0.127758}], Options(gps="off")).first()
    assert off["latitude"] is None and off["longitude"] is None
    precise = frames(spark, [{"latitude": 51.507351, "longitude": -0.127758}], Options(gps="precise")).first()
    assert precise["latitude"] == 51.50735


def test_clock_offset(spark):
    at = lambda rows: places.clock_offset(frames(spark, rows), places.busiest_cell(places.cells(frames(spark, rows)))).first()
    sydney = {"latitude": -33.9, "longitude": 151.2, "tz_minutes": None}
    assert (at([sydney])["tz_minutes"], at([sydney])["basis"]) == (600, "estimated from longitude")
    assert at([sydney | {"longitude": -74.0}])["tz_minutes"] == -300
    assert at([sydney, sydney | {"tz_minutes": 660}])["tz_minutes"] == 660


def test_habits(spark):
    kinds = lambda rows: [r["rule"] for r in habits.habits(frames(spark, rows)).collect()]
    assert kinds([{}] * 60) == [1, 3, 8, 10]
    rows = [{"fnumber": 8.0, "exposure": 1 / 2000, "focal": 50.0, "flash": False, "taken": datetime(2024, 6, 22, i % 24)} for i in range(95)] + [{"fnumber": 1.4, "camera": "Other"}] * 5
    assert kinds(rows) == [2, 3, 4, 6, 8, 11, 12, 13]
    assert kinds([]) == []
    varied = [{"iso": 100 * (1 + i % 25), "exposure": 2.0, "taken": None} for i in range(100)]
    assert kinds(varied) == [1, 3, 5, 7, 9]


def test_results_do_not_depend_on_partitions(spark):
    random.seed(8)
    rows = [{"focal": random.choice([18.0, 23.0, 35.0, 55.0]), "lens": random.choice("AB"), "lens_min": 18.0, "lens_max": 55.0, "latitude": random.choice([10.0, 20.0]), "longitude": 5.0} for _ in range(300)]
    from shutterlake.plans.report import report

    b = bronze(spark, rows)
    assert report(b.repartition(1)) == report(b.repartition(7))


@pytest.mark.parametrize("exact", [False, True])
def test_dense_places_are_joined_as_by_all_pairs(spark, exact):
    """Thousands of cells in one town, a chain of cells out of it, and others far away and across the antimeridian."""

    rng = random.Random(5)
    at = [(51.0 + rng.random() / 3, 7.0 + rng.random() / 2) for _ in range(700)] + [(51.0, 7.6 + 0.2 * k) for k in range(8)] + [(-40 + rng.random(), 150 + rng.random()) for _ in range(60)] + [(10.0, 179.95), (10.0, -179.95), (10.05, 179.99)]
    cells = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(at)], "id bigint, latitude double, longitude double")
    want = {r["node"]: r["root"] for r in places.components(places.links(cells, 25.0, exact)).collect()}
    assert {r["node"]: r["root"] for r in places.joined(cells, 25.0, exact).collect()} == want


def test_histogram_of_a_counter(spark):
    counts = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(None, 5)], "k int, n bigint")
    got = [tuple(r) for r in counters.histogram(counts, F.when(F.col("k") < 9, F.floor(F.col("k") / 3))).collect()]
    assert got == [(0, 6, 6 / 45), (1, 15, 15 / 45), (2, 24, 24 / 45)]
