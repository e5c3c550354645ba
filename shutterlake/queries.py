"""Named queries over the driver's tables, and the same in DuckDB's SQL.

Counts are bigint, and days and times text, in both.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import scalars
from .operators import calendar, counters, exposure, gear, habits, ordered, places
from .operators.frames import Options, keyed, photos
from .plans import report
from .sources.adapters import EVENT_FRAMES, ORDER_FRAMES, event_frames, order_frames

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Common parts of the SQL: frames, and photographs with their keys.
FRAMES_SQL = f"""f AS ({EVENT_FRAMES}), p AS (
  SELECT path, coalesce(camera, 'Unrecorded body') AS camera, coalesce(lens, 'Unrecorded lens') AS lens, lens_min, lens_max,
    round(nullif(focal, 0), 1) AS focal, round(nullif(focal35, 0), 1) AS focal35, round(nullif(fnumber, 0), 2) AS fnumber, round(nullif(exposure, 0), 6) AS exposure, nullif(iso, 0) AS iso,
    taken, cast(taken AS date) AS day, tz_minutes, flash,
    CASE WHEN exposure <> 0 THEN exposure > 1.0 / coalesce(nullif(focal35, 0), nullif(focal, 0)) END AS slow,
    cast(round(cast(latitude AS DECIMAL(12, 6)), 2) AS DOUBLE) + 0.0 AS latitude, cast(round(cast(longitude AS DECIMAL(12, 6)), 2) AS DOUBLE) + 0.0 AS longitude
  FROM f WHERE status = 'ok')"""
ORDERS_SQL = f"f AS ({ORDER_FRAMES}), p AS (SELECT *, cast(taken AS date) AS day FROM f)"


def _plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, days and times as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = scalars.iso_time(c)
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None, frames: str = "events") -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Register a function of photographs (or of bronze rows) as a query; ``sql`` follows the common parts."""

    def register(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bronze = event_frames(spark, sf_dir) if frames != "orders" else order_frames(spark, sf_dir)
            return _plain(f(bronze if frames == "bronze" else keyed(photos(bronze))))

        name = f.__name__
        _QUERIES[name] = run
        if sql:
            text = sql.strip()
            common = ORDERS_SQL if frames == "orders" else FRAMES_SQL
            _ORACLES[name] = f"WITH RECURSIVE {common}, {text[5:]}" if text.startswith("WITH ") else f"WITH {common} {text}"
        return run

    return register


def _stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def _snapped(key: str, series: list, name: str = "value") -> str:
    """CTEs cnt and snapped(value, n): a counter of ``key`` and the same on a series."""
    return f"""WITH cnt AS (SELECT {key} AS k, count(*) AS n FROM p WHERE {key} IS NOT NULL GROUP BY 1),
  near AS (SELECT k, n, c, row_number() OVER (PARTITION BY k ORDER BY abs(ln(k / c)), c) AS r FROM cnt, (SELECT unnest({[float(x) for x in series]}::DOUBLE[]) AS c)),
  snapped AS (SELECT k, c AS {name}, n FROM near WHERE r = 1)"""


# -- scan, filters -------------------------------------------------------------


@query(
    """SELECT count(*) AS files_seen, count(*) FILTER (status = 'ok') AS photos, cast(0 AS bigint) AS filtered_out, count(*) FILTER (status = 'no-exif') AS no_exif,
  count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'unreadable') AS unreadable, cast(sum(bytes_read) AS bigint) AS bytes_read,
  count(*) FILTER (status = 'ok' AND taken IS NULL) AS missing_timestamp FROM f""",
    "bronze",
)
def scan_counters(bronze):
    return counters.scan_counters(bronze)


@query("SELECT container, count(*) AS n FROM f WHERE status = 'ok' GROUP BY 1", "bronze")
def containers(bronze):
    return counters.containers(bronze)


@query("SELECT container, count(*) AS n FROM f WHERE status = 'unsupported' GROUP BY 1", "bronze")
def unsupported_formats(bronze):
    return counters.containers(bronze, "unsupported")


@query("SELECT container, count(*) AS n FROM f WHERE status = 'no-exif' GROUP BY 1", "bronze")
def no_exif_formats(bronze):
    return counters.containers(bronze, "no-exif")


def _filter_sql(test: str) -> str:
    return f"SELECT count(*) FILTER (status = 'ok' AND {test}) AS photos, count(*) FILTER (status = 'ok' AND NOT ({test})) AS filtered_out FROM f"


SINCE, UNTIL = date(2024, 1, 10), date(2024, 1, 20)


@query(_filter_sql("coalesce(cast(taken AS date) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20', false)"), "bronze")
def filter_since_until(bronze):
    return counters.scan_counters(bronze, Options(since=SINCE, until=UNTIL)).select("photos", "filtered_out")


@query(_filter_sql("contains(lower(coalesce(camera, '')), 'click')"), "bronze")
def filter_camera(bronze):
    return counters.scan_counters(bronze, Options(camera="Click")).select("photos", "filtered_out")


@query(_filter_sql("contains(lower(coalesce(lens, '')), 's 3')"), "bronze")
def filter_lens(bronze):
    return counters.scan_counters(bronze, Options(lens="S 3")).select("photos", "filtered_out")


@query("SELECT focal, count(*) AS n FROM p JOIN (SELECT path AS fp, camera AS raw, lens AS raw_lens FROM f) ON path = fp WHERE day >= DATE '2024-01-10' AND contains(lower(raw), 'view') AND contains(lower(raw_lens), 'lens') AND focal IS NOT NULL GROUP BY 1", "bronze")
def filtered_focal_counter(bronze):
    return counters.counter(keyed(photos(bronze, Options(since=SINCE, camera="view", lens="LENS"))), "focal")


# -- counters ------------------------------------------------------------------

for _name in ("focal", "focal35", "fnumber", "exposure", "iso", "tz_minutes"):

    def _count(frames, name=_name):
        return counters.counter(frames, name)

    _count.__name__ = f"{_name}_counter"
    query(f"SELECT {'cast(' + _name + ' AS bigint) AS ' + _name if _name in ('iso', 'tz_minutes') else _name}, count(*) AS n FROM p WHERE {_name} IS NOT NULL GROUP BY 1")(_count)


# -- gear ----------------------------------------------------------------------

_USE_SQL = f"count(*) AS n, {_stamp('min(taken)')} AS first, {_stamp('max(taken)')} AS last, count(DISTINCT day) AS days"


@query(f"SELECT camera, {_USE_SQL}, count(*) / (SELECT count(*) FROM p) AS share FROM p GROUP BY camera")
def gear_cameras(frames):
    return gear.cameras(frames)


_DECLARED = """last AS (SELECT lens AS l, lens_min AS declared_low, lens_max AS declared_high, row_number() OVER (PARTITION BY lens ORDER BY taken IS NOT NULL DESC, taken DESC, path DESC) AS r
  FROM p WHERE lens_min <> 0 AND lens_max <> 0)"""


@query(
    f"""WITH {_DECLARED},
  u AS (SELECT lens, {_USE_SQL}, min(focal) AS focal_low, max(focal) AS focal_high, cast(quantile_disc(focal, 0.5) AS double) AS median_focal, min(fnumber) AS widest_aperture FROM p GROUP BY lens)
SELECT u.*, declared_low, declared_high, n / (SELECT count(*) FROM p) AS share FROM u LEFT JOIN last ON l = lens AND r = 1"""
)
def gear_lenses(frames):
    return gear.lenses(frames)


@query("SELECT camera, lens, count(*) AS n, count(*) / (SELECT count(*) FROM p) AS share FROM p GROUP BY camera, lens ORDER BY n DESC, camera, lens LIMIT 12")
def gear_pairs(frames):
    return gear.pairs(frames)


@query(
    """WITH g AS (SELECT lens, count(*) AS frames, min(fnumber) AS widest FROM p GROUP BY lens HAVING count(*) >= 10)
SELECT count(fnumber) AS known, count(*) FILTER (fnumber <= widest * pow(2, 1.0 / 6)) AS wide, count(*) FILTER (fnumber <= widest * pow(2, 1.0 / 6)) / nullif(count(fnumber), 0) AS share FROM p JOIN g USING (lens)"""
)
def wide_open(frames):
    return gear.wide_open(frames)


@query(
    f"""WITH {_DECLARED},
  u AS (SELECT lens, count(*) AS n, min(focal) AS used_low, max(focal) AS used_high, count(DISTINCT focal) AS k FROM p GROUP BY lens),
  z AS (SELECT u.*, declared_low, declared_high, coalesce(declared_high / declared_low >= 1.15, false) AS told FROM u LEFT JOIN last ON l = lens AND r = 1 WHERE n >= 20 AND k >= 4 AND used_high / used_low >= 1.15),
  b AS (SELECT *, CASE WHEN told THEN declared_low ELSE used_low END AS low, CASE WHEN told THEN declared_high ELSE used_high END AS high FROM z),
  x AS (SELECT b.*, (ln(least(greatest(focal, low), high)) - ln(low)) / (ln(high) - ln(low)) AS pos FROM p JOIN b USING (lens) WHERE focal IS NOT NULL),
  s AS (SELECT lens, n, low, high, told, declared_low, declared_high, used_low, used_high, count(*) FILTER (pos <= 0.15) / count(*) AS wide_end, count(*) FILTER (pos > 0.15 AND pos < 0.85) / count(*) AS middle, count(*) FILTER (pos >= 0.85) / count(*) AS long_end FROM x GROUP BY ALL)
SELECT lens, n, low, high, CASE WHEN told THEN 'declared range' ELSE 'range you have used' END AS basis, wide_end, middle, long_end,
  CASE WHEN wide_end + long_end >= 0.65 AND wide_end >= 0.2 AND long_end >= 0.2 THEN 'shot at both ends' WHEN wide_end >= 0.6 THEN 'lives at the wide end' WHEN long_end >= 0.6 THEN 'lives at the long end' ELSE 'uses the range' END AS verdict,
  CASE WHEN used_high < declared_high * 0.85 THEN declared_high END AS unused_long_declared, CASE WHEN used_high < declared_high * 0.85 THEN used_high END AS unused_long_reached,
  CASE WHEN used_low > declared_low * 1.15 THEN declared_low END AS unused_wide_declared, CASE WHEN used_low > declared_low * 1.15 THEN used_low END AS unused_wide_reached FROM s"""
)
def zoom_usage(frames):
    return gear.zoom_usage(frames)


@query(f"WITH {_DECLARED} SELECT lens, declared_high AS declared, max(focal) AS reached FROM p JOIN last ON l = lens AND r = 1 GROUP BY lens, declared_high HAVING max(focal) < declared_high * 0.85")
def unreached_focal_range(frames):
    return gear.unreached(frames)


# -- focal lengths ---------------------------------------------------------------

_FOCAL_HIST = (
    _snapped("focal", schema.STANDARD_FOCALS, "bucket")
    + """, g AS (SELECT bucket, sum(n) AS n, max(n) AS most, arg_max(k, n * 100000 - k) AS modal FROM snapped GROUP BY bucket),
  h AS (SELECT bucket, CASE WHEN most / n >= 0.6 THEN modal ELSE bucket END AS value, cast(n AS bigint) AS n FROM g)"""
)


@query(_FOCAL_HIST + " SELECT value, bucket, regexp_replace(format('{:.1f}', value), '[.]0$', '') || 'mm' AS label, n, n / (SELECT sum(n) FROM h) AS share FROM h")
def focal_histogram(frames):
    return ordered.focal_histogram(counters.counter(frames, "focal"))


@query(_FOCAL_HIST + " SELECT value, n, n / (SELECT sum(n) FROM h) AS share FROM h ORDER BY n DESC, value LIMIT 8")
def focal_top(frames):
    return ordered.focal_top(counters.counter(frames, "focal"))


@query("SELECT cast(quantile_disc(focal, 0.5) AS double) AS median, cast(quantile_disc(focal, 0.1) AS double) AS p10, cast(quantile_disc(focal, 0.9) AS double) AS p90, min(focal) AS lowest, max(focal) AS highest, count(DISTINCT focal) AS distinct_values, count(focal) AS n FROM p")
def focal_percentiles(frames):
    counts = counters.counter(frames, "focal")
    ends = counts.agg(F.min("focal").alias("lowest"), F.max("focal").alias("highest"), F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("n"))
    return counters.ranks(counts, "focal", median=0.5, p10=0.1, p90=0.9).join(F.broadcast(ends))


_BAND = """WITH cnt AS (SELECT focal AS k, count(*) AS n FROM p WHERE focal IS NOT NULL GROUP BY 1), c AS (SELECT k, n, sum(n) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM cnt)
SELECT a.k AS low, b.k AS high, cast(b.cum - a.cum + a.n AS bigint) AS n, (b.cum - a.cum + a.n) / b.total AS share FROM c a JOIN c b ON a.k <= b.k AND b.cum - a.cum + a.n >= 0.5 * b.total ORDER BY b.k - a.k, b.k LIMIT 1"""


@query(_BAND)
def focal_band(frames):
    return ordered.narrowest_band(counters.counter(frames, "focal"), "focal")


@query(_BAND.replace("SELECT a.k", "SELECT (SELECT cast(quantile_disc(focal, 0.5) AS double) FROM p) AS median, (SELECT cast(quantile_disc(focal, 0.1) AS double) FROM p) AS p10, (SELECT cast(quantile_disc(focal, 0.9) AS double) FROM p) AS p90, a.k"))
def focal_summary(frames):
    counts = counters.counter(frames, "focal")
    return ordered.narrowest_band(counts, "focal").join(F.broadcast(counters.ranks(counts, "focal", median=0.5, p10=0.1, p90=0.9)))


# -- exposure --------------------------------------------------------------------


@query(_snapped("fnumber", schema.STANDARD_FSTOPS) + " SELECT value, 'f/' || regexp_replace(format('{:.1f}', value), '[.]0$', '') AS label, cast(sum(n) AS bigint) AS n, sum(n) / (SELECT sum(n) FROM snapped) AS share FROM snapped GROUP BY value")
def fstop_histogram(frames):
    return exposure.fstop_histogram(counters.counter(frames, "fnumber"))


@query(_snapped("iso", schema.STANDARD_ISOS) + " SELECT cast(value AS bigint) AS value, cast(cast(value AS bigint) AS varchar) AS label, cast(sum(n) AS bigint) AS n, sum(n) / (SELECT sum(n) FROM snapped) AS share FROM snapped GROUP BY value")
def iso_histogram(frames):
    return exposure.iso_histogram(counters.counter(frames, "iso"))


@query(_snapped("fnumber", schema.STANDARD_FSTOPS) + " SELECT 'f/' || regexp_replace(format('{:.1f}', value), '[.]0$', '') AS label, cast(sum(n) AS bigint) AS n, sum(n) / (SELECT sum(n) FROM snapped) AS share FROM snapped GROUP BY value ORDER BY sum(n) DESC, value LIMIT 6")
def fstop_top(frames):
    return exposure.value_top(exposure.fstop_histogram(counters.counter(frames, "fnumber")))


_STOPS = "CASE stop " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in schema.SHUTTER_LABELS.items()) + " ELSE cast(cast(pow(2, stop) AS bigint) AS varchar) || 's' END"


@query(
    f"""WITH b AS (SELECT cast(round_even(log2(exposure), 0) AS integer) AS stop, count(*) AS n FROM p WHERE exposure > 0 GROUP BY 1),
  s AS (SELECT unnest(generate_series((SELECT min(stop) FROM b), (SELECT max(stop) FROM b))) AS stop)
SELECT cast(stop AS bigint) AS stop, pow(2.0, stop) AS seconds, {_STOPS} AS label, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT sum(n) FROM b) AS share FROM s LEFT JOIN b USING (stop)"""
)
def shutter_histogram(frames):
    return exposure.shutter_histogram(counters.counter(frames, "exposure"))


_SHUTTER_TEXT = """CASE WHEN exposure >= 1 THEN cast(cast(exposure AS integer) AS varchar) || 's' WHEN 1 / exposure >= 1000 THEN '1/' || cast(cast(round_even(1 / exposure / 100, 0) * 100 AS integer) AS varchar)
  WHEN 1 / exposure >= 100 THEN '1/' || cast(cast(round_even(1 / exposure / 5, 0) * 5 AS integer) AS varchar) ELSE '1/' || cast(cast(round_even(1 / exposure, 0) AS integer) AS varchar) END"""


@query(f"WITH l AS (SELECT {_SHUTTER_TEXT} AS label, count(*) AS n FROM p WHERE exposure > 0 GROUP BY 1) SELECT label, n, n / (SELECT sum(n) FROM l) AS share FROM l ORDER BY n DESC, label LIMIT 6")
def shutter_top(frames):
    return exposure.shutter_top(counters.counter(frames, "exposure"))


@query("""WITH q AS (SELECT quantile_disc(iso, 0.99) AS ceiling FROM p)
SELECT count(iso) AS n, cast(min(iso) AS bigint) AS base, cast(max(iso) AS bigint) AS highest, cast(quantile_disc(iso, 0.5) AS bigint) AS median, cast(quantile_disc(iso, 0.9) AS bigint) AS p90, cast(quantile_disc(iso, 0.95) AS bigint) AS p95,
  cast((SELECT ceiling FROM q) AS bigint) AS ceiling, count(*) FILTER (iso > (SELECT ceiling FROM q)) AS above_ceiling FROM p""")
def iso_ceiling(frames):
    return exposure.iso_ceiling(counters.counter(frames, "iso"))


@query("SELECT count(exposure) AS n, min(exposure) AS lowest, max(exposure) AS highest, cast(quantile_disc(exposure, 0.5) AS double) AS median FROM p")
def shutter_span(frames):
    return exposure.span(counters.counter(frames, "exposure"), "exposure")


@query("SELECT count(slow) AS known, count(*) FILTER (slow) AS slow, count(*) FILTER (slow) / nullif(count(slow), 0) AS share FROM p")
def reciprocal(frames):
    return exposure.reciprocal(frames)


@query("SELECT count(flash) AS known, count(*) FILTER (flash) AS fired, count(*) FILTER (flash) / nullif(count(flash), 0) AS share FROM p")
def flash(frames):
    return exposure.flash(frames)


# -- time ------------------------------------------------------------------------


@query("WITH h AS (SELECT hour(taken) AS hour, count(*) AS n FROM p WHERE taken IS NOT NULL GROUP BY 1) SELECT s.hour, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT sum(n) FROM h) AS share FROM (SELECT unnest(range(24)) AS hour) s LEFT JOIN h USING (hour)")
def hours(frames):
    return calendar.hours(frames)


@query("WITH h AS (SELECT isodow(taken) - 1 AS weekday, count(*) AS n FROM p WHERE taken IS NOT NULL GROUP BY 1) SELECT s.weekday, coalesce(n, 0) AS n FROM (SELECT unnest(range(7)) AS weekday) s LEFT JOIN h USING (weekday)")
def weekdays(frames):
    return calendar.weekdays(frames)


_MONTHS_SQL = "WITH h AS (SELECT month(taken) AS month, count(*) AS n FROM p WHERE taken IS NOT NULL GROUP BY 1) SELECT s.month, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 13)) AS month) s LEFT JOIN h USING (month)"


@query(_MONTHS_SQL, "orders")
def months(frames):
    return calendar.months(frames)


@query(
    """WITH d AS (SELECT day, count(*) AS n FROM p WHERE day IS NOT NULL GROUP BY 1), y AS (SELECT year(day) AS year, sum(n) AS n, count(*) AS active_days, max(n) AS most FROM d GROUP BY 1)
SELECT s.year, cast(coalesce(n, 0) AS bigint) AS n, coalesce(active_days, 0) AS active_days, coalesce(most, 0) AS most FROM (SELECT unnest(generate_series((SELECT min(year) FROM y), (SELECT max(year) FROM y))) AS year) s LEFT JOIN y USING (year)""",
    "orders",
)
def calendar_years(frames):
    return calendar.years(calendar.days(frames))


@query(f"SELECT {_day('day')} AS day, count(*) AS n FROM p WHERE day IS NOT NULL GROUP BY day", "orders")
def calendar_days(frames):
    return calendar.days(frames)


@query(f"SELECT {_day('day')} AS day, count(*) AS n FROM p WHERE day IS NOT NULL GROUP BY p.day ORDER BY n DESC, p.day LIMIT 1", "orders")
def busiest_day(frames):
    return calendar.busiest_day(calendar.days(frames))


@query("WITH d AS (SELECT count(*) AS n FROM p WHERE day IS NOT NULL GROUP BY day) SELECT cast(quantile_disc(n, 0.5) AS bigint) AS median_frames FROM d", "orders")
def frames_per_day(frames):
    return calendar.frames_per_day(calendar.days(frames))


@query(f"SELECT {_stamp('min(taken)')} AS first, {_stamp('max(taken)')} AS last, cast(date_diff('day', min(day), max(day)) + 1 AS bigint) AS days, count(DISTINCT day) AS active_days, list_aggregate(list_sort(list(DISTINCT year(taken))), 'string_agg', ',') AS years FROM p", "orders")
def span(frames):
    return calendar.span(frames).withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


# -- places ------------------------------------------------------------------------

_CELLS = "WITH cells AS (SELECT latitude, longitude, count(*) AS n, min(taken) AS first, max(taken) AS last FROM p WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2)"
_KM = "2 * 6371 * asin(least(1, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"


@query(f"{_CELLS} SELECT latitude, longitude, n, {_stamp('first')} AS first, {_stamp('last')} AS last FROM cells")
def cells(frames):
    return places.cells(frames).drop("days")


_CLUSTERS = _CELLS + f""", i AS (SELECT row_number() OVER (ORDER BY latitude, longitude) AS id, *, floor(latitude / (25 / 111.0)) AS r, floor(longitude * cos(radians(latitude)) / (25 / 111.0)) AS c FROM cells),
  e AS (SELECT a.id AS u, b.id AS v FROM i a JOIN i b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND {_KM.format(a='a', b='b')} <= 25),
  t AS (SELECT id AS u, id AS v FROM i UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u),
  m AS (SELECT u AS id, min(v) AS root FROM t GROUP BY u),
  k AS (SELECT root, cast(sum(cast(latitude AS DECIMAL(12, 5)) * n) AS DOUBLE) / cast(sum(n) AS DOUBLE) AS latitude, cast(sum(cast(longitude AS DECIMAL(12, 5)) * n) AS DOUBLE) / cast(sum(n) AS DOUBLE) AS longitude, sum(n) AS n, count(*) AS cells, min(first) AS first, max(last) AS last FROM i JOIN m USING (id) GROUP BY root),
  d AS (SELECT m.root, count(DISTINCT day) AS days FROM p JOIN i ON p.latitude = i.latitude AND p.longitude = i.longitude JOIN m USING (id) GROUP BY m.root),
  w AS (SELECT k.root, max({_KM.format(a='k', b='i')}) AS km FROM k JOIN m USING (root) JOIN i USING (id) GROUP BY k.root)"""


@query(_CLUSTERS + " SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, cast(n AS bigint) AS n, cells, days, round(km, 6) AS radius_km FROM k JOIN d USING (root) JOIN w USING (root)")
def clusters(frames):
    out = places.clusters(places.cells(frames))
    return out.select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "n", "cells", "days", F.round("radius_km", 6).alias("radius_km"))


@query(
    _CLUSTERS
    + f""", s AS (SELECT *, cast(round(cast(latitude AS DECIMAL(12, 6)), 2) AS DOUBLE) + 0.0 AS lat, cast(round(cast(longitude AS DECIMAL(12, 6)), 2) AS DOUBLE) + 0.0 AS lon FROM k JOIN d USING (root) JOIN w USING (root))
SELECT format('{{:.2f}}', abs(lat)) || CASE WHEN lat >= 0 THEN ' N, ' ELSE ' S, ' END || format('{{:.2f}}', abs(lon)) || CASE WHEN lon >= 0 THEN ' E' ELSE ' W' END AS label, lat AS latitude, lon AS longitude,
  cast(n AS bigint) AS n, n / (SELECT sum(n) FROM s) AS share, days, round(km, 1) AS radius_km, {_stamp('first')} AS first, {_stamp('last')} AS last FROM s ORDER BY s.n DESC, s.latitude, s.longitude LIMIT 40"""
)
def places_shown(frames):
    return places.places(places.clusters(places.cells(frames)))


@query(f"{_CELLS} SELECT latitude, longitude, n FROM cells ORDER BY n DESC, latitude, longitude LIMIT 1")
def busiest_cell(frames):
    return places.busiest_cell(places.cells(frames))


_SUN = """g AS (SELECT *, 2 * pi() / 365 * (dayofyear(make_date(2024, month, 21)) - 1) AS g FROM a, (SELECT unnest(range(1, 13)) AS month)),
  s AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
    0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.001480 * sin(3 * g) AS decl FROM g),
  q AS (SELECT *, (cos(radians(96.0)) - sin(radians(latitude)) * sin(decl)) / nullif(cos(radians(latitude)) * cos(decl), 0) AS x FROM s),
  h AS (SELECT *, CASE WHEN x BETWEEN -1 AND 1 AND abs(cos(radians(latitude)) * cos(decl)) >= 1e-12 THEN degrees(acos(greatest(-1, least(1, x)))) END AS angle FROM q),
  u AS (SELECT *, (720 - 4 * (longitude + angle) - eq) / 60 + tz_minutes / 60.0 AS dawn, (720 - 4 * (longitude - angle) - eq) / 60 + tz_minutes / 60.0 AS dusk FROM h),
  v AS (SELECT *, dawn - 24 * floor(dawn / 24) AS lawn, dusk - 24 * floor(dusk / 24) AS lusk FROM u)
SELECT latitude, longitude, cast(tz_minutes AS bigint) AS tz_minutes, basis, round(min(lawn), 6) AS dawn_earliest, round(max(lawn), 6) AS dawn_latest, round(avg(lawn), 6) AS dawn_mean, round(min(lusk), 6) AS dusk_earliest, round(max(lusk), 6) AS dusk_latest, round(avg(lusk), 6) AS dusk_mean,
  count(*) FILTER (angle IS NULL) AS polar_samples, count(angle) AS samples FROM v GROUP BY latitude, longitude, tz_minutes, basis"""


def _light_sql(query: str) -> str:
    """``query`` over ``v``: local dawn (lawn) and dusk (lusk) of the busiest cell's sampled days."""
    days = _SUN.partition("\nSELECT latitude")[0]
    return f"""{_CELLS}, b AS (SELECT latitude, longitude FROM cells ORDER BY n DESC, latitude, longitude LIMIT 1),
  z AS (SELECT tz_minutes FROM p WHERE tz_minutes IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tz_minutes LIMIT 1),
  a AS (SELECT latitude, longitude, tz_minutes, 'OffsetTime tag' AS basis FROM b, z), {days} {query}"""


@query(
    _light_sql(
        """, l AS (SELECT avg(lawn) AS dawn, avg(lusk) AS dusk FROM v), taken_at AS (SELECT hour(taken) AS hour FROM p WHERE taken IS NOT NULL)
SELECT count(*) FILTER (hour >= dawn AND hour < dawn + 1.5 OR hour >= dusk - 1 AND hour < dusk + 0.5) AS golden_count, count(*) FILTER (hour >= dawn AND hour < dawn + 1.5 OR hour >= dusk - 1 AND hour < dusk + 0.5) / count(*) AS golden_share FROM taken_at, l"""
    )
)
def golden_share(frames):
    window = places.twilight_window(places.clock_offset(frames, places.busiest_cell(places.cells(frames))))
    return places.golden_share(calendar.hours(frames), window)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c.startswith(("dawn", "dusk")) else F.col(c) for c in df.columns))


@query(
    f"""{_CELLS}, b AS (SELECT latitude, longitude FROM cells ORDER BY n DESC, latitude, longitude LIMIT 1),
  z AS (SELECT tz_minutes FROM p WHERE tz_minutes IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tz_minutes LIMIT 1),
  a AS (SELECT latitude, longitude, tz_minutes, 'OffsetTime tag' AS basis FROM b, z), {_SUN}"""
)
def twilight_window(frames):
    return _rounded(places.twilight_window(places.clock_offset(frames, places.busiest_cell(places.cells(frames)))))


@query(f"{_CELLS}, a AS (SELECT latitude, longitude, cast(round_even(longitude / 15, 0) AS integer) * 60 AS tz_minutes, 'estimated from longitude' AS basis FROM cells), {_SUN}")
def twilight_everywhere(frames):
    at = places.cells(frames).select("latitude", "longitude", (F.rint(F.col("longitude") / 15) * 60).cast("int").alias("tz_minutes"), F.lit("estimated from longitude").alias("basis"))
    return _rounded(places.twilight_window(at))


# -- absences, habits ----------------------------------------------------------------


def _absence_sql(key: str, series: list) -> str:
    return f"""WITH cnt AS (SELECT {key} AS k, count(*) AS n FROM p WHERE {key} IS NOT NULL GROUP BY 1), pool AS (SELECT c FROM (SELECT unnest({[float(x) for x in series]}::DOUBLE[]) AS c) WHERE c BETWEEN (SELECT min(k) FROM cnt) AND (SELECT max(k) FROM cnt)),
  j AS (SELECT c AS value, cast(coalesce(sum(n), 0) AS bigint) AS n FROM pool LEFT JOIN cnt ON abs(ln(k / c)) < 0.055 GROUP BY c)
SELECT value, n, n / (SELECT count(*) FROM p) AS share FROM j WHERE n / (SELECT count(*) FROM p) < THRESHOLD"""


@query(_absence_sql("focal", schema.NOTABLE_FOCALS).replace("THRESHOLD", "0.05"))
def absences_focal(frames):
    return report.absences(frames, "focal", schema.NOTABLE_FOCALS, 0.05)


@query(_absence_sql("focal", schema.NOTABLE_FOCALS).replace("FROM p WHERE focal IS NOT NULL", "FROM p WHERE focal IS NOT NULL AND focal NOT BETWEEN 46 AND 54").replace("THRESHOLD", "0.01"))
def absences_at_the_default(frames):
    """A gap around one notable focal length, at the threshold that the report uses."""
    seen = frames.filter("focal IS NULL OR focal NOT BETWEEN 46 AND 54")
    return ordered.absences(counters.counter(seen, "focal"), "focal", schema.NOTABLE_FOCALS, F.lit(frames.count()), Options().absence_threshold)


@query(_absence_sql("fnumber", schema.NOTABLE_FSTOPS).replace("THRESHOLD", "0.12"))
def absences_aperture(frames):
    return report.absences(frames, "fnumber", schema.NOTABLE_FSTOPS, 0.12)


@query(
    """WITH h AS (SELECT s.hour, count(p.taken) AS n FROM (SELECT unnest(range(24)) AS hour) s LEFT JOIN p ON hour(p.taken) = s.hour GROUP BY 1),
  q AS (SELECT hour, hour - row_number() OVER (ORDER BY hour) AS island FROM h WHERE n / (SELECT sum(n) FROM h) < 0.0417),
  r AS (SELECT min(hour) AS start, max(hour) AS stop FROM q GROUP BY island),
  w AS (SELECT (SELECT count(*) FROM r) > 1 AND (SELECT min(start) FROM r) = 0 AND (SELECT max(stop) FROM r) = 23 AS wraps)
SELECT CASE WHEN wraps AND start = 0 THEN (SELECT start FROM r WHERE stop = 23) ELSE start END AS start, stop AS "end" FROM r, w WHERE NOT (wraps AND stop = 23)"""
)
def quiet_hours_runs(frames):
    return ordered.runs(calendar.hours(frames).filter("share < 0.0417"), "hour", 24)


_METRICS = (
    _snapped("fnumber", schema.STANDARD_FSTOPS, "stop")
    + """, st AS (SELECT stop, sum(n) AS n FROM snapped GROUP BY 1), io AS (SELECT iso, count(*) AS n FROM p WHERE iso IS NOT NULL GROUP BY 1), hr AS (SELECT hour(taken) AS hour, count(*) AS n FROM p WHERE taken IS NOT NULL GROUP BY 1),
  bd AS (SELECT camera, count(*) AS n FROM p GROUP BY 1), g AS (SELECT lens, min(fnumber) AS widest FROM p GROUP BY lens HAVING count(*) >= 10)
SELECT (SELECT count(*) FROM p) AS photos,
  (SELECT count(*) FILTER (fnumber <= widest * pow(2, 1.0 / 6)) / nullif(count(fnumber), 0) FROM p JOIN g USING (lens)) AS wide_share,
  (SELECT stop FROM st ORDER BY n DESC, stop LIMIT 1) AS stop, (SELECT max(n) / sum(n) FROM st) AS stop_share, (SELECT coalesce(sum(n) FILTER (stop BETWEEN 7 AND 11.5), 0) / sum(n) FROM st) AS mid_share,
  (SELECT count(slow) FROM p) AS reciprocal_known, (SELECT count(*) FILTER (slow) / count(slow) FROM p) AS slow_share,
  (SELECT count(*) FILTER (exposure <= 0.001) / count(exposure) FROM p) AS fast_share, (SELECT count(*) FILTER (exposure >= 1) FROM p) AS long_n, (SELECT count(*) FILTER (exposure >= 1) / count(exposure) FROM p) AS long_share,
  (SELECT cast(min(iso) AS bigint) FROM io) AS base, (SELECT arg_min(n, iso) / sum(n) FROM io) AS base_share, (SELECT count(*) FILTER (n > 2) FROM io) AS iso_values,
  (SELECT hour FROM hr ORDER BY n DESC, hour LIMIT 1) AS hour, (SELECT max(n) FROM hr) AS hour_n, (SELECT max(n) / sum(n) FROM hr) AS hour_share,
  (SELECT count(*) FILTER (isodow(taken) >= 6) / count(taken) FROM p) AS weekend_share,
  (SELECT count(flash) FROM p) AS flash_known, (SELECT count(*) FILTER (flash) FROM p) AS flash_fired, (SELECT count(*) FILTER (flash) / count(flash) FROM p) AS flash_share,
  (SELECT count(*) FROM bd) AS bodies, (SELECT camera FROM bd ORDER BY n DESC, camera LIMIT 1) AS body, (SELECT max(n) / sum(n) FROM bd) AS body_share"""
)


@query(_METRICS)
def habit_metrics(frames):
    return habits.metrics(frames)


def _habits_sql() -> str:
    """The rules as a union, over the one row of metrics."""
    percent = lambda x: f"cast(cast(round_even({x} * 100, 0) AS bigint) AS varchar) || ' percent"
    rules = [
        ("wide_share >= 0.5", "aperture", "'You shoot wide open'", percent("wide_share") + " of the frames on lenses of known maximum aperture are within a third of a stop of it.'"),
        ("wide_share <= 0.08", "aperture", "'The widest stops go unused'", percent("wide_share") + " of frames are near the widest aperture of their lens.'"),
        ("stop_share >= 0.3", "aperture", "'One stop above all: f/' || regexp_replace(format('{:.1f}', stop), '[.]0$', '')", percent("stop_share") + " of frames were taken at it.'"),
        ("mid_share >= 0.5", "aperture", "'Half of everything at f/8 to f/11'", percent("mid_share") + " of frames use these two stops.'"),
        ("reciprocal_known >= 40 AND slow_share >= 0.25", "shutter", "'Many times too long for the hand'", percent("slow_share") + " used a time longer than one over the focal length.'"),
        ("fast_share >= 0.35", "shutter", "'Mostly very short times'", percent("fast_share") + " of frames are at 1/1000 or faster.'"),
        ("long_n > 0 AND long_share >= 0.05", "shutter", "'Long exposures are a habit'", "cast(long_n AS varchar) || ' frames took a second or more, ' || " + percent("long_share") + " of all.'"),
        ("base_share >= 0.6", "iso", "'Sensitivity is left at its lowest'", percent("base_share") + " of frames are at ISO ' || cast(base AS varchar) || '.'"),
        ("iso_values >= 20 AND base_share < 0.2", "iso", "'Sensitivity floats freely'", "cast(iso_values AS varchar) || ' different values are in use, and none is a clear base.'"),
        ("photos >= 50 AND hour_share >= 0.2", "time", "'A favourite hour, with ' || " + percent("hour_share") + "'", "'The hour from ' || lpad(cast(hour AS varchar), 2, '0') || ':00 has ' || cast(hour_n AS varchar) || ' frames.'"),
        ("photos >= 50 AND weekend_share >= 0.6", "time", "'Weekends come first'", percent("weekend_share") + " of frames are of a Saturday or Sunday.'"),
        ("flash_known >= 40 AND flash_share <= 0.01", "light", "'Next to no flash'", "'It fired on ' || cast(flash_fired AS varchar) || ' of ' || cast(flash_known AS varchar) || ' frames that say.'"),
        ("bodies >= 2 AND body_share >= 0.85", "gear", "'A single body dominates'", "body || ' took ' || " + percent("body_share") + " of the library.'"),
    ]
    head, _, row = _METRICS.partition("\nSELECT (SELECT count(*) FROM p) AS photos")
    union = " UNION ALL ".join(f"SELECT {i} AS rule, '{kind}' AS kind, {title} AS title, {detail} AS detail FROM metrics WHERE {test}" for i, (test, kind, title, detail) in enumerate(rules, 1))
    return f"{head}, metrics AS (SELECT (SELECT count(*) FROM p) AS photos{row}), r AS ({union}) SELECT cast(rule AS bigint) AS rule, kind, title, detail FROM r"


@query(_habits_sql())
def habits_found(frames):
    return habits.habits(frames)



# -- scalar functions over columns of values ----------------------------------------------


@query(
    """WITH v AS (SELECT DISTINCT exposure FROM p WHERE exposure > 0) SELECT exposure, """
    + _SHUTTER_TEXT
    + """ AS text, cast(round_even(log2(exposure), 0) AS bigint) AS stop FROM v"""
)
def shutter_text(frames):
    values = frames.filter("exposure > 0").select("exposure").distinct()
    return values.select("exposure", scalars.format_shutter("exposure").alias("text"), scalars.shutter_stop("exposure").alias("stop"))


@query("SELECT path, focal, length(path) * 300 * cast(1000 + coalesce(iso, 0) AS bigint) / 1e6 AS width_mp, " + _stamp("taken - to_minutes(coalesce(tz_minutes, 0))") + " AS utc FROM p")
def derived_columns(frames):
    return frames.select("path", "focal", scalars.megapixels(F.length("path") * 300, 1000 + F.coalesce("iso", F.lit(0))).alias("width_mp"), scalars.iso_time(scalars.taken_utc()).alias("utc"))


# -- documents -----------------------------------------------------------------------------


def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report as one row of JSON."""
    import json

    text = json.dumps(report.report(event_frames(spark, sf_dir)), default=str)
    return spark.createDataFrame([(text,)], "report string")


def queries() -> dict[str, Query]:
    return {**_QUERIES, "report_document": report_document}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
