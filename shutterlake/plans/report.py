"""The report: one nested document of many small tables over one scan.

Every table collected here is bounded by a key's distinct values (dial settings,
gear, days, 40 places), not by the number of photographs.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calendar, counters, exposure, gear, habits, ordered, places
from ..operators.frames import Options, keyed, photos
from ..schema import MONTHS, NOTABLE_FOCALS, NOTABLE_FSTOPS, WEEKDAYS

#: Shares below which an hour or a weekday counts as unused, at least.
QUIET_HOUR, QUIET_DAY = 0.005, 0.02
#: Sections that are made at a time.
SECTIONS = 6


def absences(frames: DataFrame, key: str, series: Sequence[float], threshold: float) -> DataFrame:
    """Candidates of a series that hardly any of all photographs are near."""
    return ordered.absences(counters.counter(frames, key), key, series, F.lit(frames.count()), threshold)


def _value(v):
    if isinstance(v, datetime):
        return v.isoformat(sep=" ", timespec="seconds")
    return v.isoformat() if isinstance(v, date) else v


def rows(df: DataFrame, **names: str) -> list[dict]:
    """A small table as dictionaries; n becomes count."""
    names = {"n": "count"} | names
    return [{names.get(k, k): _value(v) for k, v in r.asDict().items()} for r in df.collect()]


def one(df: DataFrame, **names: str) -> dict | None:
    found = rows(df, **names)
    return found[0] if found else None


def _gear(frames: DataFrame) -> dict:
    return {"cameras": rows(gear.cameras(frames), camera="name"), "lenses": rows(gear.lenses(frames), lens="name"), "pairs": rows(gear.pairs(frames))}


def _zooms(frames: DataFrame) -> list[dict]:
    found = rows(gear.zoom_usage(frames))
    if not found:
        return []
    by_lens = counters.counter(frames.filter(F.col("lens").isin([z["lens"] for z in found])), "lens", "focal")
    own = rows(by_lens.groupBy("lens", scalars.snap_focal("focal").alias("bucket")).agg(F.sum("n").alias("n")).orderBy("lens", "bucket"))
    for z in found:
        for side in ("long", "wide"):
            declared, reached = z.pop(f"unused_{side}_declared"), z.pop(f"unused_{side}_reached")
            z[f"unused_{side}"] = None if declared is None else {"declared": declared, "reached": reached}
        z["histogram"] = [{"bucket": x["bucket"], "count": x["count"]} for x in own if x["lens"] == z["lens"]]
    return found


def _focal(frames: DataFrame) -> dict:
    counts = counters.counter(frames, "focal").persist()
    try:
        ends = one(counts.agg(F.sum("n").alias("n"), F.min("focal").alias("min"), F.max("focal").alias("max"), F.count(F.lit(1)).alias("distinct")))
        if not ends["count"]:
            return {"available": False}
        return {
            "available": True,
            **ends,
            **one(counters.ranks(counts, "focal", median=0.5, p10=0.1, p90=0.9)),
            "band": one(ordered.narrowest_band(counts, "focal")),
            "histogram": rows(ordered.focal_histogram(counts)),
            "top": rows(ordered.focal_top(counts)),
            "zooms": _zooms(frames),
            "thirty_five_available": bool(frames.filter("focal35 IS NOT NULL").take(1)),
        }
    finally:
        counts.unpersist()


def _aperture(frames: DataFrame) -> dict:
    counts = counters.counter(frames, "fnumber")
    span = one(exposure.span(counts, "fnumber"))
    if not span["count"]:
        return {"available": False}
    histogram = exposure.fstop_histogram(counts)
    wide = one(gear.wide_open(frames), wide="shots")
    return {"available": True, "count": span["count"], "median": span["median"], "widest": span["lowest"], "narrowest": span["highest"], "histogram": rows(histogram), "top": rows(exposure.value_top(histogram)), "wide_open": wide if wide["share"] is not None else None}


def _shutter(frames: DataFrame) -> dict:
    counts = counters.counter(frames, "exposure").filter("exposure > 0")
    span = one(exposure.span(counts, "exposure").select("n", *(scalars.format_shutter(a).alias(b) for a, b in (("lowest", "fastest"), ("highest", "slowest"), ("median", "median")))))
    if not span["count"]:
        return {"available": False}
    rule = one(exposure.reciprocal(frames))
    return {"available": True, **span, "histogram": rows(exposure.shutter_histogram(counts)), "top": rows(exposure.shutter_top(counts)), "reciprocal": rule if rule["known"] else None}


def _iso(frames: DataFrame) -> dict:
    counts = counters.counter(frames, "iso")
    found = one(exposure.iso_ceiling(counts), highest="max")
    if not found["count"]:
        return {"available": False}
    histogram = exposure.iso_histogram(counts)
    return {"available": True, **found, "histogram": rows(histogram), "top": rows(exposure.value_top(histogram))}


def _time(frames: DataFrame, cells: DataFrame | None, o: Options) -> dict:
    hours = rows(calendar.hours(frames))
    out = {"hours": hours, "weekdays": [{"day": WEEKDAYS[r["weekday"]], "count": r["count"]} for r in rows(calendar.weekdays(frames))], "months": [{"month": MONTHS[r["month"] - 1], "count": r["count"]} for r in rows(calendar.months(frames))]}
    window = None if cells is None else one(places.twilight_window(places.clock_offset(frames, places.busiest_cell(cells))))
    missing, polar = ("omitted" if o.gps == "off" else "no-coordinate") if window is None else None, None
    if window is not None:
        window["latitude"], window["longitude"] = (round(window[x], 1) + 0.0 for x in ("latitude", "longitude"))
        if not window["samples"]:
            window, missing, polar = None, "undefined", window["latitude"]
        else:
            light = frames.sparkSession.createDataFrame([(window["dawn_mean"], window["dusk_mean"])], "dawn_mean double, dusk_mean double")
            window |= one(places.golden_share(calendar.hours(frames), light))
    return out | {"twilight": window, "twilight_missing": missing, "twilight_latitude": polar}


def _calendar(frames: DataFrame) -> dict:
    counts = calendar.days(frames)
    by_day = {r["day"]: r["count"] for r in rows(counts.orderBy("day"))}  # bounded by the calendar
    if not by_day:
        return {"years": [], "busiest_day": None, "days_shot": 0}
    years = rows(calendar.years(counts), n="total", most="max")
    for y in years:
        y["days"] = {d: n for d, n in by_day.items() if d[:4] == f"{y['year']:04d}"}
    busiest = one(calendar.busiest_day(counts), day="date")
    return {"years": years, "days_shot": len(by_day), "busiest_day": busiest, "median_frames_per_active_day": one(calendar.frames_per_day(counts))["median_frames"]}


NOTES = {
    "off": "Places were left out (--no-gps).",
    "none": "No photograph has a GPS position.",
    "precise": "Positions have five decimal places, about a metre: this file says where the photographs were taken.",
    "round": "Positions are rounded to two decimal places, about a kilometre, before anything else is done with them.",
}


def _places(cells: DataFrame | None, photographs: int, o: Options) -> dict:
    if o.gps == "off":
        return {"mode": "off", "clusters": [], "photos": 0, "note": NOTES["off"]}
    placed = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not placed:
        return {"mode": o.gps, "clusters": [], "photos": 0, "note": NOTES["none"]}
    found = places.clusters(cells, o.cluster_km, o.exact_clusters)
    return {"mode": o.gps, "decimal_places": o.places, "photos": placed, "share": placed / (photographs or 1), "cluster_km": o.cluster_km, "clusters": rows(places.places(found, o.places)), "total_clusters": found.count(), "note": NOTES[o.gps]}


def _absences(frames: DataFrame, photographs: int, hours: list[dict], weekdays: list[dict], o: Options) -> dict:
    enough = photographs >= o.min_photos_for_absence
    gaps = lambda key, series: rows(absences(frames, key, series, o.absence_threshold)) if enough else []
    dated, spark = sum(h["count"] for h in hours), frames.sparkSession
    quiet = [h["hour"] for h in hours if dated and h["count"] / dated < max(o.absence_threshold, QUIET_HOUR)]
    runs = rows(ordered.runs(spark.createDataFrame([(h,) for h in quiet], "hour int"), "hour", 24)) if quiet else []
    return {
        "enough_data": enough,
        "threshold": o.absence_threshold,
        "focal_lengths": gaps("focal", NOTABLE_FOCALS),
        "apertures": gaps("fnumber", NOTABLE_FSTOPS),
        "hours": runs,
        "quiet_hours": quiet,
        "weekdays": [d["day"] for d in weekdays if dated and d["count"] / dated < QUIET_DAY],
        "unreached_focal_range": rows(gear.unreached(frames)),
    }


def report(bronze: DataFrame, o: Options = Options(), meta: dict | None = None) -> dict:
    """The report of bronze rows, as a dictionary of 14 sections."""
    scan = one(counters.scan_counters(bronze, o))
    formats = lambda status: {r["container"]: r["count"] for r in rows(counters.containers(bronze, status))}
    scan |= {"containers": formats("ok"), "unsupported_formats": formats("unsupported"), "no_exif_formats": formats("no-exif")}
    frames = keyed(photos(bronze, o), o).persist(StorageLevel.MEMORY_AND_DISK)
    cells = None if o.gps == "off" else places.cells(frames).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        span = one(calendar.span(frames))
        # The sections are many small jobs, which do not fill a machine one at a time.
        with ThreadPoolExecutor(SECTIONS) as pool:
            go = lambda f, *args: pool.submit(inheritable_thread_target(f), *args)
            parts = {
                "time_of_day": go(_time, frames, cells, o),
                "locations": go(_places, cells, scan["photos"], o),
                "habits": go(lambda: rows(habits.habits(frames).drop("rule"))),
                "focal": go(_focal, frames),
                "gear": go(_gear, frames),
                "aperture": go(_aperture, frames),
                "shutter": go(_shutter, frames),
                "iso": go(_iso, frames),
                "calendar": go(_calendar, frames),
            }
            time_of_day = parts["time_of_day"].result()
            absent = go(_absences, frames, scan["photos"], time_of_day["hours"], time_of_day["weekdays"], o)
            found = {name: part.result() for name, part in parts.items()} | {"absences": absent.result()}
        first = {"meta": dict(meta or {}), "scan": scan, "span": span}
        order = ["gear", "focal", "aperture", "shutter", "iso", "time_of_day", "calendar", "locations", "absences", "habits"]
        return first | {name: found[name] for name in order} | {"filters": {"since": _value(o.since), "until": _value(o.until), "camera": o.camera, "lens": o.lens, "gps": o.gps}}
    finally:
        frames.unpersist()
        if cells is not None:
            cells.unpersist()
