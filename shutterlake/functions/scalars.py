"""Scalar functions as Column expressions; all stay inside the JVM.

Rounding follows the binary value, ties to even, as decimal counters of camera
values expect: ``round_exact``.  Coordinates round half away from zero on their
decimal form, which is what the built-in does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CIVIL_ZENITH, EARTH_KM, SHUTTER_LABELS, STANDARD_FOCALS, STANDARD_FSTOPS, STANDARD_ISOS


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_exact(x: Column | str, places: int) -> Column:
    """Round to decimal places by the exact binary value, ties to even.

    The product with a power of ten is split into its double and the exact error of
    that double, which tells on which side of a tie the value really lies.
    """
    x, scale = col(x), float(10**places)
    product = x * scale
    high = (x * 134217729.0) - ((x * 134217729.0) - x)
    error = (high * scale - product) + (x - high) * scale
    tie = product - F.floor(product) == 0.5
    whole = F.when(tie & (error > 0), F.ceil(product)).when(tie & (error < 0), F.floor(product)).otherwise(F.rint(product))
    return F.when(F.abs(product) < 4503599627370496.0, whole.cast("double") / scale).otherwise(x)


def round_coord(x: Column | str, places: int) -> Column:
    """Half away from zero on the decimal form, and no negative zero."""
    return F.round(col(x), places) + F.lit(0.0)


def truthy(x: Column | str) -> Column:
    """Neither null nor zero."""
    return col(x).isNotNull() & (col(x) != 0)


def snap(x: Column | str, series: Sequence[float]) -> Column:
    """The entry nearest in logarithm, the smaller on ties."""
    choices = F.array(*(F.lit(float(c)) for c in series))
    return F.array_min(F.transform(choices, lambda c: F.struct(F.abs(F.log(col(x) / c)).alias("far"), c.alias("at"))))["at"]


def snap_focal(x: Column | str) -> Column:
    x = col(x)
    return F.when(x <= 0, 0.0).when(x < STANDARD_FOCALS[0], float(STANDARD_FOCALS[0])).when(x > STANDARD_FOCALS[-1], F.rint(x)).otherwise(snap(x, STANDARD_FOCALS))


def snap_fstop(x: Column | str) -> Column:
    x = col(x)
    return F.when(x <= 0, 0.0).when(x > STANDARD_FSTOPS[-1], STANDARD_FSTOPS[-1]).otherwise(snap(x, STANDARD_FSTOPS))


def snap_iso(x: Column | str) -> Column:
    x = col(x)
    return F.when(x <= 0, 0).when(x > STANDARD_ISOS[-1], x.cast("bigint")).otherwise(snap(x, STANDARD_ISOS).cast("bigint"))


def trim(x: Column | str) -> Column:
    """One decimal, without a trailing zero."""
    text = F.regexp_replace(F.format_string("%.1f", round_exact(x, 1)), r"\.0$", "")
    return F.when(text == "-0", "0").otherwise(text)


def whole(x: Column) -> Column:
    return F.format_string("%d", F.rint(x).cast("bigint"))


def format_shutter(x: Column | str) -> Column:
    """A shutter time as cameras show it."""
    x = col(x)
    under = F.try_divide(F.lit(1.0), x)
    return (
        F.when(x.isNull() | (x <= 0), "?")
        .when((x >= 1) & (F.abs(x - F.rint(x)) < 0.05), F.concat(whole(x), F.lit("s")))
        .when(x >= 1, F.concat(F.format_string("%.1f", round_exact(x, 1)), F.lit("s")))
        .when(under >= 1000, F.concat(F.lit("1/"), whole(F.rint(under / 100) * 100)))
        .when(under >= 100, F.concat(F.lit("1/"), whole(F.rint(under / 5) * 5)))
        .otherwise(F.concat(F.lit("1/"), whole(under)))
    )


def shutter_stop(x: Column | str) -> Column:
    """The whole stop of a time, as a power of two of seconds; null for times that are none."""
    return F.when(col(x) > 0, F.rint(F.log2(col(x))).cast("int"))


def shutter_label(stop: Column | str) -> Column:
    """The marking of a whole stop."""
    stop = col(stop)
    marks = F.create_map(*(F.lit(v) for kv in SHUTTER_LABELS.items() for v in kv))
    seconds = F.pow(F.lit(2.0), stop)
    return F.coalesce(F.try_element_at(marks, stop), F.when(stop < 0, format_shutter(seconds)).otherwise(F.concat(whole(seconds), F.lit("s"))))


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    part = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(part)))


def equation_of_time(day: Column | str) -> Column:
    """Minutes, from the day of the year (low-precision public formula; its coefficients are fixed values)."""
    g = _year_angle(day)
    return 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))


def declination(day: Column | str) -> Column:
    """Radians, from the day of the year (fixed values as above)."""
    g = _year_angle(day)
    return 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.001480 * F.sin(3 * g)


def _year_angle(day: Column | str) -> Column:
    return 2 * F.pi() / 365 * (col(day) - 1)


def civil_twilight(latitude: Column | str, longitude: Column | str, day: Column | str, zenith: float = CIVIL_ZENITH) -> Column:
    """Dawn and dusk in UTC hours (a struct; they may lie outside 0 to 24), or null if there is neither."""
    lat, lon, tilt = F.radians(col(latitude)), col(longitude), declination(day)
    across = F.cos(lat) * F.cos(tilt)
    cosine = F.try_divide(F.cos(F.radians(F.lit(zenith))) - F.sin(lat) * F.sin(tilt), across)
    angle = F.degrees(F.acos(cosine))
    hours = lambda side: (720 - 4 * (lon + side * angle) - equation_of_time(day)) / 60
    good = (F.abs(across) >= 1e-12) & cosine.between(-1.0, 1.0) & col(latitude).between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(good, F.struct(hours(1).alias("dawn"), hours(-1).alias("dusk")))


def format_coordinate(latitude: Column | str, longitude: Column | str, places: int) -> Column:
    def one(x: Column, plus: str, minus: str) -> Column:
        return F.concat(F.format_string(f"%.{places}f", F.abs(x)), F.when(x >= 0, f" {plus}").otherwise(f" {minus}"))

    return F.concat(one(col(latitude), "N", "S"), F.lit(", "), one(col(longitude), "E", "W"))


def iso_time(x: Column | str) -> Column:
    return F.date_format(col(x), "yyyy-MM-dd HH:mm:ss")


def in_golden(hour: Column | str, dawn: Column | str, dusk: Column | str) -> Column:
    """Whether an hour's start is within the light around dawn and dusk (no wrap at midnight)."""
    hour, dawn, dusk = col(hour), col(dawn), col(dusk)
    return ((hour >= dawn) & (hour < dawn + 1.5)) | ((hour >= dusk - 1) & (hour < dusk + 0.5))


def megapixels(width: Column | str = "width", height: Column | str = "height") -> Column:
    return col(width).cast("bigint") * col(height) / 1e6


def taken_utc(taken: Column | str = "taken", tz_minutes: Column | str = "tz_minutes") -> Column:
    return col(taken) - F.make_dt_interval(mins=F.coalesce(col(tz_minutes), F.lit(0)))
