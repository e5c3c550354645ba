"""The bronze schema (one row per file) and the fixed series that values snap to."""

from __future__ import annotations

#: One row per file; photograph fields are null unless status is ok.
BRONZE = (
    "path string, status string, bytes_read bigint, container string, detail string, camera string, lens string, "
    "lens_min double, lens_max double, focal double, focal35 double, fnumber double, exposure double, iso int, "
    "taken timestamp_ntz, tz_minutes int, latitude double, longitude double, width int, height int, flash boolean, orientation int"
)
STATUSES = ("ok", "no-exif", "unsupported", "unreadable")

# The markings of lenses and dials, and what gaps are looked for.
STANDARD_FOCALS = [8, 10, 12, 14, 16, 18, 20, 21, 24, 28, 30, 35, 40, 45, 50, 55, 60, 70, 75, 85, 90, 100, 105, 120, 135, 150, 180, 200, 240, 300, 400, 500, 600, 800]
NOTABLE_FOCALS = [14, 16, 20, 24, 28, 35, 50, 85, 105, 135, 200, 300, 400]
STANDARD_FSTOPS = [1.0, 1.1, 1.2, 1.4, 1.6, 1.8, 2.0, 2.2, 2.5, 2.8, 3.2, 3.5, 4.0, 4.5, 5.0, 5.6, 6.3, 7.1, 8.0, 9.0, 10.0, 11.0, 13.0, 14.0, 16.0, 18.0, 20.0, 22.0, 25.0, 29.0, 32.0]
NOTABLE_FSTOPS = [1.4, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0, 16.0, 22.0]
STANDARD_ISOS = [50, 64, 80, 100, 125, 160, 200, 250, 320, 400, 500, 640, 800, 1000, 1250, 1600, 2000, 2500, 3200, 4000, 5000, 6400, 8000, 10000, 12800, 16000, 20000, 25600, 32000, 40000, 51200, 64000, 80000, 102400, 128000, 204800, 409600]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SHUTTER_LABELS = {-15: "1/32000", -14: "1/16000", -13: "1/8000", -12: "1/4000", -11: "1/2000", -10: "1/1000", -9: "1/500", -8: "1/250", -7: "1/125", -6: "1/60", -5: "1/30", -4: "1/15", -3: "1/8", -2: "1/4", -1: "1/2"}
#: What a report calls the use and the range of a zoom.
ZOOM_VERDICTS = {"ends": "shot at both ends", "wide": "lives at the wide end", "long": "lives at the long end", "all": "uses the range"}
ZOOM_BASES = {"declared": "declared range", "used": "range you have used"}
NO_BODY, NO_LENS = "Unrecorded body", "Unrecorded lens"
#: A zoom has this ratio of its ends or more; this part of its range (in logarithms) is an end.
ZOOM_RATIO, END_PART = 1.15, 0.15
#: A bucket is named after a member with this share of it or more.
DOMINANT = 0.6
EARTH_KM, CIVIL_ZENITH = 6371.0, 96.0
