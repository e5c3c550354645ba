"""Filters, and the keys that every counter groups by."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_coord, round_exact, truthy
from ..schema import NO_BODY, NO_LENS


@dataclass(frozen=True)
class Options:
    """What a report is made of, and how places are treated.

    ``gps``: "round" (two decimal places), "precise" (five) or "off".
    """

    since: date | None = None
    until: date | None = None
    camera: str | None = None
    lens: str | None = None
    gps: str = "round"
    cluster_km: float = 25.0
    absence_threshold: float = 0.01
    min_photos_for_absence: int = 60
    exact_clusters: bool = False

    @property
    def places(self) -> int:
        return 5 if self.gps == "precise" else 2


def accepted(o: Options) -> Column:
    """The conjunction of the filters; a frame without the value a set filter asks for is out."""
    out = F.lit(True)
    day = F.to_date("taken")
    if o.since:
        out &= F.coalesce(day >= F.lit(o.since), F.lit(False))
    if o.until:
        out &= F.coalesce(day <= F.lit(o.until), F.lit(False))
    for column, text in (("camera", o.camera), ("lens", o.lens)):
        if text:
            out &= F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(text.lower()))
    return out


def photos(bronze: DataFrame, o: Options = Options()) -> DataFrame:
    """The accepted photographs."""
    return bronze.filter((F.col("status") == "ok") & accepted(o))


def _key(name: str, places: int) -> Column:
    return F.when(truthy(name), round_exact(name, places))


def keyed(frames: DataFrame, o: Options = Options()) -> DataFrame:
    """Photographs with their grouping keys; coordinates only as rounded, and not at all in "off"."""
    out = frames.select(
        "path",
        F.coalesce("camera", F.lit(NO_BODY)).alias("camera"),
        F.coalesce("lens", F.lit(NO_LENS)).alias("lens"),
        "lens_min",
        "lens_max",
        _key("focal", 1).alias("focal"),
        _key("focal35", 1).alias("focal35"),
        _key("fnumber", 2).alias("fnumber"),
        _key("exposure", 6).alias("exposure"),
        F.when(truthy("iso"), F.col("iso")).alias("iso"),
        "taken",
        F.to_date("taken").alias("day"),
        "tz_minutes",
        "flash",
        # The reciprocal rule compares values as recorded.
        F.when(truthy("exposure"), F.col("exposure") > 1.0 / F.coalesce(F.when(truthy("focal35"), F.col("focal35")), F.when(truthy("focal"), F.col("focal")))).alias("slow"),
        *((F.lit(None).cast("double").alias(c) if o.gps == "off" else F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), round_coord(c, o.places)).alias(c)) for c in ("latitude", "longitude")),
    )
    return out
