"""Bodies, lenses, pairs; how zooms are used; how often lenses are wide open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import END_PART, ZOOM_BASES, ZOOM_RATIO, ZOOM_VERDICTS
from .counters import nearest_rank


def _use() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("taken").alias("first"), F.max("taken").alias("last"), F.countDistinct("day").alias("days")]


def _shared(grouped: DataFrame) -> DataFrame:
    return grouped.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def cameras(frames: DataFrame) -> DataFrame:
    """camera, n, first, last, days, share; most used first."""
    return _shared(frames.groupBy("camera").agg(*_use())).orderBy(F.desc("n"), "camera")


def _told() -> Column:
    """Whether a frame has both ends of its lens's range."""
    return F.col("lens_min").isNotNull() & F.col("lens_max").isNotNull() & (F.col("lens_min") != 0) & (F.col("lens_max") != 0)


def _when() -> list[Column]:
    """What frames are ordered by: time, undated ones first, then path."""
    return [F.col("taken").isNotNull().alias("known"), F.col("taken"), F.col("path")]


def declared() -> tuple[Column, Column]:
    """A lens's declared range: that of its last frame by time (then path) that has both ends."""
    last = F.max_by(F.when(_told(), F.struct("lens_min", "lens_max")), F.when(_told(), F.struct(*_when())))
    return last["lens_min"].alias("declared_low"), last["lens_max"].alias("declared_high")


def lenses(frames: DataFrame) -> DataFrame:
    """As ``cameras``, with focal_low, focal_high, declared_low, declared_high, median_focal, widest_aperture."""
    low, high = declared()
    grouped = frames.groupBy("lens").agg(
        *_use(), F.min("focal").alias("focal_low"), F.max("focal").alias("focal_high"), low, high, nearest_rank("focal", 0.5).alias("median_focal"), F.min("fnumber").alias("widest_aperture")
    )
    return _shared(grouped).orderBy(F.desc("n"), "lens")


def pairs(frames: DataFrame, k: int = 12) -> DataFrame:
    """The k most used pairs of body and lens."""
    return _shared(frames.groupBy("camera", "lens").agg(F.count(F.lit(1)).alias("n"))).orderBy(F.desc("n"), "camera", "lens").limit(k)


def wide_open(frames: DataFrame, at_least: int = 10) -> DataFrame:
    """One row (known, wide, share) over lenses with that many frames and a known aperture; share is null if none.

    A frame is wide open within a third of a stop of its lens's widest aperture.
    """
    return wide_open_of(frames.groupBy("lens", "fnumber").agg(F.count(F.lit(1)).alias("n")), at_least)


def wide_open_of(counts: DataFrame, at_least: int = 10) -> DataFrame:
    """``wide_open`` from counts n by lens and fnumber (null too)."""
    own = Window.partitionBy("lens")
    held = counts.withColumn("frames", F.sum("n").over(own)).withColumn("widest", F.min("fnumber").over(own)).filter((F.col("frames") >= at_least) & F.col("fnumber").isNotNull())
    sums = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("known"), F.coalesce(F.sum(F.when(F.col("fnumber") <= F.col("widest") * 2 ** (1 / 6), F.col("n"))), F.lit(0)).alias("wide"))
    return sums.withColumn("share", F.try_divide(F.col("wide"), F.col("known")))


def zoom_usage(frames: DataFrame, at_least: int = 20, distinct: int = 4) -> DataFrame:
    """One row per zoom with enough frames: its range, where on it frames lie, a verdict, and what is not reached."""
    c = F.col
    # One pass over the frames; what follows reads the counts by lens and focal length.
    counts = frames.groupBy("lens", "focal").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(_told(), F.struct(*_when(), "lens_min", "lens_max"))).alias("last"))
    own = Window.partitionBy("lens")
    per_lens = counts.select("lens", "focal", "n", F.sum("n").over(own).alias("frames"), F.max("last").over(own).alias("last"), F.min("focal").over(own).alias("used_low"), F.max("focal").over(own).alias("used_high"), F.count("focal").over(own).alias("distinct"))
    per_lens = per_lens.filter(c("focal").isNotNull()).withColumns({"declared_low": c("last.lens_min"), "declared_high": c("last.lens_max")}).drop("last")
    per_lens = per_lens.filter((c("frames") >= at_least) & (c("distinct") >= distinct) & (c("used_high") / c("used_low") >= ZOOM_RATIO))
    told = F.coalesce(c("declared_high") / F.greatest(c("declared_low"), F.lit(1e-9)) >= ZOOM_RATIO, F.lit(False))
    per_lens = per_lens.select(
        "*",
        F.when(told, c("declared_low")).otherwise(c("used_low")).alias("low"),
        F.when(told, c("declared_high")).otherwise(c("used_high")).alias("high"),
        F.when(told, ZOOM_BASES["declared"]).otherwise(ZOOM_BASES["used"]).alias("basis"),
    )
    at = (F.log(F.least(F.greatest(c("focal"), c("low")), c("high"))) - F.log(c("low"))) / (F.log(c("high")) - F.log(c("low")))
    placed = per_lens.withColumn("at", at)
    part = lambda test: F.coalesce(F.sum(F.when(test, c("n"))), F.lit(0)) / F.sum("n")
    keys = ["lens", "frames", "low", "high", "basis", "declared_low", "declared_high", "used_low", "used_high"]
    out = placed.groupBy(*keys).agg(part(c("at") <= END_PART).alias("wide_end"), part((c("at") > END_PART) & (c("at") < 1 - END_PART)).alias("middle"), part((c("at") > END_PART) & (c("at") >= 1 - END_PART)).alias("long_end"))
    ends = (c("wide_end") + c("long_end") >= 0.65) & (c("wide_end") >= 0.2) & (c("long_end") >= 0.2)
    verdict = F.when(ends, ZOOM_VERDICTS["ends"]).when(c("wide_end") >= 0.6, ZOOM_VERDICTS["wide"]).when(c("long_end") >= 0.6, ZOOM_VERDICTS["long"]).otherwise(ZOOM_VERDICTS["all"])
    return out.select(
        "lens",
        c("frames").alias("n"),
        "low",
        "high",
        "basis",
        "wide_end",
        "middle",
        "long_end",
        verdict.alias("verdict"),
        F.when(c("used_high") < c("declared_high") * 0.85, c("declared_high")).alias("unused_long_declared"),
        F.when(c("used_high") < c("declared_high") * 0.85, c("used_high")).alias("unused_long_reached"),
        F.when(c("used_low") > c("declared_low") * 1.15, c("declared_low")).alias("unused_wide_declared"),
        F.when(c("used_low") > c("declared_low") * 1.15, c("used_low")).alias("unused_wide_reached"),
    ).orderBy(F.desc("n"), "lens")


def unreached(frames: DataFrame) -> DataFrame:
    """Lenses whose longest used focal length is short of 85 % of the declared."""
    low, high = declared()
    out = frames.groupBy("lens").agg(low, high, F.max("focal").alias("reached"))
    return out.filter(F.col("reached") < F.col("declared_high") * 0.85).select("lens", F.col("declared_high").alias("declared"), "reached").orderBy("lens")
