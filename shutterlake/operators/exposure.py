"""Aperture, shutter and sensitivity: histograms on standard stops, and what they tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_shutter, shutter_label, shutter_stop, snap_fstop, snap_iso, trim
from .counters import cumulative, ranks, regrouped, spined, with_share


def fstop_histogram(counts: DataFrame) -> DataFrame:
    """value, label, n, share over f-stops; from the counter of f-numbers."""
    out = with_share(regrouped(counts, snap_fstop("fnumber"), "value"))
    return out.select("value", F.concat(F.lit("f/"), trim("value")).alias("label"), "n", "share").orderBy("value")


def iso_histogram(counts: DataFrame) -> DataFrame:
    out = with_share(regrouped(counts, snap_iso("iso"), "value"))
    return out.select("value", F.col("value").cast("string").alias("label"), "n", "share").orderBy("value")


def shutter_histogram(counts: DataFrame) -> DataFrame:
    """stop, seconds, label, n, share for every whole stop from the fastest to the slowest."""
    stops = regrouped(counts.filter(F.col("exposure") > 0), shutter_stop("exposure"), "stop")
    spine = stops.agg(F.min("stop").alias("a"), F.max("stop").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("stop"))
    return with_share(spined(stops, "stop", spine)).select("stop", F.pow(F.lit(2.0), F.col("stop")).alias("seconds"), shutter_label("stop").alias("label"), "n", "share").orderBy("stop")


def shutter_top(counts: DataFrame, k: int = 6) -> DataFrame:
    return with_share(regrouped(counts, format_shutter("exposure"), "label")).orderBy(F.desc("n"), "label").limit(k)


def value_top(histogram: DataFrame, k: int = 6) -> DataFrame:
    return histogram.select("label", "n", "share", "value").orderBy(F.desc("n"), "value").limit(k).select("label", "n", "share")


def span(counts: DataFrame, key: str) -> DataFrame:
    """One row: n, lowest, highest, median of a counter."""
    run = cumulative(counts, key)
    return run.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min(key).alias("lowest"), F.max(key).alias("highest"), F.min(F.when(F.col("running") >= F.col("total") * 0.5, F.col(key))).alias("median"))


def iso_ceiling(counts: DataFrame) -> DataFrame:
    """One row: base, highest, median, p90, p95, ceiling (p99) and the frames above it."""
    r = ranks(counts, "iso", median=0.5, p90=0.9, p95=0.95, ceiling=0.99)
    ends = counts.agg(F.min("iso").alias("base"), F.max("iso").alias("highest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    above = counts.join(F.broadcast(r.select("ceiling")), F.col("iso") > F.col("ceiling")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("above_ceiling"))
    return ends.join(F.broadcast(r)).join(F.broadcast(above)).select("n", "base", "highest", "median", "p90", "p95", "ceiling", "above_ceiling")


def reciprocal(frames: DataFrame) -> DataFrame:
    """One row: frames with time and focal length, those slower than one over it, and the share."""
    out = frames.agg(F.count("slow").alias("known"), F.count_if("slow").alias("slow"))
    return out.withColumn("share", F.try_divide(F.col("slow"), F.col("known")))


def flash(frames: DataFrame) -> DataFrame:
    out = frames.agg(F.count("flash").alias("known"), F.count_if("flash").alias("fired"))
    return out.withColumn("share", F.try_divide(F.col("fired"), F.col("known")))
