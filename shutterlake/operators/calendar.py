"""Hours, weekdays, months, days and years, with their gaps filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counters import counter, cumulative, spined


def hours(frames: DataFrame) -> DataFrame:
    """hour, n, share for each of 24 hours by the camera's clock."""
    counts = counter(frames.select(F.hour("taken").cast("int").alias("hour")), "hour")
    out = spined(counts, "hour", frames.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")))
    share = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy()))
    return out.select("hour", "n", F.coalesce(share, F.lit(0.0)).alias("share")).orderBy("hour")


def weekdays(frames: DataFrame) -> DataFrame:
    """weekday (0 is Monday), n."""
    counts = counter(frames.select(F.weekday("taken").cast("int").alias("weekday")), "weekday")
    return spined(counts, "weekday", frames.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))).orderBy("weekday")


def months(frames: DataFrame) -> DataFrame:
    counts = counter(frames.select(F.month("taken").cast("int").alias("month")), "month")
    return spined(counts, "month", frames.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))).orderBy("month")


def days(frames: DataFrame) -> DataFrame:
    return counter(frames, "day")


def years(day_counts: DataFrame) -> DataFrame:
    """year, n, active_days, most for every year from the first to the last, empty ones too."""
    by_year = day_counts.groupBy(F.year("day").alias("year")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("active_days"), F.max("n").alias("most"))
    spine = by_year.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    out = spine.join(F.broadcast(by_year), "year", "left")
    return out.select("year", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "active_days", "most"))).orderBy("year")


def busiest_day(day_counts: DataFrame) -> DataFrame:
    """One row: the day with most frames, the earliest on ties; none if there is no day."""
    return day_counts.orderBy(F.desc("n"), "day").limit(1)


def frames_per_day(day_counts: DataFrame) -> DataFrame:
    """One row: the median number of frames on a day with any."""
    sizes = day_counts.groupBy(F.col("n").alias("frames")).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(sizes, "frames").agg(F.min(F.when(F.col("running") >= F.col("total") * 0.5, F.col("frames"))).alias("median_frames"))


def span(frames: DataFrame) -> DataFrame:
    """One row: first and last time, days between them (both counted), active days, years."""
    return frames.agg(
        F.min("taken").alias("first"),
        F.max("taken").alias("last"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"),
        F.countDistinct("day").alias("active_days"),
        F.array_sort(F.collect_set(F.year("taken"))).alias("years"),
    )


def offsets(frames: DataFrame) -> DataFrame:
    """tz_minutes, n; undated frames count too."""
    return counter(frames, "tz_minutes")
