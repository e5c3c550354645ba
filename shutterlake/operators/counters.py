"""Counters: one shuffle of partial counts each, whatever the size of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import Options, accepted


def scan_counters(bronze: DataFrame, o: Options = Options()) -> DataFrame:
    """One row of counts over all files, before and after the filters."""
    ok = F.col("status") == "ok"
    use = ok & accepted(o)
    return bronze.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.count_if(use).alias("photos"),
        F.count_if(ok & ~accepted(o)).alias("filtered_out"),
        F.count_if(~F.col("status").isin("ok", "unsupported", "unreadable")).alias("no_exif"),
        F.count_if(F.col("status") == "unsupported").alias("unsupported"),
        F.count_if(F.col("status") == "unreadable").alias("unreadable"),
        F.coalesce(F.sum("bytes_read"), F.lit(0)).cast("bigint").alias("bytes_read"),
        F.count_if(use & F.col("taken").isNull()).alias("missing_timestamp"),
    )


def containers(bronze: DataFrame, status: str = "ok") -> DataFrame:
    """Files of a status by container, most first."""
    return counter(bronze.filter(F.col("status") == status), "container").orderBy(F.desc("n"), "container")


def counter(frames: DataFrame, *keys: str) -> DataFrame:
    """n for each value that is not null."""
    present = frames.dropna(subset=list(keys)) if keys else frames
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def regrouped(counts: DataFrame, key: Column, name: str) -> DataFrame:
    """A counter of a function of its key, from the counter alone."""
    return counts.groupBy(key.alias(name)).agg(F.sum("n").alias("n"))


def with_share(counts: DataFrame) -> DataFrame:
    """Adds each row's share of n (a counter is small: one row a distinct value)."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def spined(counts: DataFrame, key: str, spine: DataFrame) -> DataFrame:
    """Every value of ``spine`` with its n, 0 where there is none."""
    return spine.join(F.broadcast(counts), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nearest_rank(value: str, fraction: float) -> Column:
    """The smallest value with at least that share of values at or below it."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})")


def cumulative(counts: DataFrame, key: str) -> DataFrame:
    """A counter with its running sum and total; counters are one row a distinct value."""
    everything = Window.partitionBy()
    return counts.withColumn("running", F.sum("n").over(everything.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(everything))


def ranks(counts: DataFrame, key: str, **fractions: float) -> DataFrame:
    """One row of nearest-rank percentiles of a counter, from the counter alone."""
    run = cumulative(counts, key)
    return run.agg(*(F.min(F.when(F.col("running") >= F.col("total") * f, F.col(key))).alias(name) for name, f in fractions.items()))


def top(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest, smaller keys first on ties."""
    return with_share(counts).orderBy(F.desc("n"), key).limit(k)


def histogram(counts: DataFrame, bucket: Column) -> DataFrame:
    """bucket, n and share of a counter regrouped by ``bucket`` (of its key), in order; null buckets are left out."""
    return with_share(regrouped(counts, bucket, "bucket").filter("bucket IS NOT NULL")).orderBy("bucket")


def mode(counts: DataFrame, key: str) -> Column:
    """The key with the largest n, the smallest on ties, as an aggregate."""
    return F.max_by(key, F.struct(F.col("n"), -F.col(key)))

