"""Statistics over a counter's order: bands, runs, named buckets, absences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_exact, snap_focal
from ..schema import DOMINANT
from .counters import cumulative


def narrowest_band(counts: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """The narrowest run of keys with that share of n: low, high, n, share; the lower on ties.

    For each high end the best low end is the last key before which too much would
    be cut off.  Both ends are found in the counter's running sums, so there is a
    range join of a counter with itself, by sorted sums: no pair of keys is made.
    """
    run = cumulative(counts, key).withColumn("need", F.col("total") * share).filter(F.col("n") > 0)
    # before(k): sum below k. A band (low, high) has running(high) - before(low).
    ends = run.select(F.col("running").alias("at"), F.lit(1).alias("kind"), F.col(key).alias("key"), F.col("running"), "need", "total")
    # A low end may serve all high ends with running >= before(low) + need: the greatest such key below is wanted.
    lows = run.select((F.col("running") - F.col("n") + F.col("need")).alias("at"), F.lit(0).alias("kind"), F.col(key).alias("key"), (F.col("running") - F.col("n")).alias("running"), "need", "total")
    walk = Window.orderBy("at", "kind", "key").rowsBetween(Window.unboundedPreceding, 0)
    low = F.max(F.when(F.col("kind") == 0, F.struct("key", "running"))).over(walk)
    both = ends.union(lows).withColumn("low", low).filter((F.col("kind") == 1) & F.col("low").isNotNull())
    out = both.select(F.col("low.key").alias("low"), F.col("key").alias("high"), (F.col("running") - F.col("low.running")).alias("n"), "total")
    return out.orderBy(F.col("high") - F.col("low"), "high").limit(1).select("low", "high", "n", (F.col("n") / F.col("total")).alias("share"))


def runs(values: DataFrame, key: str, modulus: int | None = None) -> DataFrame:
    """Runs of consecutive integers as (start, end); with a modulus the last may join the first."""
    w = Window.orderBy(key)
    islands = values.select(key).distinct().withColumn("island", F.col(key) - F.row_number().over(w))
    out = islands.groupBy("island").agg(F.min(key).alias("start"), F.max(key).alias("end")).select("start", "end")
    if modulus is None:
        return out.orderBy("start")
    everything = Window.partitionBy()
    out = out.select("*", F.min("start").over(everything).alias("least"), F.max("end").over(everything).alias("most"), F.max(F.when(F.col("end") == modulus - 1, F.col("start"))).over(everything).alias("last"), F.count(F.lit(1)).over(everything).alias("k"))
    wraps = (F.col("least") == 0) & (F.col("most") == modulus - 1) & (F.col("k") > 1)
    out = out.filter(~(wraps & (F.col("end") == modulus - 1)))
    joined = wraps & (F.col("start") == 0)
    return out.select(F.when(joined, F.col("last")).otherwise(F.col("start")).alias("start"), "end", joined.alias("wraps")).orderBy(F.desc("wraps"), "start").select("start", "end")


def named_buckets(counts: DataFrame, key: str, bucket: Column) -> DataFrame:
    """bucket, value, n: a bucket is named after the member with most of it, else after itself."""
    grouped = counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by(key, F.struct(F.col("n"), -F.col(key))).alias("modal"))
    return grouped.select("bucket", F.when(F.col("most") / F.col("n") >= DOMINANT, F.col("modal")).otherwise(F.col("bucket")).alias("value"), "n")


def focal_histogram(counts: DataFrame) -> DataFrame:
    """value, bucket, label, n, share in bucket order."""
    named = named_buckets(counts, "focal", snap_focal("focal")).withColumn("value", round_exact("value", 1))
    label = F.concat(F.regexp_replace(F.format_string("%.1f", F.col("value")), r"\.0$", ""), F.lit("mm"))
    return named.select("value", "bucket", label.alias("label"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share")).orderBy("bucket")


def focal_top(counts: DataFrame, k: int = 8) -> DataFrame:
    return focal_histogram(counts).select("value", "n", "share").orderBy(F.desc("n"), "value").limit(k)


def absences(counts: DataFrame, key: str, candidates: Sequence[float], total: Column, threshold: float = 0.01) -> DataFrame:
    """Candidates within the used range of which (or near which) hardly any frames are: value, n, share.

    ``total`` is the number of photographs that shares are of.
    """
    spark = counts.sparkSession
    found = counts.filter(F.col("n") > 0)
    span = found.agg(F.min(key).alias("low"), F.max(key).alias("high"))
    pool = spark.createDataFrame([(float(c),) for c in candidates], "value double").join(F.broadcast(span), F.col("value").between(F.col("low"), F.col("high")))
    near = found.filter(F.col(key) > 0)
    hit = F.broadcast(pool).join(near, F.abs(F.log(F.col(key) / F.col("value"))) < 0.055, "left")
    out = hit.groupBy("value").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("share", F.try_divide(F.col("n"), total))
    return out.filter(F.col("share") < threshold).orderBy("value")
