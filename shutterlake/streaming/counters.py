"""Counters over a stream of bronze rows that land as files.

All counters are sums, so the state of a stream is one row a distinct value and
needs no watermark.  Counts by hour of landing have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import counters
from ..operators.frames import Options, keyed, photos
from ..schema import BRONZE


def landed(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of bronze rows written (as Parquet) to a folder."""
    return spark.readStream.schema(BRONZE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def scan_totals(stream: DataFrame, o: Options = Options()) -> DataFrame:
    return counters.scan_counters(stream, o)


def value_counts(stream: DataFrame, key: str, o: Options = Options()) -> DataFrame:
    """n for each value of a key of ``frames.keyed``."""
    return counters.counter(keyed(photos(stream, o), o), key)


def frames_by_window(stream: DataFrame, width: str = "1 hour", late: str = "1 day", o: Options = Options()) -> DataFrame:
    """Photographs by window of the time they were taken; frames later than ``late`` behind are left out."""
    timed = photos(stream, o).filter("taken IS NOT NULL").select(F.col("taken").cast("timestamp").alias("at"), "camera")
    out = timed.withWatermark("at", late).groupBy(F.window("at", width), "camera").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "camera", "n")


def keep(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run a counter as a query into an in-memory table of that name, over what has landed."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
