"""A seeded synthetic library: bronze rows from row numbers alone, and image files from such rows.

Every value is a hash of the seed, the row number and the field's name, so any part
of the library can be made anywhere, in any order, and is the same each time.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BRONZE

SEED = 20_210_206
BODIES = [("Halden", "Halden M2"), ("Halden", "Halden M3 Pro"), ("Orrefors", "Orrefors OC-7")]
#: name, shortest and longest focal length, widest aperture, and the weight of the lens.
LENSES = [("Nocta 23mm F1.4", 23, 23, 1.4, 30), ("Nocta 35mm F2", 35, 35, 2.0, 20), ("Nocta 56mm F1.2", 56, 56, 1.2, 12), ("Vista 16-55mm F2.8", 16, 55, 2.8, 22), ("Vista 55-200mm F3.5-4.8", 55, 200, 3.5, 10), ("Vista 10-24mm F4", 10, 24, 4.0, 6)]
STOPS = [1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0]
#: Photographs span these days from the first of 2021.
DAYS = 1_900


def _part(name: str, seed: int) -> Column:
    """A number in [0, 1) for the row's field."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1 << 30)) / float(1 << 30)


def _choice(values: list, name: str, seed: int) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), F.floor(_part(name, seed) * len(values)).cast("int"))


def frames(spark: SparkSession, n: int, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """n bronze rows: bodies, primes and zooms in unequal use, more in mornings and evenings, few days a month."""
    lens = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.lit(w).alias("wide")) for a, lo, hi, w, k in LENSES for _ in range(k)))
    c = F.col
    base = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism)
    # Frames come in days of 40; a day's place is drawn, and its hours lie around two peaks.
    day = F.floor(F.pmod(F.xxhash64(F.lit(seed), F.lit("day"), F.floor(c("id") / 40)), F.lit(DAYS))).cast("int")
    hour = F.when(_part("peak", seed) < 0.4, 6 + _part("hour", seed) * 4).otherwise(14 + _part("hour", seed) * 7)
    rows = base.withColumn("l", F.get(lens, F.floor(_part("lens", seed) * sum(x[4] for x in LENSES)).cast("int")))
    stop = F.element_at(F.filter(F.array(*(F.lit(s) for s in STOPS)), lambda s: s >= c("l.wide")), 1)
    place = _part("focal", seed)
    rows = rows.select(
        "*",
        F.format_string("/synthetic/%05d/frame%09d.jpg", (c("id") / 1000).cast("int"), c("id")).alias("path"),
        F.lit("ok").alias("status"),
        F.lit(512).cast("bigint").alias("bytes_read"),
        F.lit("jpeg").alias("container"),
        F.lit(None).cast("string").alias("detail"),
        _choice([m for _, m in BODIES + BODIES[:1] * 3], "body", seed).alias("camera"),
        c("l.name").alias("lens"),
        c("l.low").alias("lens_min"),
        c("l.high").alias("lens_max"),
        # Zooms are used most at their ends.
        F.round(c("l.low") + (c("l.high") - c("l.low")) * (place * place * (3 - 2 * place)), 0).alias("focal"),
        F.greatest(F.when(_part("open", seed) < 0.5, stop).otherwise(_choice(STOPS[2:], "stop", seed)), c("l.wide")).alias("fnumber"),
        F.pow(F.lit(2.0), -F.floor(4 + _part("time", seed) * 8)).alias("exposure"),
        _choice([200, 200, 200, 400, 400, 800, 1600, 3200, 6400], "iso", seed).alias("iso"),
        F.make_timestamp_ntz(F.lit(2021), F.lit(1), F.lit(1), F.floor(hour).cast("int"), F.floor(_part("minute", seed) * 60).cast("int"), F.floor(_part("second", seed) * 60).cast("decimal(8,6)")).alias("at"),
        day.alias("days"),
    )
    rows = rows.withColumn("taken", c("at") + F.make_dt_interval(days=c("days"))).withColumn("focal35", c("focal") * 1.5).withColumn("flash", _part("flash", seed) < 0.02)
    none = {"tz_minutes": F.lit(60), "latitude": F.lit(None), "longitude": F.lit(None), "width": F.lit(6240), "height": F.lit(4160), "orientation": F.lit(1)}
    for name, value in none.items():
        rows = rows.withColumn(name, value)
    return rows.select(*(c(n).cast(t).alias(n) for n, t in (x.split(" ") for x in BRONZE.split(", "))))


def jpeg_header(row: dict) -> bytes:
    """A JPEG file with a row's values in its header and no picture."""
    rational = lambda x: struct.pack("<II", round(x * 1_000_000), 1_000_000) if x < 4_000 else struct.pack("<II", round(x), 1)
    text = lambda s: s.encode() + b"\0"
    camera = row["camera"] or ""
    maker = next((m for m, model in BODIES if model == camera), camera)
    image = [(0x010F, 2, text(maker)), (0x0110, 2, text(camera)), (0x0112, 3, struct.pack("<H", row["orientation"] or 1))]
    exif = [
        (0x829A, 5, rational(row["exposure"])),
        (0x829D, 5, rational(row["fnumber"])),
        (0x8827, 3, struct.pack("<H", row["iso"])),
        (0x9003, 2, text(f"{row['taken']:%Y:%m:%d %H:%M:%S}")),
        (0x9209, 3, struct.pack("<H", int(bool(row["flash"])))),
        (0x920A, 5, rational(row["focal"])),
        (0xA432, 5, rational(row["lens_min"]) + rational(row["lens_max"]) + rational(row["fnumber"]) * 2),
        (0xA434, 2, text(row["lens"] or "")),
    ]
    width = {2: 1, 3: 2, 4: 4, 5: 8}
    out = bytearray(b"II" + struct.pack("<HI", 42, 8))

    def directory(entries: list, more: int) -> None:
        place = len(out) + 2 + 12 * (len(entries) + more) + 4
        head, tail = bytearray(struct.pack("<H", len(entries) + more)), bytearray()
        for tag, kind, data in entries:
            field = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", place + len(tail))
            tail += data if len(data) > 4 else b""
            head += struct.pack("<HHI", tag, kind, len(data) // width[kind]) + field
        if more:
            head += struct.pack("<HHII", 0x8769, 4, 1, place + len(tail))
        out.extend(head + b"\0\0\0\0" + tail)

    directory(image, 1)
    directory(exif, 0)
    app1 = b"Exif\0\0" + bytes(out)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


def write_library(rows: DataFrame, folder: str) -> DataFrame:
    """Write an image file for each row under a folder that executors share; returns path and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, sizes = [], []
            for row in b.to_pylist():
                path, data = os.path.join(folder, row["path"].lstrip("/")), jpeg_header(row)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(data)
                done.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return rows.mapInArrow(run, "path string, size bigint")
