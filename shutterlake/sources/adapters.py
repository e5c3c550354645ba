"""Frames from tables: any table that can be projected to the bronze columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Frames made of the ``events`` table; the same text runs in ANSI SQL engines.
EVENT_FRAMES = """
SELECT concat('/lib/', cast(event_id AS string), '.jpg') AS path,
  CASE WHEN event_id % 97 = 0 THEN 'unsupported' WHEN event_id % 89 = 0 THEN 'no-exif'
       WHEN event_id % 83 = 0 THEN 'unreadable' ELSE 'ok' END AS status,
  cast(512 AS bigint) AS bytes_read,
  CASE event_id % 5 WHEN 0 THEN 'tiff' WHEN 1 THEN 'heif' WHEN 2 THEN 'png' ELSE 'jpeg' END AS container,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('BODY ', upper(event_type)) END AS camera,
  CASE WHEN user_id % 13 = 0 THEN NULL ELSE concat('LENS ', cast(user_id % 7 AS string)) END AS lens,
  cast(CASE WHEN user_id % 7 < 3 THEN 24 + 10 * (user_id % 7) END AS double) AS lens_min,
  cast(CASE WHEN user_id % 7 < 3 THEN 70 + 65 * (user_id % 7) END AS double) AS lens_max,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE
    cast(24 + 10 * (user_id % 7) + (event_id * 37 + user_id) % (11 + 8 * (user_id % 7)) AS double) END AS focal,
  CASE WHEN event_id % 29 = 0 THEN cast(36 + 15 * (user_id % 7) AS double) END AS focal35,
  CASE event_id % 9 WHEN 0 THEN cast(NULL AS double) WHEN 1 THEN cast(1.4 AS double) WHEN 2 THEN cast(2 AS double) WHEN 3 THEN cast(2.8 AS double)
    WHEN 4 THEN cast(4 AS double) WHEN 5 THEN cast(5.6 AS double) WHEN 6 THEN cast(8 AS double) WHEN 7 THEN cast(11 AS double) ELSE cast(1.79 AS double) END AS fnumber,
  CASE event_id % 8 WHEN 0 THEN cast(NULL AS double) WHEN 7 THEN cast(2 AS double) ELSE 1 / cast(15 * (1 + (event_id % 8) * (event_id % 8) * (event_id % 8)) AS double) END AS exposure,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE cast(100 * (1 + event_id % 7) * (1 + event_id % 3) AS int) END AS iso,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE ts END AS taken,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(60 * (user_id % 3) AS int) END AS tz_minutes,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(-60 + 25 * (user_id % 5) AS double) + cast(event_id % 41 - 20 AS double) / 1000 END AS latitude,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(-150 + 60 * (user_id % 5) AS double) + cast(event_id % 37 - 18 AS double) / 1000 END AS longitude,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 5 = 1 END AS flash
FROM events
"""

#: Frames of which only the time is known, made of ``orders``: they span years.
ORDER_FRAMES = """
SELECT concat('/orders/', cast(o_orderkey AS string), '.jpg') AS path, 'ok' AS status, cast(512 AS bigint) AS bytes_read, 'jpeg' AS container,
  concat('BODY ', o_orderstatus) AS camera, concat('LENS ', o_orderpriority) AS lens,
  cast(NULL AS double) AS lens_min, cast(NULL AS double) AS lens_max, cast(NULL AS double) AS focal, cast(NULL AS double) AS focal35,
  cast(NULL AS double) AS fnumber, cast(NULL AS double) AS exposure, cast(NULL AS int) AS iso,
  cast(o_orderdate AS timestamp) AS taken, cast(NULL AS int) AS tz_minutes, cast(NULL AS double) AS latitude, cast(NULL AS double) AS longitude, cast(NULL AS boolean) AS flash
FROM orders
"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_FRAMES.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ORDER_FRAMES.replace("FROM orders", "FROM {orders}").replace("cast(o_orderdate AS timestamp)", "cast(o_orderdate AS timestamp_ntz)")
    return spark.sql(text, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
