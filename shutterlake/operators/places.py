"""Places: cells of rounded coordinates, single-link clusters of cells, twilight there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import civil_twilight, format_coordinate, haversine_km, in_golden, round_coord
from ..workspace import written
from .counters import counter, mode
from .graph import components


def cells(frames: DataFrame) -> DataFrame:
    """latitude, longitude (as rounded in ``frames``), n, first, last, days (a set)."""
    return frames.filter("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("n"), F.min("taken").alias("first"), F.max("taken").alias("last"), F.collect_set("day").alias("days"))


#: Cells beyond which most are joined square by square before pairs are compared.
MANY = 50_000


def links(numbered: DataFrame, radius_km: float, exact: bool = False) -> DataFrame:
    """Pairs (u, v) of cells (id, latitude, longitude) within the radius.

    If the cells have a root, the component that they are known to be of, pairs of one
    root are left out, and squares around which there is one root alone are not looked at.

    Cells meet by an equi-join on grid squares a radius wide, each with its eight
    neighbours.  The usual grid is sheared by the cosine of latitude and can miss
    pairs far from Greenwich, and across the antimeridian; ``exact`` uses bands of
    latitude with columns as wide as the band's widest radius, wrapped at 180 degrees.
    """
    step = max(radius_km / 111.0, 1e-6)
    c = F.col
    known = "root" in numbered.columns
    roots = ["root"] if known else []
    row = F.floor(c("latitude") / step)
    if exact:
        # A row's columns must hold a radius at the highest latitude of the row and its neighbours.
        def width(r):
            high = F.least(F.greatest(F.abs(r * step), F.abs((r + 1) * step)) + step, F.lit(89.9))
            return F.least(F.lit(360.0), step / F.cos(F.radians(high)))

        base = numbered.withColumn("row", row)
        here = base.withColumn("col", F.floor((c("longitude") + 180) / width(c("row")))).select(c("id").alias("u"), c("latitude").alias("lat"), c("longitude").alias("lon"), "row", "col", *roots)
        near = base.select("id", "latitude", "longitude", *roots, F.explode(F.array(*(c("row") + d for d in (-1, 0, 1)))).alias("row"))
        wrapped = F.explode(F.array(*(c("longitude") + s for s in (0, 360, -360)))).alias("at")
        near = near.select("id", "latitude", "longitude", *roots, "row", wrapped).withColumn("mid", F.floor((c("at") + 180) / width(c("row"))))
        near = near.select(c("id").alias("v"), c("latitude").alias("lat2"), c("longitude").alias("lon2"), *roots, "row", F.explode(F.array(*(c("mid") + d for d in (-1, 0, 1)))).alias("col"))
    else:
        base = numbered.withColumn("row", row).withColumn("col", F.floor(c("longitude") * F.cos(F.radians("latitude")) / step))
        here = base.select(c("id").alias("u"), c("latitude").alias("lat"), c("longitude").alias("lon"), "row", "col", *roots)
        around = F.explode(F.array(*(F.struct((c("row") + i).alias("row"), (c("col") + j).alias("col")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        near = base.select(c("id").alias("v"), c("latitude").alias("lat2"), c("longitude").alias("lon2"), *roots, around.alias("to")).select("v", "lat2", "lon2", *roots, "to.row", "to.col")
    if known:
        mixed = near.groupBy("row", "col").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("row", "col")
        here, near = here.join(mixed, ["row", "col"]), near.withColumnRenamed("root", "from")
        return here.join(near, ["row", "col"]).filter((c("root") < c("from")) & (haversine_km("lat", "lon", "lat2", "lon2") <= radius_km)).select("u", "v").distinct()
    return here.join(near, ["row", "col"]).filter((c("u") < c("v")) & (haversine_km("lat", "lon", "lat2", "lon2") <= radius_km)).select("u", "v").distinct()


def joined(numbered: DataFrame, radius_km: float, exact: bool = False) -> DataFrame:
    """Components (node, root) of cells that are linked, without comparing all cells of a dense place.

    Cells of a square a quarter of the radius wide are linked to its least one, and these
    with each other; what pairs are left are those of cells that this has not joined.
    """
    step = max(radius_km / 111.0, 1e-6) / 4
    c = F.col
    square = numbered.select("id", "latitude", "longitude", F.floor(c("latitude") / step).alias("r"), F.floor(c("longitude") * F.cos(F.radians("latitude")) / step).alias("q"))
    least = written(square.groupBy("r", "q").agg(F.min(F.struct("id", "latitude", "longitude")).alias("at")), "square-cells")
    star = square.join(least, ["r", "q"]).filter((c("id") > c("at.id")) & (haversine_km("latitude", "longitude", c("at.latitude"), c("at.longitude")) <= radius_km))
    first = written(star.select(c("at.id").alias("u"), c("id").alias("v")).union(links(least.select("at.*"), radius_km, exact)), "square-links")
    known = components(first).select(c("node"), "root")
    rooted = written(numbered.join(known, c("id") == c("node"), "left").select("id", "latitude", "longitude", F.coalesce("root", "id").alias("root")), "rooted-cells")
    return components(first.union(links(rooted, radius_km, exact)))


def clusters(cell_table: DataFrame, radius_km: float = 25.0, exact: bool = False) -> DataFrame:
    """latitude, longitude (weighted centre), n, cells, radius_km, first, last, days; most frames first."""
    numbered = written(cell_table.withColumn("id", F.monotonically_increasing_id()), "cells")
    placed, radius = numbered.select("id", "latitude", "longitude"), max(radius_km, 0.1)
    rooted = joined(placed, radius, exact) if numbered.count() > MANY else components(links(placed, radius, exact))
    held = numbered.join(rooted, numbered["id"] == rooted["node"], "left").withColumn("root", F.coalesce("root", "id"))
    centre = held.groupBy("root").agg(
        (F.sum(F.col("latitude").cast("decimal(12,5)") * F.col("n")).cast("double") / F.sum("n")).alias("c_lat"),
        (F.sum(F.col("longitude").cast("decimal(12,5)") * F.col("n")).cast("double") / F.sum("n")).alias("c_lon"),
        F.sum("n").alias("c_n"),
        F.count(F.lit(1)).alias("cells"),
        F.min("first").alias("c_first"),
        F.max("last").alias("c_last"),
    )
    days = held.select("root", F.explode("days").alias("day")).groupBy("root").agg(F.countDistinct("day").alias("n_days"))
    spread = held.join(centre, "root").groupBy("root", "c_lat", "c_lon", "c_n", "cells", "c_first", "c_last").agg(F.max(haversine_km("c_lat", "c_lon", "latitude", "longitude")).alias("radius_km"))
    out = spread.join(days, "root", "left")
    return out.select(F.col("c_lat").alias("latitude"), F.col("c_lon").alias("longitude"), F.col("c_n").alias("n"), "cells", "radius_km", F.col("c_first").alias("first"), F.col("c_last").alias("last"), F.coalesce("n_days", F.lit(0)).alias("days")).orderBy(F.desc("n"), "latitude", "longitude")


def places(cluster_table: DataFrame, decimals: int = 2, k: int = 40) -> DataFrame:
    """The k largest clusters as shown: rounded again, labelled, with their share."""
    total = cluster_table.agg(F.sum("n").alias("total"))  # one row
    lat, lon = round_coord("latitude", decimals), round_coord("longitude", decimals)
    shown = cluster_table.orderBy(F.desc("n"), "latitude", "longitude").limit(k)
    shown = shown.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))
    return shown.select(format_coordinate(lat, lon, decimals).alias("label"), lat.alias("latitude"), lon.alias("longitude"), "n", "share", "days", F.round("radius_km", 1).alias("radius_km"), "first", "last").orderBy(F.desc("n"), "latitude", "longitude")


def busiest_cell(cell_table: DataFrame) -> DataFrame:
    """One row: the cell with most frames, the southern and western on ties."""
    return cell_table.orderBy(F.desc("n"), "latitude", "longitude").limit(1).select("latitude", "longitude", "n")


def clock_offset(frames: DataFrame, busiest: DataFrame) -> DataFrame:
    """busiest's row with tz_minutes and basis: the commonest recorded offset, else by longitude."""
    offsets = counter(frames, "tz_minutes")
    modal = offsets.agg(mode(offsets, "tz_minutes").alias("modal"))
    out = busiest.join(F.broadcast(modal), how="left")
    told = F.col("modal").isNotNull()
    return out.select("latitude", "longitude", F.coalesce("modal", (F.rint(F.col("longitude") / 15) * 60).cast("int")).alias("tz_minutes"), F.when(told, "OffsetTime tag").otherwise("estimated from longitude").alias("basis"))


def golden_share(hours: DataFrame, window: DataFrame) -> DataFrame:
    """One row: golden_count, the frames of hours in the light around the window's mean dawn and dusk, and golden_share."""
    bright = in_golden("hour", "dawn_mean", "dusk_mean")
    out = hours.join(F.broadcast(window.select("dawn_mean", "dusk_mean")))
    return out.agg(F.coalesce(F.sum(F.when(bright, F.col("n"))), F.lit(0)).alias("golden_count"), F.sum("n").alias("n")).select("golden_count", F.coalesce(F.try_divide("golden_count", "n"), F.lit(0.0)).alias("golden_share"))


def twilight_window(at: DataFrame) -> DataFrame:
    """For each row of latitude, longitude, tz_minutes: dawn and dusk by the clock over the 21sts of a year.

    dawn_earliest, dawn_latest, dusk_earliest, dusk_latest, dawn_mean, dusk_mean,
    polar_samples, samples.  Where no day has a dawn the times are null.
    """
    keys = at.columns
    # 2024 is a leap year: every date of a year exists in it.
    day = F.dayofyear(F.make_date(F.lit(2024), F.col("month"), F.lit(21)))
    sampled = at.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("sun", civil_twilight("latitude", "longitude", day))
    local = lambda x: F.pmod(F.col(f"sun.{x}") + F.col("tz_minutes") / 60.0, F.lit(24.0))
    sampled = sampled.withColumn("dawn", local("dawn")).withColumn("dusk", local("dusk"))
    return sampled.groupBy(*keys).agg(
        *(f(x).alias(f"{x}_{name}") for x in ("dawn", "dusk") for f, name in ((F.min, "earliest"), (F.max, "latest"), (F.avg, "mean"))),
        F.count_if(F.col("sun").isNull()).alias("polar_samples"),
        F.count("sun").alias("samples"),
    )
