"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session of this machine alone names no ``spark.checkpoint.dir`` (as in tests).
DEFAULT_SHARED = "/tmp/checkpoints/shutterlake"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none is given one, a cluster's must name it."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(DEFAULT_SHARED)
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


#: Tables of this process that nobody asked to keep, and the session that wrote them; their names in its catalog.
_TEMPORARY: dict[str, SparkSession] = {}
_NAMED: dict[str, SparkSession] = {}


def work_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/shutterlake-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives executors.

    It is there until ``clear`` or the end of the process.
    """
    spark = df.sparkSession
    path = temporary(spark, what)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def temporary(spark: SparkSession, what: str) -> str:
    """A work path that ``clear`` removes."""
    path = work_path(spark, what)
    _TEMPORARY[path] = spark
    return path


def clear() -> None:
    """Remove this process's temporary tables; what was read from them must have been used by now."""
    for path, spark in list(_TEMPORARY.items()):
        with contextlib.suppress(Exception):  # the session may have gone, and its folder with it
            remove(spark, path)
        _TEMPORARY.pop(path, None)
    for table, spark in list(_NAMED.items()):
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        _NAMED.pop(table, None)


def named(spark: SparkSession, table: str) -> str:
    """Have ``clear`` take the name ``table`` out of the catalog; the files of such a table stay."""
    _NAMED[table] = spark
    return table


atexit.register(clear)


def _placed(spark: SparkSession, path: str):
    """A path as the file system it belongs to knows it, and that file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _placed(spark, path)
    return system.exists(place)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it is not there."""
    place, system = _placed(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def absolute(spark: SparkSession, path: str) -> str:
    """The whole of a path, with its file system's scheme."""
    place, system = _placed(spark, path)
    return system.makeQualified(place).toString()


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file under another name, then rename it: it is there whole or not at all."""
    place, system = _placed(spark, path)
    new, _ = _placed(spark, f"{path}.{uuid.uuid4().hex}.new")
    stream = system.create(new, True)
    stream.write(bytearray(data))
    stream.close()
    if not system.rename(new, place):
        raise OSError(f"cannot rename {new.toString()} to {path}")


def get(spark: SparkSession, path: str) -> bytes:
    """The whole of a small file."""
    place, system = _placed(spark, path)
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through the file system it belongs to."""
    _TEMPORARY.pop(path, None)
    place, system = _placed(spark, path)
    system.delete(place, True)
