"""What several operators share: word classes and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import remove, work_path, written  # noqa: F401

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def whole_text(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once per row.

    A lambda variable is a barrier that expression collapsing cannot undo, so
    an expensive ``value`` is not repeated for each use in ``body``.
    """
    return F.transform(F.array(value), body)[0]


#: Groups that hold one in HOT of all rows or more are joined by broadcast: HOT groups at most.
HOT = 4096


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with their group's row of ``groups`` (both written tables; ``size`` is the group's number of rows).

    A group of a third of all rows is no task's burden: the few large groups are broadcast.
    """
    total = rows.count()
    hot, rest = (groups.filter(F.col(size) * HOT >= total), groups.filter(F.col(size) * HOT < total))
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(rest, key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
