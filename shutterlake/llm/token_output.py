"""Token-ID output (operator 5): training-order shards of fixed stride.

1. Each task writes its rows' tokens, an end id after each document, as one stream
   cut to sequences of a fixed length (the last is padded with the end id), to a
   table in the shared folder.  Sequences number 0 to N - 1 by task and place.
2. A keyed Feistel network over the least even number of bits that holds N, walked
   along its cycle until the result is below N, gives each sequence its global slot:
   a permutation of 0 to N - 1 that needs no state and can be inverted.
3. Slots are computed once, as the table is dealt into a few parts by ranges of slots.
   Each part's sequences go to tasks by ranges of shards, so a task has whole shards
   and all have about as many; they are sorted there and written at
   ``(slot - first) * stride`` bytes, so a reader finds slot k by arithmetic, reads on
   sequentially, and resumes after any slot.

A shard is written under another name and renamed when complete.  Its bytes depend on
its slots alone, so a task that runs again leaves a shard that is there as it is, and
what failed attempts have left is removed at the end.  ``out`` must hold no shards.

Defined results: a null or empty text is its end id alone; texts of any length go on
over sequences; repeated rows are written each; null doc_ids are kept as null in the
sequences' lists; an empty table gives no shard and no row; other columns are not
used.  Results depend on how the input is divided among tasks, as sequences do, but
not on which attempt of a task succeeds.
"""

from __future__ import annotations

import gc
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import remove, temporary, work_path
from .common import as_bytes, slices
from .token_ids import encoder, id_type, tokenizer_text

#: Tokens of a sequence; sequences of a shard at least, and shards at most.
LENGTH, PER_SHARD, SHARDS = 512, 4096, 65_536
#: Rounds of the Feistel network; parts in which the shards are written.
ROUNDS, PASSES = 6, 5
#: Tasks of which the first sequence numbers are broadcast (16 bytes each); with more, they are joined by a shuffle.
TASKS = 2_000_000
#: Partitions that a part's shards are dealt to, at most.
WRITERS = 4096


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of x and key moves every bit of the result."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def round_keys(key: int) -> list[int]:
    return [int(k) for k in np.random.SeedSequence(key).generate_state(ROUNDS, np.uint64)]


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slots of ``index`` under the keyed permutation of 0 to n - 1 (or the way back)."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ (_mix(left, k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix(right, k) & mask)
        return left << half | right

    out = once(np.asarray(index, np.uint64))
    while (beyond := out >= n).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """task, local, n_tokens, ids (binary of ``length`` numbers of the vocabulary's ``id_type``) and doc_ids of each sequence."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, local = encoder(held.value), TaskContext.get().partitionId(), 0
        rest, owners = np.empty(0, encode.dtype), []  # tokens without a sequence, and (doc_id, where its tokens end)

        def cut(stream: np.ndarray, ends: np.ndarray, ids: list, n: int, used: int) -> pa.RecordBatch:
            lists = []
            starts = np.concatenate([[0], ends[:-1]])
            for k in range(n):
                a, b = k * length, min((k + 1) * length, used)
                lists.append(ids[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")])
            rows = stream[: n * length].reshape(n, length)
            return pa.RecordBatch.from_arrays(
                [pa.array([task] * n, pa.int32()), pa.array(range(local, local + n), pa.int64()), pa.array([min(length, used - k * length) for k in range(n)], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                ["task", "local", "n_tokens", "ids", "doc_ids"],
            )

        for batch in slices(batches, "text"):
            parts, ids, lengths = [rest], [d for d, _ in owners], [n for _, n in owners]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                parts.append(np.append(encode.ids((text or b"").decode()), end_id).astype(encode.dtype))
                ids.append(doc_id)
                lengths.append(len(parts[-1]))
            stream, ends = np.concatenate(parts), np.cumsum(lengths)
            n = len(stream) // length
            if n:
                yield cut(stream, ends, ids, n, n * length)
                local += n
            rest = stream[n * length :]
            left = ends - n * length
            keep = left > 0
            lengths = np.minimum(left, np.array(lengths))[keep]
            owners = list(zip([d for d, k in zip(ids, keep) if k], lengths.tolist()))
        if len(rest):
            full = np.append(rest, np.full(length - len(rest), end_id, encode.dtype))
            yield cut(full, np.cumsum([n for _, n in owners]), [d for d, _ in owners], 1, len(rest))

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, "task int, local bigint, n_tokens int, ids binary, doc_ids array<bigint>")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def _settle(system, new: str, name: str) -> None:
    """Give a whole file its name; if another attempt has done so, its file is the same and stays."""
    from pyarrow import fs

    if system.get_file_info(name).type == fs.FileType.NotFound:
        try:
            system.move(new, name)
            return
        except OSError:
            if system.get_file_info(name).type == fs.FileType.NotFound:
                raise
    system.delete_file(new)


def _put(uri: str, name: str, data: bytes) -> None:
    """Write a file under another name, then rename it: it is there whole or not at all."""
    system, folder = _file_system(uri)
    system.create_dir(folder, recursive=True)
    new = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(new) as out:
        out.write(data)
    _settle(system, new, f"{folder}/{name}")


def _left(uri: str, begins: str) -> list[str]:
    """Files of a folder whose names begin with ``begins``."""
    from pyarrow import fs

    system, folder = _file_system(uri)
    return [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith(begins)]


def write_shards(docs: DataFrame, tokenizer_path: str, out: str | None = None, length: int = LENGTH, end_id: int = 50256, key: int = 20_240, per_shard: int = PER_SHARD, **columns) -> DataFrame:
    """Write the shards under ``out``; returns one row per sequence.

    Columns: slot, sequence, shard, byte_offset, n_tokens (without padding),
    ids_crc32 (of the sequence's bytes) and doc_ids.
    """
    spark = docs.sparkSession
    out = out or work_path(spark, "token-shards")
    if _left(out, "shard"):
        raise FileExistsError(f"{out} holds shards already")
    table, dealt = temporary(spark, "sequences"), temporary(spark, "placed-sequences")
    sequences(docs, tokenizer_path, length, end_id, **columns).write.option("compression", "zstd").parquet(table)
    rows = spark.read.schema("task int, local bigint, n_tokens int, ids binary, doc_ids array<bigint>").parquet(table)
    counts = rows.groupBy("task").count().orderBy("task").toArrow()
    ends = np.cumsum(counts["count"].to_numpy())
    n = int(ends[-1]) if len(ends) else 0
    per = max(per_shard, -(-n // SHARDS))
    shards = max(1, -(-n // per))
    stride = id_type(tokenizer_text(tokenizer_path)).itemsize * length
    plan = spark.createDataFrame(pa.table({"task": counts["task"], "first": pa.array(ends - counts["count"].to_numpy(), pa.int64())}))
    plan = F.broadcast(plan) if len(ends) <= TASKS else plan

    @F.pandas_udf("bigint")
    def slot_of(sequence: pd.Series) -> pd.Series:
        return pd.Series(permuted(sequence.to_numpy(), n, key))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(out)
        system.create_dir(folder, recursive=True)
        open_shard, stream, new = None, None, ""

        def done() -> None:
            if stream is not None:
                stream.close()
                _settle(system, new, f"{folder}/{shard_name(open_shard)}")

        for b in batches:
            crc, shard_of = [], b.column("shard").to_pylist()
            for shard, ids in zip(shard_of, as_bytes(b.column("ids"))):
                if shard != open_shard:
                    done()
                    open_shard, new = shard, f"{folder}/.{shard_name(shard)}.{uuid.uuid4().hex}"
                    stream = system.open_output_stream(new)
                stream.write(ids)
                crc.append(zlib.crc32(ids))
            slot = b.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("sequence"), b.column("shard"), pa.array((slot % per) * stride), b.column("n_tokens"), pa.array(crc, pa.int64()), b.column("doc_ids")], ["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids"])
        done()

    # A part of the shards at a time, so that no more than that part's shuffle is on disk beside the table.
    each = -(-shards // min(shards, PASSES))
    placed = rows.join(plan, "task").withColumn("sequence", F.col("first") + F.col("local")).withColumn("slot", slot_of("sequence"))
    placed = placed.select("slot", F.floor(F.col("slot") / per).alias("shard"), "sequence", "n_tokens", "ids", "doc_ids")
    placed.withColumn("part", F.floor(F.col("shard") / each).cast("int")).write.option("compression", "zstd").partitionBy("part").parquet(dealt)
    remove(spark, table)
    result = work_path(spark, "shard-index")
    schema = "slot bigint, sequence bigint, shard bigint, byte_offset bigint, n_tokens int, ids_crc32 bigint, doc_ids array<bigint>"
    spark.createDataFrame([], schema).write.parquet(result)
    for part in range(-(-shards // each) if n else 0):
        place = f"{dealt}/part={part}"
        own = spark.read.schema("slot bigint, shard bigint, sequence bigint, n_tokens int, ids binary, doc_ids array<bigint>").parquet(place)
        writers = min(each, WRITERS)
        ranged = own.repartitionById(writers, F.floor((F.col("shard") - part * each) * writers / each).cast("int"))
        ranged.sortWithinPartitions("slot").mapInArrow(write, schema).write.mode("append").parquet(result)
        remove(spark, place)
        del own, ranged
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets go of the part's shuffle files
    remove(spark, dealt)
    system, _ = _file_system(out)
    for path in _left(out, ".shard"):
        system.delete_file(path)
    _put(out, "shards.json", json.dumps({"sequences": n, "length": length, "per_shard": per, "stride": stride, "dtype": id_type(tokenizer_text(tokenizer_path)).str, "end_id": end_id, "key": key}).encode())
    return spark.read.schema(schema).parquet(result)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


class Reader:
    """Sequences in training order, from any slot on."""

    def __init__(self, uri: str):
        self.system, self.folder = _file_system(uri)
        with self.system.open_input_stream(f"{self.folder}/shards.json") as f:
            self.about = json.loads(f.read())

    def __len__(self) -> int:
        return self.about["sequences"]

    def read(self, start: int = 0) -> Iterator[np.ndarray]:
        per, stride = self.about["per_shard"], self.about["stride"]
        while start < len(self):
            with self.system.open_input_file(f"{self.folder}/{shard_name(start // per)}") as f:
                f.seek(start % per * stride)
                while data := f.read(stride):
                    yield np.frombuffer(data, self.about["dtype"])
                    start += 1


