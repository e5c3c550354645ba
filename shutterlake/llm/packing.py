"""Packing (operator 10): cost-balanced sequences with free cuts.

A piece of n tokens is taken to cost ``n + n * n / QUADRATIC``: linear work plus
attention within the piece.  Each task packs its own rows, ``WINDOW`` tokens at
a time, so nothing is shuffled and nothing but a window is held.  Within a window:

1. documents are cut to pieces of at most a sequence's length;
2. as many whole sequences are opened as the window's tokens fill;
3. pieces go, longest first, each to the lowest-cost sequence with room for all of
   it; where none has, it is cut: the lowest-cost sequence with any room takes what
   fits, and the rest goes on in the same way;
4. what remains is less than one sequence and is laid out in sequences whose lengths
   are powers of two, which need no padding.

So a window has no padding at all, and the sequences' costs are balanced.

Defined results: null text counts as empty; an empty document is its end id alone;
documents of any length are cut; repeated rows and repeated doc_ids are packed row
by row; null doc_ids are kept; an empty table gives no rows; further columns are
not passed on.  ``sequence_id`` is the task's number times 2^32 plus a running
number, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices
from .token_ids import encoder, tokenizer_text

#: Tokens of a sequence; a piece length at which attention costs as much as the rest.
SEQUENCE, QUADRATIC = 1024, 1024
#: Tokens that are packed together, at least (or all that a task has).
WINDOW = 1 << 21
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: list[int], sequence: int = SEQUENCE, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Rows (document, start, length, sequence, offset) that place every token once.

    ``sequence`` is a power of two.
    """
    whole, over = divmod(sum(lengths), sequence)
    room = np.array([sequence] * whole + powers(over), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, int(used[s])))
        used[s] += n
        room[s] -= n
        cost[s] += n + n * n / quadratic

    fresh, rest = 0, []
    for doc, n in enumerate(lengths):  # a piece as long as a sequence is first in descending order, and opens one
        for start in range(0, n - sequence + 1, sequence):
            put(doc, start, sequence, fresh)
            fresh += 1
        if n % sequence:
            rest.append((-(n % sequence), doc, n - n % sequence))
    room, used, cost = room[fresh:].copy(), used[fresh:].copy(), cost[fresh:].copy()
    at = len(out)
    for n, doc, start in sorted(rest):
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if fits[s] < np.inf:
            put(doc, start, n, s)
            continue
        while n:
            s = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(n, int(room[s]))
            put(doc, start, part, s)
            start, n = start + part, n - part
    return out[:at] + [(doc, start, n, s + fresh, offset) for doc, start, n, s, offset in out[at:]]


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, quadratic: float = QUADRATIC, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def packed(ids: list[np.ndarray], docs_at: list[int | None], base: int) -> tuple[pa.RecordBatch, int]:
        rows = pack([len(x) for x in ids], sequence, quadratic)
        crc = [zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes()) for d, start, n, _, _ in rows]
        d, start, n, s, offset = map(list, zip(*rows))
        columns = [[docs_at[i] for i in d], start, n, crc, [len(ids[i]) for i in d], [base + x for x in s], offset]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")]), max(s) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(held.value)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, at, tokens = [], [], 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                found = np.append(encode.ids((text or b"").decode()), end_id).astype(encode.dtype)
                ids.append(found)
                at.append(doc_id)
                tokens += len(found)
                if tokens >= window:
                    out, n = packed(ids, at, base)
                    yield out
                    base, ids, at, tokens = base + n, [], [], 0
        if ids:
            yield packed(ids, at, base)[0]

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SCHEMA)
