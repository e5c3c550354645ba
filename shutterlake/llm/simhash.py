"""SimHash near-dedup (operator 8): tiled exact comparison of fingerprints.

Fingerprints are made in Python workers from whole texts.  Distinct fingerprints
are then sorted into tiles by the bit counts of their two halves; two fingerprints
within the radius have counts that differ by no more in sum, so pairs of tiles whose
counts are farther apart are never compared.  A remaining pair of tiles is one task's
row: numpy takes the exclusive or of all pairs, block by block, and counts bits.  The
comparison is exact.  Of the links found in a pair of tiles only a spanning forest is
handed on, so a group of thousands of near copies yields thousands of links, not
millions.  Components come from distributed star contraction.

Only tile sizes (at most 33 * 33 rows) reach the driver, never fingerprints or links.

Defined results: a null or wordless text has fingerprint zero, linked like any other;
a text with fewer words than a shingle has one shingle, its whole word sequence;
repeated rows give repeated results; rows with a null doc_id take part in linking, and
a component of null doc_ids only has component_id null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, joined_to_groups, slices, written
from ..operators.graph import components

#: Words of a shingle and the seed of XXH64; bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a tile, about (large, so that a pair's transport is little beside its comparisons); rows and columns that are compared at a time.
TILE, ROWS, COLUMNS = 1 << 16, 128, 4096
#: Shingles whose bits are unpacked at a time.
PART = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text's UTF-8."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes both touch ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    k = min(shingle, len(words))
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, len(words) - k + 1)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PART):
        part = hashes[i : i + PART].astype("<u8")
        bits += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (a hash of doc_id and text) and fp, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t or b"", shingle, seed) for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found)], ["doc_id", "key", "fp"])

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, key bigint, fp bigint")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one, if they are the same)."""
    nodes = np.concatenate([a, b])
    root = np.arange(len(nodes))
    if len(a) == len(b) and (a == b).all():
        root[len(a) :] = root[: len(a)]  # one tile with itself

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    u, v = [], []
    for start, first in ((i, j) for i in range(0, len(a), ROWS) for j in range(0, len(b), COLUMNS)):
        near = np.bitwise_count(a[start : start + ROWS, None] ^ b[None, first : first + COLUMNS]) <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            js = np.flatnonzero(near[i]) + len(a) + first
            mine = find(start + i)
            for j in js[root[js] != mine].tolist():
                other = find(j)
                if other != mine:
                    root[other] = mine
                    u.append(nodes[start + i])
                    v.append(nodes[j])
                root[j] = mine
    return np.array(u, np.uint64), np.array(v, np.uint64)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect all fingerprints of ``distinct`` (fp) within the radius."""
    spark = distinct.sparkSession
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    counted = distinct.withColumn("lo", half(0)).withColumn("hi", half(32))
    sizes = {(r["lo"], r["hi"]): r["n"] for r in counted.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts, first, total = {}, {}, 0
    for key in sorted(sizes):
        first[key], parts[key] = total, -(-sizes[key] // tile)
        total += parts[key]
    plan = F.broadcast(spark.createDataFrame([(*k, first[k], parts[k]) for k in sorted(sizes)], "lo int, hi int, first int, parts int"))
    tiles = counted.join(plan, ["lo", "hi"]).groupBy((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("tile")).agg(F.collect_list("fp").alias("fps"))
    tiles = written(tiles, "tiles")
    near = []
    for x in sizes:
        for y in ((x[0] + i, x[1] + j) for i in range(-radius, radius + 1) for j in range(abs(i) - radius, radius - abs(i) + 1)):
            if y in sizes and x <= y:
                near.append((first[x], parts[x], first[y], parts[y]))
    pairs = spark.createDataFrame(near, "xf int, xn int, yf int, yn int")
    of = lambda f, n: F.explode(F.sequence(F.col(f), F.col(f) + F.col(n) - 1))
    pairs = pairs.withColumn("a", of("xf", "xn")).withColumn("b", of("yf", "yn")).filter("xf <> yf or a <= b").select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (np.asarray(batch.column(c)[i].values).view(np.uint64) for c in ("x", "y"))
                u, v = forest(x, y, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    x = tiles.select(F.col("tile").alias("a"), F.col("fps").alias("x"))
    y = tiles.select(F.col("tile").alias("b"), F.col("fps").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("x", "y").mapInArrow(compare, "u bigint, v bigint")


def grouped(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, fp, root (the component's least fingerprint) and component_id of each row of ``docs``."""
    found = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    near = written(links(distinct.select("fp"), radius), "links")
    rooted = distinct.join(components(near).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "components")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = written(rooted.join(named, "root").select("fp", "n", "root", "component_id"), "fingerprint-components")
    return joined_to_groups(found, of_fp, "fp", "n").select("doc_id", "key", "fp", "root", "component_id")


def membership(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return grouped(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null being largest; of equal ones, by a hash of the text)."""
    held = grouped(docs, id_col=id_col, text_col=text_col, **options)
    kept = written(held.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("row")).select("row.doc_id", "row.key"), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns)), F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"))
    # Dealt by the hash alone, which holds the doc_id too, the rows need no second shuffle to leave repeats out.
    same = (rows["key"] == kept["key"]) & F.coalesce(rows["doc_id"] == kept["doc_id"], rows["doc_id"].isNull() & kept["doc_id"].isNull())
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "key"]).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
