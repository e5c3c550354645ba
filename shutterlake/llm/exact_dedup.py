"""Exact dedup (operator 2): a persistent digest index, bucketed and sorted by hash.

The index has one row per distinct text: its digest (SHA-256 of the normalised text,
as raw bytes), the doc_id of the row that stands for it, and the batch that brought it.
It is kept in runs, each a table bucketed and sorted by digest with one file a bucket,
so a new batch meets each run in a sort-merge anti-join in which only the batch's
digests are shuffled and sorted, never the index.  What is left is appended as a run;
beyond RUNS of them all are merged into one.  Which runs there are stands in a manifest,
written last: a batch that fails midway leaves the index as it was, and a batch that
is run again under its name gets the rows that it got before.  One process at a time
may write to an index.  Only DataFrame operations are used.

Rows are first counted per digest with map-side combining, so a text that a
third of all rows share costs one partial row per task.  Rows then join their groups,
of which the few large ones are broadcast, so no key is one task's burden.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z only; of equal texts in a batch the row with the largest doc_id
stands, null being smallest; a text that the index already holds of another batch is a
copy of the row recorded there; rows that repeat a doc_id with an equal text share one
decision in ``membership`` and leave one row in ``survivors``; an empty batch
changes nothing; other columns, whatever their names, are kept by ``survivors``.
"""

from __future__ import annotations

import hashlib
import json
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import absolute, get, listed, named, put, remove, temporary, written
from .common import joined_to_groups, whole_text

#: Fixed: what counts as the same text.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: How the names of manifests begin; names with "_" first are no data.
MANIFEST = "_manifest_"
SCHEMA = "digest binary, keep_id bigint, batch string"
#: Runs that a batch is joined to one after another, before they are merged; rows of a bucket, about, in a merged run.
RUNS, BUCKET_ROWS = 4, 4_000_000


def normalised(text_col: str = "text") -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the faster built-in."""
    text = whole_text(text_col)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text_col).cast("binary"), 256))


class DigestIndex:
    """The persistent index at ``location``: bucketed, sorted Parquet tables and a manifest.

    Catalog entries may vanish with a session; opening the same location again brings
    them back, under names made of the tables' whole paths.  ``buckets`` is of a new
    index only, and by default as many as the session's shuffle partitions, so that a
    batch is dealt out once; a merge may take more.  The session is told to use the
    order of sorted buckets.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        self.spark, self.location = spark, absolute(spark, location or temporary(spark, "digests"))
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        found = [n for n in listed(spark, self.location) if n.startswith(MANIFEST) and n.endswith(".json")]
        fresh = {"version": 0, "buckets": buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), "runs": []}
        self.state = json.loads(get(spark, f"{self.location}/{max(found)}")) if found else fresh

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def _table(self, run: dict) -> DataFrame:
        place, name = self._place(run["folder"])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {run['buckets']} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def _place(self, folder: str) -> tuple[str, str]:
        place = f"{self.location}/{folder}"
        return place, named(self.spark, "digest_run_" + hashlib.sha1(place.encode()).hexdigest())

    def tables(self, without: str | None = None) -> list[DataFrame]:
        """The runs, without the rows that batch ``without`` brought."""
        held = [self._table(r) for r in self.state["runs"] if without is None or r["batch"] != without]
        return held if without is None else [t.filter(F.col("batch") != without) for t in held]

    def rows(self) -> DataFrame:
        out = self.spark.createDataFrame([], SCHEMA)
        for t in self.tables():
            out = out.unionByName(t)
        return out

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df``, which an aggregate has dealt by digest, as the index is: no step of its own if that has as many buckets."""
        return df if int(self.spark.conf.get("spark.sql.shuffle.partitions")) == self.buckets else df.repartition(self.buckets, "digest")

    def unknown(self, df: DataFrame, without: str | None = None) -> DataFrame:
        """Rows of ``df`` whose digest the index does not hold (but for what batch ``without`` brought), by sort-merge."""
        df = self.dealt(df)
        for t in self.tables(without):
            df = df.join(t.select("digest").hint("merge"), "digest", "left_anti")
        return df

    def append(self, new: DataFrame, batch: str | None = None) -> None:
        """Append rows (digest, keep_id), of distinct digests that no other batch's rows have, as ``batch``'s run.

        What a batch of that name brought before is replaced, or kept where it has been merged.
        """
        others = [r for r in self.state["runs"] if batch is None or r["batch"] != batch]
        given = new.select("digest", "keep_id", F.lit(batch or uuid.uuid4().hex).alias("batch"))
        for r in others if batch is not None else []:
            given = given.join(self._table(r).filter(F.col("batch") == batch).select("digest"), "digest", "left_anti")
        self._commit([*others, self._run(given, batch, self.buckets)], self.buckets)
        if len(self.state["runs"]) > RUNS:
            self.merge()

    def merge(self) -> None:
        """Make one run of all; its buckets grow with its rows."""
        rows = self.rows()
        buckets = max(self.buckets, -(-rows.count() // BUCKET_ROWS))
        self._commit([self._run(rows, None, buckets)], buckets)

    def _run(self, rows: DataFrame, batch: str | None, buckets: int) -> dict:
        folder = "run-" + uuid.uuid4().hex
        place, name = self._place(folder)
        rows.repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").option("path", place).saveAsTable(name)
        return {"folder": folder, "batch": batch, "buckets": buckets}

    def _commit(self, runs: list[dict], buckets: int) -> None:
        gone = [r["folder"] for r in self.state["runs"] if r not in runs]
        before, self.state = self.state, {"version": self.state["version"] + 1, "buckets": buckets, "runs": runs}
        put(self.spark, f"{self.location}/{MANIFEST}{self.state['version']:012d}.json", json.dumps(self.state).encode())
        for folder in gone:
            place, name = self._place(folder)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, place)
        if before["version"]:
            remove(self.spark, f"{self.location}/{MANIFEST}{before['version']:012d}.json")


def _grouped(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def membership(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``group_size`` counts the batch's rows with that text.  New digests are appended to
    the index before this returns, under the name ``batch``: run again by that name, a
    batch gets the same rows.  Without a name each run is a batch of its own.
    """
    digests = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), digest(text_col).alias("digest")), "batch-digests")
    groups = index.dealt(_grouped(digests).withColumns({"known_id": F.lit(None).cast("long"), "known": F.lit(False)}))
    for t in index.tables(batch):
        found = t.select("digest", F.col("keep_id").alias("found_id"), F.lit(True).alias("found")).hint("merge")
        groups = groups.join(found, "digest", "left").select("digest", "keep_id", "group_size", F.when(F.col("found"), F.col("found_id")).otherwise(F.col("known_id")).alias("known_id"), (F.col("known") | F.col("found").isNotNull()).alias("known"))
    groups = written(groups, "batch-groups")
    index.append(index.unknown(groups, batch), batch)
    standing = groups.select("digest", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", (~F.col("known")).alias("new"))
    return joined_to_groups(digests, standing, "digest", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the index learns their digests as of ``batch``.

    Each digest's row is chosen by an aggregate that combines copies before the
    shuffle; the survivors are written once, then fed to the index.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    row = F.struct(F.col(f"`{id_col}`").alias("first"), *(F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns)))
    one = docs.select(digest(text_col).alias("digest"), row.alias("row")).groupBy("digest").agg(F.max("row").alias("row"))
    # A column that is not deterministic keeps the join from being moved below the aggregate, where copies would not be combined before the shuffle.
    one = one.withColumn("place", F.monotonically_increasing_id())
    fresh = written(index.unknown(one, batch), "survivors")
    index.append(fresh.select("digest", F.col("row.first").alias("keep_id")), batch)
    return fresh.select(*(F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns)))
