"""Mixing sources to target weights (operator 4): a hypergeometric splitting tree.

A source's rows are dealt into blocks by a keyed hash.  A source whose target is
f whole times its size and a part is drawn as f passes over all its blocks and one
pass that ends early: blocks follow a keyed permutation, the block in which the
target falls is cut by the hash, and the best subset of the rows around the cut is taken.  Every
block (and the cut one) of every pass is a unit.

The mix has a number of output shards, each with an equal quota of units.  A tree
over the shards splits the vector of the sources' unit counts at each node by a
multivariate hypergeometric draw, so a shard holds exactly its quota, and the
sources in the proportions that drawing without replacement gives.  Each shard then
takes the next units of each source's permuted list, which are disjoint, and orders
its own rows by a keyed hash.  A row is in the mix as often as shards drew units that
hold it, and in no other way.

What reaches the driver: a row for each source, one for each block (BLOCKS, and one more
a source, at most), and the rows of one leaf a source (about LEAF).  The documents themselves
are never shuffled to be chosen; only ``rows`` moves them, by ranges of shards.

Defined results: a null text has size 0 and is drawn with its block, adding no
words; null sources form one source, last in order; sources whose words are all
none get target 0; rows equal in doc_id and text are drawn together; an empty table
gives an empty mix.  Every draw is keyed by ``seed``, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, whole_text, written

#: Weights of the sources in order, repeating; and how often a source may be repeated.
WEIGHTS, MOST_PASSES = (5, 2, 1), 3
#: Rows of a leaf or a block, at least (about); blocks of all sources, and cells of a block, at most.
LEAF, BLOCKS, CELLS = 1024, 1 << 18, 4096
#: Rows around the cut of which the best subset is taken.
CLOSING = 64
#: Words of an output shard, about; shards at most; partitions that shards are dealt to, at most.
SHARD_WORDS, SHARDS, WRITERS = 1 << 20, 1 << 18, 1 << 16
#: Rows of the plan's tables that may be broadcast: some tens of bytes each.
BROADCAST_ROWS = 500_000


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def row_key(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: float = MOST_PASSES) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, none above ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, share, out = float(sum(sizes.values())), sum(weight.values()), {}
    # Capping a source leaves more for each weight of the others, so those of least size a weight are capped first.
    for s in sorted(order, key=lambda s: sizes[s] / weight[s]):
        out[s] = min(left * weight[s] / share, float(most * sizes[s]))
        if out[s] == most * sizes[s]:
            left, share = left - out[s], share - weight[s]
    return {s: out[s] for s in order}


def split(sources: np.ndarray, quotas: np.ndarray, capacities: np.ndarray, rng: np.random.Generator, first: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The tree: (shard, sources, units of each) for each shard, whose units sum to its capacity.

    ``quotas`` are the units that the node has of ``sources``; they sum to that of ``capacities``.
    """
    if len(capacities) == 1:
        yield first, sources, quotas
        return
    half = len(capacities) // 2
    left = rng.multivariate_hypergeometric(quotas, int(capacities[:half].sum()), method="marginals")
    for part, own, at in ((left, capacities[:half], first), (quotas - left, capacities[half:], first + half)):
        some = part > 0
        yield from split(sources[some], part[some], own, rng, at)


@dataclass
class Source:
    """The plan of one source."""

    name: str | None
    size: int
    rows: int
    target: float
    blocks: int = 1
    passes: int = 0
    #: Of the pass that ends early: its whole blocks, the block that is cut, cells and keys taken of it.
    whole: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    cut: int | None = None
    cells: int = 1
    below: int = 0
    keys: list[int] = field(default_factory=list)


def _permuted(n: int, *key: int) -> np.ndarray:
    return np.random.default_rng([abs(k) for k in key]).permutation(n)


class Mix:
    """A mix of ``docs``; its plan is made from all rows' sizes."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, most: float = MOST_PASSES, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.docs, self.seed, self.spark = docs, seed, docs.sparkSession
        self.names = {"doc_id": id_col, "text": text_col, "source": source_col}
        self.sized = written(
            docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), row_key(seed, id_col, text_col).alias("key"), size_of(text_col).alias("size")),
            "sizes",
        )
        found = self.sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
        want = targets({r["source"]: r["size"] for r in found}, weights, most)
        rows = {r["source"]: r for r in found}
        whole = sum(r["rows"] for r in found)
        blocks = lambda n: max(1, min(n // LEAF, -(-BLOCKS * n // whole)))
        self.sources = [Source(s, rows[s]["size"], rows[s]["rows"], t, blocks(rows[s]["rows"])) for s, t in want.items()]
        self._cut()
        self._deal()

    def _plan(self, columns: str, rows: list[tuple]) -> DataFrame:
        """A small table, broadcast if it is one."""
        df = self.spark.createDataFrame(rows, columns)
        return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df

    def _block(self) -> Column:
        return F.pmod(F.col("key"), F.col("blocks")).cast("int")

    def _cell(self) -> Column:
        return F.pmod(F.shiftrightunsigned("key", 20), F.col("cells")).cast("int")

    def _cut(self) -> None:
        """How the last pass of each source ends."""
        for s in self.sources:
            s.passes = min(int(s.target // s.size), MOST_PASSES) if s.size else 0
        sized = self.sized.withColumnRenamed("source", "name")
        same = lambda a, b: a["name"].eqNullSafe(b["source"])
        plan = self._plan("source string, n int, blocks int", [(s.name, i, s.blocks) for i, s in enumerate(self.sources)])
        found = sized.join(plan, same(sized, plan)).groupBy("n", self._block().alias("block")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).toArrow()
        first = np.concatenate([[0], np.cumsum([s.blocks for s in self.sources])]).astype(np.int64)
        of_block = np.zeros((int(first[-1]), 2), np.int64)
        of_block[first[found["n"].to_numpy()] + found["block"].to_numpy()] = np.column_stack([found["size"].to_numpy(), found["rows"].to_numpy()])
        left: dict[int, float] = {}
        for i, s in enumerate(self.sources):
            rest = s.target - s.passes * s.size
            if rest <= 0 or not s.size:
                continue
            order, own = _permuted(s.blocks, self.seed, i, s.passes), of_block[first[i] : first[i + 1]]
            ends = np.cumsum(own[order, 0])
            k = int(np.searchsorted(ends, rest, "right"))  # blocks that fit as a whole
            s.whole = order[:k]
            if k < s.blocks:
                s.cut, left[i] = int(order[k]), rest - (float(ends[k - 1]) if k else 0.0)
                s.cells = int(max(1, min(CELLS, own[s.cut, 1] // LEAF)))
        cut = [(s.name, i, s.blocks, s.cut, s.cells) for i, s in enumerate(self.sources) if s.cut is not None]
        if not cut:
            return
        plan = self._plan("source string, n int, blocks int, cut int, cells int", cut)
        inside = sized.join(plan, same(sized, plan)).filter(self._block() == F.col("cut")).withColumn("cell", self._cell())
        of_cell: dict[int, dict[int, int]] = {i: {} for i in left}
        for r in inside.groupBy("n", "cell").agg(F.sum("size").alias("size")).collect():
            of_cell[r["n"]][r["cell"]] = r["size"]
        leaf = []
        for i in left:
            s = self.sources[i]
            while s.below < s.cells and of_cell[i].get(s.below, 0) <= left[i]:
                left[i] -= of_cell[i].get(s.below, 0)
                s.below += 1
            if s.below < s.cells:
                leaf.append((s.name, s.below))
        if not leaf:
            return
        names = self._plan("leaf_of string, leaf int", leaf)
        of_leaf: dict[int, list[tuple[int, int]]] = {i: [] for i in left}
        for r in inside.join(names, inside["name"].eqNullSafe(names["leaf_of"]) & (inside["cell"] == names["leaf"])).groupBy("n", "key").agg(F.sum("size").alias("size")).collect():
            of_leaf[r["n"]].append((r["key"], r["size"]))
        for i in left:
            self.sources[i].keys = _closest(sorted(of_leaf[i]), left[i])

    def _deal(self) -> None:
        """``units``: n (of the source), block, pass, cut and the shard of each, by source and in its permuted order."""
        parts = []
        for i, s in enumerate(self.sources):
            own = [(_permuted(s.blocks, self.seed, i, p), p, False) for p in range(s.passes)] + [(s.whole, s.passes, False)]
            own += [(np.array([s.cut]), s.passes, True)] if s.cut is not None else []
            parts += [(np.full(len(b), i), b, np.full(len(b), p), np.full(len(b), c)) for b, p, c in own]
        n, block, passed, cut = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 4
        total, words = len(n), sum(s.target for s in self.sources)
        self.shards = int(max(1, min(SHARDS, total, -(-words // SHARD_WORDS))))
        capacities = np.full(self.shards, total // self.shards) + (np.arange(self.shards) < total % self.shards)
        quotas = np.bincount(n, minlength=len(self.sources))
        drawn = list(split(np.flatnonzero(quotas), quotas[quotas > 0], capacities, np.random.default_rng(self.seed)))
        of = np.concatenate([x for _, x, _ in drawn])
        count = np.concatenate([c for _, _, c in drawn])
        shard = np.repeat(np.array([k for k, _, _ in drawn]), [len(x) for _, x, _ in drawn])
        order = np.lexsort((shard, of))
        # A source's units go to the shards in order, as many to each as it drew.
        self.units = {"n": n, "block": block, "pass": passed, "cut": cut.astype(bool), "shard": np.repeat(shard[order], count[order])}

    def _draws(self) -> DataFrame:
        """For each n and block the draws (mix_pass, mix_shard) of all its rows, and those of the rows before the cut."""
        u = self.units
        key = u["n"].astype(np.int64) << 32 | u["block"].astype(np.int64)
        order = np.lexsort((u["pass"], key))
        key, cut = key[order], u["cut"][order]
        found, starts = np.unique(key, return_index=True)

        def lists(some: np.ndarray) -> pa.ListArray:
            ends = np.concatenate([[0], np.cumsum(some)])
            values = pa.StructArray.from_arrays([pa.array(u[c][order][some], pa.int32()) for c in ("pass", "shard")], ["mix_pass", "mix_shard"])
            return pa.ListArray.from_arrays(pa.array(ends[np.append(starts, len(key))], pa.int32()), values)

        table = pa.table({"n": pa.array(found >> 32, pa.int32()), "block": pa.array(found & 0xFFFFFFFF, pa.int32()), "whole": lists(~cut), "part": lists(cut)})
        draw = "array<struct<mix_pass:int,mix_shard:int>>"
        df = self.spark.createDataFrame(table, f"n int, block int, whole {draw}, part {draw}") if len(found) else self.spark.createDataFrame([], f"n int, block int, whole {draw}, part {draw}")
        return F.broadcast(df) if len(found) <= BROADCAST_ROWS else df

    def _chosen(self, df: DataFrame, source: str) -> DataFrame:
        """``df`` (with key) with its source's plan, and draws: the passes and shards that its row is drawn in."""
        rows = [(s.name, i, s.size, s.target, s.blocks, s.cells, s.below, s.keys) for i, s in enumerate(self.sources)]
        plan = self._plan("p_source string, n int, source_size bigint, target double, blocks int, cells int, below int, taken_keys array<bigint>", rows)
        before = (self._cell() < F.col("below")) | F.array_contains("taken_keys", F.col("key"))
        out = df.join(plan, df[source].eqNullSafe(plan["p_source"])).withColumn("block", self._block()).join(self._draws(), ["n", "block"], "left")
        drawn = F.when(before, F.concat("whole", "part")).otherwise(F.col("whole"))
        return out.withColumn("draws", F.coalesce(drawn, F.array().cast("array<struct<mix_pass:int,mix_shard:int>>")))

    def taken(self) -> DataFrame:
        """One row per row of the input: doc_id, size, source_size, target, taken, and mix_shards that drew it."""
        return self._chosen(self.sized, "source").select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.mix_shard").alias("mix_shards"))

    def rows(self, ordered: bool = True, marked: bool = False) -> DataFrame:
        """The mix: the input's columns, a row for each time it is drawn.

        With ``ordered`` the rows are brought to their shards, whole shards to a partition, and are in each
        shard's own order there; ``marked`` adds mix_shard and mix_pass.
        """
        given = self.docs.columns
        kept = [f"c{i}" for i in range(len(given))]
        back = {c: k for k, c in zip(kept, given)}
        df = self.docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(kept, given)), row_key(self.seed, self.names["doc_id"], self.names["text"]).alias("key"))
        drawn = self._chosen(df, back[self.names["source"]]).select(*kept, "key", F.explode("draws").alias("draw")).select(*kept, "key", "draw.*")
        if ordered:
            writers = min(self.shards, WRITERS)
            drawn = drawn.repartitionById(writers, F.floor(F.col("mix_shard").cast("long") * writers / self.shards).cast("int"))
            drawn = drawn.sortWithinPartitions("mix_shard", F.xxhash64("mix_shard", "mix_pass", "key"))
        return drawn.select(*(F.col(k).alias(c) for k, c in zip(kept, given)), *(["mix_shard", "mix_pass"] if marked else []))


def _closest(rows: list[tuple[int, int]], left: float) -> list[int]:
    """Keys of a leaf whose sizes add up to about ``left``.

    Rows are taken in order while they fit; which of the CLOSING rows around the end
    are taken is the subset nearest to what is then left, by the sums that subsets
    of the first i of them can have (bit sets).
    """
    at, rest = 0, left
    while at < len(rows) and rows[at][1] <= rest:
        rest -= rows[at][1]
        at += 1
    at = max(0, at - CLOSING // 2)
    left -= sum(n for _, n in rows[:at])
    unit = max(1, int(left) >> 22)
    near = [(key, -(-n // unit)) for key, n in rows[at : at + CLOSING] if 0 < n <= 2 * left]
    sums = [1]
    for _, n in near:
        sums.append((sums[-1] | sums[-1] << n) & ((1 << int(2 * left / unit) + 2) - 1))
    want = left / unit
    below, above = int(want), sums[-1] >> int(want) + 1
    while not sums[-1] >> below & 1:
        below -= 1
    best = below
    if above:
        over = int(want) + (above & -above).bit_length()
        best = over if over - want < want - below else below
    taken = [key for key, _ in rows[:at]]
    for i in range(len(near), 0, -1):
        if not sums[i - 1] >> best & 1:
            taken.append(near[i - 1][0])
            best -= near[i - 1][1]
    return taken
