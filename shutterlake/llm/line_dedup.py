"""Line dedup (operator 6): fuzzy lines by MinHash.

1. Lines are named by 128 bits of hashes.  One pass over the texts writes a table of
   all lines' places, names and bands; later steps read that, and of the texts only the
   candidates' lines.
2. Bands are made of a sample of a line's shingles of SPAN characters: those that start
   at one of a few characters; if they are too few, at one of more, or all (and by
   SHINGLE characters, of very few).  A line close to such a limit has both kinds.  The
   sample's hashes are put in order; a band is a hash of three neighbours (four of
   shingles of SHINGLE) among the least.  MinHash by one order, bands of its least values.
3. Lines that share a band are candidates: all bands are dealt out once by their hash,
   which finds the shared ones and their lines.  Of each band the pivot is the line whose
   bands have most lines in all: of texts copied with changes, the one that was copied.
   Each line is compared with its bands' pivots; then with the line of another component
   that its sketch is nearest to; then, within each band, all lines that are still of
   different components are compared with each other, each pair once.  So any two lines that
   share a band are of one component or have been compared, and a group of thousands of
   variants costs few comparisons a line, but for those that stay apart.  A comparison is by sketches first (within the
   join): parities of the set of shingles of SHINGLE characters, which bound by how much
   two sets differ; then by the exact Jaccard similarity of those sets.
4. Union-find by distributed star contraction; of each component the first occurrence
   (smallest doc_id, then line number) stays.

Everything is DataFrame operations.  ``minima``, ``signature`` and ``similar`` are the
former numpy forms; no query runs them, their tests are kept.

The tests hold the recall of the bands at a similarity of 0.8 to 0.97 for lines of 90
characters or more changed at one end, 0.95 for those of 36, 0.9 for the shortest and for
400 characters with changes of one character all over.

Defined results: lines are split at \\n; a line without a word is kept and not
compared; a null text has one empty line; lines shorter than a shingle are one
shingle; null doc_ids come first; of one doc_id's lines the smallest line number comes
first, then rows by a hash of their text; rows equal in doc_id and text share their
decisions, and keep each line that is first; an empty table gives no rows; other
columns are kept by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..workspace import written

#: Characters of a shingle; the similarity that links lines.
SHINGLE, SIMILARITY = 5, 0.8
#: log2 of the bins of a signature; bands, and bins of a band; words of a sketch, of 32 bins' last two bits each.
BITS, BANDS, ROWS, WORDS = 8, 15, 6, 8
#: Deviations by which two sketches may miss the similarity.
DEVIATIONS = 3
#: Characters of a line whose set of shingles is kept while pairs are compared, and how many such sets are.
SHORT, REMEMBERED_SETS = 1024, 512
#: Characters that are hashed at a time, and lines that are signed at a time; lines that a task remembers to have signed.
PART, SIGNED, REMEMBERED = 1 << 16, 2048, 1 << 18
#: Bytes of a table that may be broadcast once its rows are counted.
BROADCAST = 24 << 20
#: Names whose copies are left out before bands are dealt out.
OFTEN = 1 << 17
#: Odd multipliers of the hash, and the value of an empty bin.
STEP, SPREAD, EMPTY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xFFFFFFFFFFFFFFFF)
#: The bins of the bands.
BAND_BINS = np.random.default_rng(6).permutation(1 << BITS)[: BANDS * ROWS].reshape(BANDS, ROWS)
#: Characters of a band's shingle with the one it starts at: one of a few characters, of more, or any; and of one of SHINGLE (the last dot goes on by a whole character).
SPAN = 9
RARE, FREQUENT = (rf"(?s)[{x}\x{{80}}-\x{{10FFFF}}](?=(.{{{SPAN - 1}}}))" for x in ("a05", "aeio0-9"))
EVERY, OF_FIVE = (rf"(?s)(?=({'.' * n}))." for n in (SPAN - 1, SHINGLE))
#: Hashes kept of a line; how many make samples enough, or are used beside all; fewer shingles than FEW are also taken by SHINGLE.
KEPT, ENOUGH, AT_LEAST, FEW = 27, 16, 12, 24


def _hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of the shingle at each place of ``codes`` (code points) but the last SHINGLE - 1."""
    c, m = codes.astype(np.uint64), len(codes) - SHINGLE + 1
    out = np.zeros(m, np.uint64)
    for k in range(0, SHINGLE, 3):  # three code points of 21 bits fit a word
        word = c[k : k + m].copy()
        for j in range(k + 1, min(k + 3, SHINGLE)):
            word |= c[j : j + m] << np.uint64(21 * (j - k))
        out = (out ^ word) * STEP
        out ^= out >> np.uint64(32)
    out *= SPREAD
    out ^= out >> np.uint64(29)
    return out * STEP


def _blocks(lines: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of several lines on end, which line each is of, and whether a shingle starts there.

    ``lines`` are in UTF-32, each filled up to a shingle with zeros; a line longer than
    PART comes in pieces that share what shingles at the cut need.
    """
    held, owners, n = [], [], 0

    def full():
        codes = np.frombuffer(b"".join(held), "<u4")
        sizes = np.array([len(x) // 4 for x in held])
        ends = np.cumsum(sizes)
        starting = np.ones(len(codes), bool)
        for k in range(1, SHINGLE):
            starting[ends - k] = False
        return codes, np.repeat(np.array(owners), sizes), starting

    for i, line in enumerate(lines):
        for a in range(0, max(1, len(line) // 4 - SHINGLE + 1), PART):
            held.append(line[4 * a : 4 * (a + PART + SHINGLE - 1)])
            owners.append(i)
            n += len(held[-1]) // 4
            if n >= PART:
                yield full()
                held, owners, n = [], [], 0
    if held:
        yield full()


def minima(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each line the least hash of each bin, empty ones filled, and how many were not empty."""
    bins = 1 << BITS
    out = np.full(len(lines) * bins, EMPTY)
    for codes, owner, starting in _blocks([x.encode("utf-32-le", "replace").ljust(4 * SHINGLE, b"\0") for x in lines]):
        m = len(codes) - SHINGLE + 1
        ok = starting[:m]
        h = _hashes(codes)[ok]
        np.minimum.at(out, owner[:m][ok] * bins + (h >> np.uint64(64 - BITS)).astype(np.int64), h)
    out = out.reshape(len(lines), bins)
    filled = (out != EMPTY).sum(axis=1)
    for level in range(BITS):  # halves of 2**level bins: an empty one is like its sibling
        halves = out.reshape(len(lines), -1, 2, 1 << level)
        a, b = halves[:, :, 0].copy(), halves[:, :, 1]
        halves[:, :, 0] = np.where(a == EMPTY, b, a)
        halves[:, :, 1] = np.where(b == EMPTY, a, b)
    return out, filled


def signature(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each line's bands; its sketch: WORDS words, then the number of filled bins."""
    least, filled = minima(lines)
    bands = np.zeros((len(lines), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        bands = (bands ^ least[:, BAND_BINS[:, r]]) * STEP
        bands ^= bands >> np.uint64(29)
    digits = (least & np.uint64(3)).reshape(len(lines), WORDS, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    words = np.bitwise_or.reduce(digits, axis=2)
    return bands.view(np.int64), np.column_stack([words.view(np.int64), filled])


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def _few(df: DataFrame, width: int = 64) -> DataFrame:
    """``df`` (a written table of ``width`` bytes a row in memory), to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() * width <= BROADCAST else df


def _pieces(line: Column, shared: int) -> Column:
    """A line in pieces of PART characters, each with the next one's first ``shared``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(line) - 1) / PART).cast("int")), lambda k: F.substring(line, k * PART + 1, F.lit(PART + shared)))


def _hashed(line: Column, pattern: str) -> Column:
    """Hashes of the shingles that ``pattern`` finds, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda x: F.xxhash64(x)))


def _least(line: Column, pattern: str) -> Column:
    """The KEPT least of the hashes of ``pattern``, in order; no more than a piece's shingles are held at once."""
    of = lambda x: F.slice(F.sort_array(_hashed(x, pattern)), 1, KEPT)
    long = F.slice(F.sort_array(F.array_distinct(F.flatten(F.transform(_pieces(line, SPAN), of)))), 1, KEPT)
    return F.when(F.length(line) <= PART, of(line)).otherwise(long)


def _windows(hashes: str, rows: int, most: int) -> Column:
    """Hashes of ``rows`` neighbours each in the order of ``hashes``, which goes on from its end to its start."""
    at = lambda i: F.get(hashes, i % F.size(hashes))
    return F.transform(F.slice(hashes, 1, most), lambda x, i: F.xxhash64(F.lit(rows), x, *(at(i + k) for k in range(1, rows))))


def band_keys(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with bands, an array of hashes, in place of ``line`` (in lower case)."""
    c = F.col
    rest = [x for x in lines.columns if x != line]
    df = lines.withColumn("rare", _least(c(line), RARE))
    df = df.withColumn("frequent", F.when(F.size("rare") < ENOUGH, _least(c(line), FREQUENT)))
    df = df.withColumn("every", F.when(F.size("frequent") < ENOUGH, _least(c(line), EVERY)))
    short = F.when(F.length(line) < SHINGLE, F.array(F.xxhash64(line))).otherwise(_least(c(line), OF_FIVE))
    df = df.withColumn("five", F.when(F.size("every") < FEW, short))
    none = F.array().cast("array<bigint>")
    of = [F.when(F.size(x) >= AT_LEAST, _windows(x, 3, 12)).otherwise(none) for x in ("rare", "frequent", "every")]
    return df.select(*rest, F.concat(*of, F.when(c("five").isNotNull(), _windows("five", 4, FEW)).otherwise(none)).alias("bands"))


def signed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """LINES: doc_id, key (of the row), line_no, h1 and h2 (the name) and bands of each line with a word."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _row_key(id_col, text_col).alias("key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.filter(F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")
    return band_keys(rows.select("doc_id", "key", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.lower("line").alias("line")))


def _sketches(texts: DataFrame) -> DataFrame:
    """id and sketch of lines (id, line): for each of 64 * WORDS bits whether an odd number of shingles has it, then the number of shingles.

    Lines longer than PART have none, and are compared without.
    """
    c = F.col
    one = texts.filter(F.length("line") <= PART).select("id", F.explode(_five(c("line"))).alias("h"))
    one = one.select("id", F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit"))
    words = [F.bit_xor(F.when(c("word") == k, c("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    return one.groupBy("id").agg(*words, F.count(F.lit(1)).alias("n")).select("id", F.array(*(c(f"w{k}") for k in range(WORDS)), c("n")).alias("sketch"))


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _may_be_similar(a: Column, b: Column, deviations: float = DEVIATIONS) -> Column:
    """Whether two sketches allow SIMILARITY.

    At SIMILARITY the sets differ by ``apart`` shingles at most.  Each changes one bit, so no more bits differ;
    nor more than ``deviations`` beyond what so many changes leave, as some change a bit back.
    """
    bits = 64 * WORDS
    differ = _differ(a, b)
    apart = (a[WORDS] + b[WORDS]) * ((1 - SIMILARITY) / (1 + SIMILARITY))
    left = F.exp(apart * (-2.0 / bits))
    likely = (1 - left) * (bits / 2) + F.sqrt((1 - left * left) * (bits / 4)) * deviations
    sizes = F.least(a[WORDS], b[WORDS]) >= F.greatest(a[WORDS], b[WORDS]) * (SIMILARITY - 1e-9)
    return F.coalesce(sizes & (differ <= F.least(apart + 1e-6, likely)), F.lit(True))


def _five(line: Column) -> Column:
    """Hashes of a line's shingles, each once."""
    return F.when(F.length(line) < SHINGLE, F.array(F.xxhash64(line))).otherwise(_hashed(line, OF_FIVE))


def _shingles(line: str) -> np.ndarray:
    """Hashes of a line's shingles, repeats too."""
    return _hashes(np.frombuffer(line.encode("utf-32-le", "replace").ljust(4 * SHINGLE, b"\0"), "<u4"))


@lru_cache(REMEMBERED_SETS)
def _short_set(line: str) -> frozenset[int]:
    return frozenset(_shingles(line).tolist())


def similar(x: list[str], y: list[str]) -> np.ndarray:
    """Of each pair of lower-cased lines, whether the sets of their shingles have Jaccard similarity SIMILARITY or more.

    Shingles are compared by their 64-bit hashes.  Pairs of one line come one after another, so sets of short lines are kept.
    """
    out = np.zeros(len(x), bool)
    for i, (a, b) in enumerate(zip(x, y)):
        if max(len(a), len(b)) <= SHORT:
            one, two = _short_set(a), _short_set(b)
            common = len(one & two)
        else:
            one, two = np.unique(_shingles(a)), np.unique(_shingles(b))
            common = len(np.intersect1d(one, two, assume_unique=True))
        out[i] = common >= SIMILARITY * (len(one) + len(two) - common)
    return out


def _exact(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose lines are similar: the sets of their shingles, by 64-bit hashes, have Jaccard similarity SIMILARITY or more."""
    c = F.col
    enough = c("common") >= (c("nu") + c("nv") - c("common")) * SIMILARITY
    raw = lambda x: F.when(F.length(x) < SHINGLE, F.array(F.xxhash64(x))).otherwise(F.transform(F.regexp_extract_all(x, F.lit(OF_FIVE), F.lit(1)), lambda g: F.xxhash64(g)))
    x, y = texts.select(c("id").alias("u"), c("line").alias("x")), texts.select(c("id").alias("v"), c("line").alias("y"))
    both = pairs.join(x, "u").join(y, "v")
    long = (F.length("x") > PART) | (F.length("y") > PART)
    sets = both.filter(~long).select("u", "v", raw(c("x")).alias("a"), raw(c("y")).alias("b"))
    # Both functions take each hash once, however often it is there.
    found = sets.filter(F.size(F.array_intersect("a", "b")) >= F.size(F.array_union("a", "b")) * SIMILARITY).select("u", "v")
    far = texts.filter(F.length("line") > PART)
    if far.isEmpty():
        return found
    # Lines of many pieces: no set is held whole.
    apart = written(both.filter(long).select("u", "v"), "long-pairs")
    named = apart.select(c("u").alias("id")).union(apart.select("v")).distinct()
    pieces = texts.join(named, "id", "left_semi").select("id", F.explode(_pieces(c("line"), SHINGLE - 1)).alias("piece"), (F.length("line") < SHINGLE).alias("short"))
    hashes = pieces.filter((F.length("piece") >= SHINGLE) | c("short")).select("id", F.explode(_five(c("piece"))).alias("h")).distinct()
    hashes = written(hashes, "long-shingles")
    sizes = hashes.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    mine, other = hashes.withColumnsRenamed({"id": "u"}), hashes.withColumnsRenamed({"id": "v"})
    common = apart.join(mine, "u").join(other, ["v", "h"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"))
    common = common.join(sizes.withColumnsRenamed({"id": "u", "n": "nu"}), "u").join(sizes.withColumnsRenamed({"id": "v", "n": "nv"}), "v")
    return found.union(common.filter(enough).select("u", "v"))


def edges(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of a graph whose components are those of all similar lines that share a band.

    ``members`` has band, id and sketch, ``texts`` (unique id) id and line in lower case.
    """
    c = F.col
    sizes = _few(written(members.groupBy("band").agg(F.count(F.lit(1)).alias("k")), "band-sizes"))
    central = members.select("band", "id").join(sizes, "band").groupBy("id").agg(F.sum("k").alias("central"))
    placed = written(members.join(_few(written(central, "central")), "id").select("band", "id", "sketch", "central"), "placed")
    pivots = placed.groupBy("band").agg(F.max(F.struct("central", -c("id"), "sketch")).alias("pivot"))
    held = written(pivots.select("band", (-c("pivot.col2")).alias("v"), c("pivot.sketch").alias("other")), "pivots")
    near = members.join(held, "band").filter((c("id") != c("v")) & _may_be_similar(c("sketch"), c("other"))).select(c("id").alias("u"), "v")
    joined = written(components(written(_exact(near.distinct(), texts), "pivot-links")), "joined")
    rows = _mixed(members, joined)
    likely = written(_apart(rows, 0), "likely")
    links = written(_exact(_nearest(likely), texts), "likely-links")
    # Links of lines as links of their components, which are few.
    between = links.join(likely, ["u", "v"]).select(c("from").alias("u"), c("to").alias("v"))
    merged = written(components(written(between, "between")), "merged")
    others = written(_exact(_apart(_merged(rows, merged), DEVIATIONS).select("u", "v"), texts), "other-links")
    # What is known stands as a link from each line to its component's least.
    known = [x.select(c("node").alias("u"), c("root").alias("v")) for x in (joined, merged)]
    return known[0].union(known[1]).union(others)


def _rooted(df: DataFrame, joined: DataFrame, of: str, root: str = "root") -> DataFrame:
    """``df`` with ``root``, the component of its column ``of`` under ``joined`` (node, root)."""
    named = _few(joined).toDF("named", "found")
    return df.join(named, F.col(of) == F.col("named"), "left").withColumn(root, F.coalesce("found", of)).drop("named", "found")


def _mixed(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The lines of bands whose lines are of different components, in each such band.

    band, id, sketch, root (the component under ``joined``), main (the band's largest component) and bands (all of the line's here).
    """
    c = F.col
    rooted = written(_rooted(members, joined, "id"), "rooted")
    sizes = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("k", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("band", "main")
    now = rooted.join(_few(written(mixed, "mixed-bands")), "band")
    lines = now.groupBy("id").agg(F.any_value("sketch").alias("sketch"), F.any_value("root").alias("root"), F.collect_list(F.struct("band", "main")).alias("at"))
    return written(lines.select("id", "sketch", "root", c("at.band").alias("bands"), F.inline("at")), "apart")


def _merged(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` of ``_mixed`` after components have been joined (node, root)."""
    return written(_rooted(_rooted(rows, merged, "root"), merged, "main", "main"), "apart-merged")


def _apart(rows: DataFrame, deviations: float) -> DataFrame:
    """Pairs (u, v) that share a band, are of different components (``from``, ``to``) and may be similar; each once.

    ``gap`` is the bits that differ, of the sizes.  ``rows`` are of ``_mixed``.  Of a
    band's components the largest is not compared with itself, so a family of
    variants is no square.
    """
    c = F.col
    # Sketches as columns: with arrays the join's code is too long to be compiled.
    x, y = ([c(f"{n}{k}") for k in range(WORDS + 1)] for n in "xy")
    right = rows.select("band", "id", "root", "main", "bands", *(c("sketch")[k].alias(f"x{k}") for k in range(WORDS + 1)))
    left = rows.filter("root <> main").select(c("band").alias("b"), c("id").alias("u"), c("root").alias("from"), c("bands").alias("also"), *(c("sketch")[k].alias(f"y{k}") for k in range(WORDS + 1)))
    # Of two that are both outside the largest component, one comparison is enough.
    both = (c("root") != c("from")) & ((c("root") == c("main")) | (c("id") > c("u"))) & _may_be_similar(x, y, deviations)
    # They share only bands that are in both rows' lists: a pair is made in the least of them.
    once = F.array_min(F.array_intersect("bands", "also")) == c("band")
    gap = F.coalesce(_differ(x, y) / (x[WORDS] + y[WORDS]), F.lit(0.0))
    return left.join(right, (c("band") == c("b")) & both & once).select("u", c("id").alias("v"), gap.alias("gap"), "from", c("root").alias("to"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, gap) the one of the least gap of each u, and of each v."""
    of = [pairs.groupBy(x).agg(F.min(F.struct("gap", y))[y].alias(y)).select("u", "v") for x, y in ("uv", "vu")]
    return of[0].union(of[1]).distinct()


def _candidates(lines: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``distinct`` (h1, h2) the lines that share a band with another, with an id, and their bands (band, id).

    All bands are dealt out once, which serves both the search for shared ones and its result; nothing of their number is broadcast.
    """
    c = F.col
    # Of the names that are met most only the first line is dealt out: copies share all bands, and add nothing.
    often = distinct.filter("n > 1").orderBy(F.desc("n")).limit(OFTEN).select("h1", "h2", "first")
    once = lines.join(F.broadcast(written(often, "often")), ["h1", "h2"], "left").filter(c("first").isNull() | c("first").eqNullSafe(F.struct("doc_id", "line_no", "key")))
    dealt = once.select(F.explode("bands").alias("band"), "h1").repartition("band")
    shared = dealt.groupBy("band").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("band")
    found = written(dealt.join(shared.hint("shuffle_hash"), "band").distinct(), "shared-members")
    some = written(found.select("h1").distinct(), "shared-names")
    nodes = written(distinct.join(_few(some), "h1").select("h1", "h2").withColumn("id", F.monotonically_increasing_id()), "candidates")
    return nodes, written(found.join(_few(nodes), "h1").select("band", "id"), "bands")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and line (in lower case) of the lines of ``wanted``: id and first (doc_id, line_no, key)."""
    c = F.col
    of = wanted.groupBy(c("first.key").alias("k"), c("first.doc_id").alias("d")).agg(F.collect_list(F.struct(c("first.line_no").alias("line_no"), "id")).alias("lines"))
    # A row of this is as long as its text has candidates: 256 bytes are ample for the mean, as all texts' lines number few times their rows.
    rows = docs.select(c(f"`{id_col}`").cast("long").alias("doc_id"), _row_key(id_col, text_col).alias("key"), c(f"`{text_col}`").alias("text"))
    some = rows.join(_few(written(of, "wanted"), 256), (c("key") == c("k")) & c("doc_id").eqNullSafe(c("d")))
    some = some.select("lines", F.split("text", "\n").alias("split")).select(F.explode(F.transform("lines", lambda x: F.struct(x["id"].alias("id"), F.lower(F.get("split", x["line_no"])).alias("line")))).alias("x"))
    return some.select("x.id", "x.line").distinct()


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: doc_id, key, line_no, keep (doc_id, line_no, key) and n_lines."""
    own = F.struct("doc_id", "line_no", "key")
    lines = written(signed_lines(docs, id_col, text_col), "lines")
    distinct = written(lines.groupBy("h1", "h2").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-lines")
    nodes, bands = _candidates(lines, distinct)
    known = written(distinct.join(_few(nodes), ["h1", "h2"], "left").filter("n > 1 OR id IS NOT NULL"), "known-lines")
    found = written(_texts(docs, known.filter("id IS NOT NULL").select("id", "first"), id_col, text_col), "candidate-lines")
    sketches = written(_sketches(found), "sketches")
    members = written(bands.join(_few(sketches, 128), "id", "left").select("band", "id", "sketch"), "members")
    rooted = written(components(edges(members, found)), "line-components")
    # A line without an id is alone but for its copies: it is its own root, by name.
    alike = known.join(_few(rooted), known["id"] == rooted["node"], "left").filter("n > 1 OR root IS NOT NULL").select("h1", "h2", "root", "first", "n")
    alike = written(alike, "alike")
    kept = alike.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("n_lines"))
    named = alike.filter("root IS NOT NULL").select("h1", "h2", "root").join(kept, "root").drop("root")
    named = written(named.unionByName(alike.filter("root IS NULL").select("h1", "h2", F.col("first").alias("keep"), F.col("n").alias("n_lines"))), "named")
    out = lines.drop("bands").join(_few(named, 80), ["h1", "h2"], "left")
    return out.select("doc_id", "key", "line_no", F.coalesce("keep", own).alias("keep"), F.coalesce("n_lines", F.lit(1)).cast("long").alias("n_lines"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: doc_id, line_no, keep_doc_id, keep_line_no, n_lines, kept.

    ``keep_*`` name the line that stays of its component, ``n_lines`` is the
    component's number of lines.
    """
    return places(docs, id_col, text_col).select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("keep.doc_id").alias("keep_doc_id"),
        F.col("keep.line_no").cast("long").alias("keep_line_no"),
        "n_lines",
        F.col("keep").eqNullSafe(F.struct("doc_id", "line_no", "key")).alias("kept"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text column less the lines that do not stay; null texts stay null."""
    gone = places(docs, id_col, text_col).filter(~F.col("keep").eqNullSafe(F.struct("doc_id", "line_no", "key")))
    gone = gone.groupBy("key", "doc_id").agg(F.collect_set("line_no").alias("gone")).withColumnsRenamed({"doc_id": "gone_from", "key": "gone_key"})
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    df = docs.toDF(*names)
    df = df.join(gone, (_row_key(key, text) == F.col("gone_key")) & F.col(key).cast("long").eqNullSafe(F.col("gone_from")), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("gone", i))
    df = df.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    return df.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
