"""Language identification (operator 3): averaged hashed subword embeddings.

A text's subwords are its runs of 2 to 4 characters, letters lower-cased and
anything else a word boundary, that do not cross a boundary.  Each is hashed to one
of BUCKETS embeddings; a text is the mean of its subwords' embeddings, and a linear
softmax over that mean gives the languages' probabilities.  Embeddings and softmax
are trained together by stochastic gradient descent in numpy, on a bounded sample of
labelled rows (SAMPLE a language, SAMPLE_IN_ALL of many languages, one of each at least).  What a row contributes to the sample is a
histogram over buckets made on the executors from its whole text; of these the driver
holds SAMPLE_BYTES at most.

For prediction the two layers are multiplied out to a table of BUCKETS rows and one
column a language (proven size: 512 KiB for 4 languages, linear in their number),
which is broadcast; a text's logits are the mean of its subwords' rows.

Which subwords training has seen is kept apart from the buckets, which a full sample
fills: one bit for each of 2**SEEN_BITS hashes (2 MiB, broadcast with the table),
set on the executors and combined by a shuffle.

Rejection is calibrated on rows kept out of the training: a temperature is fitted so
that the score is a probability, and a text is rejected if it has no letter, or if
its score, or the share of its subwords that training has seen, is below all but
SPARED of the calibration rows.  Fewer of these than 1/SPARED have their lower tail
drawn out to that share (``floor``).  The sample takes as many rows of each language,
so the share of all texts that is spared differs with the languages' shares of them.
The model then states two rates: how many calibration rows it rejects, and how many of
the same with their letters shuffled, which are of no language.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
is rejected; with no labelled row to learn from, every text is; repeated rows give
repeated results; ties go to the language first by code point; an empty table gives
no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

#: log2 of the number of buckets; dimensions of an embedding; lengths of subwords.
BITS, DIM, LENGTHS = 15, 16, (2, 3, 4)
BUCKETS = 1 << BITS
#: Labelled rows a language that training and calibration use, about, and in all; the part of them that calibrates is 1 in KEPT_OUT.
SAMPLE, SAMPLE_IN_ALL, KEPT_OUT = 1_000, 16_000, 5
#: Bytes of histograms that the driver takes, at most (the rows of least hash).
SAMPLE_BYTES = 128 << 20
EPOCHS, RATE = 6, 0.5
#: log2 of the number of bits that tell which subwords training has seen; a subword's bucket is the top of its bit's number.
SEEN_BITS = 24
#: The share of calibration rows that either rule may reject.
SPARED = 0.001
#: Characters hashed at a time.
PART = 1 << 18
UND = "und"
#: Odd multipliers of the hash.
STEP, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter (the first, if there are more), or 0 if it is none."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(len(out)):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def _ids(part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, where subwords start in ``part`` (letters, 0 a boundary) and their hashes of SEEN_BITS bits."""
    letter, out = part > 0, []
    for n in LENGTHS:
        m = len(part) - n + 1
        if m < 1:
            continue
        ok = letter[1 : 1 + m] | letter[:m] if n == 2 else letter[1 : 1 + m].copy()
        for k in range(2, n - 1):
            ok &= letter[k : k + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ part[at + k]) * STEP
            h ^= h >> np.uint32(15)
        out.append((at, (h * SPREAD) >> np.uint32(32 - SEEN_BITS)))
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Letters of several texts on end, where each starts, and which text each is.

    Each text has a boundary on both sides, so no subword spans two.  A text longer
    than PART comes in pieces that share what subwords at the cut need.
    """
    table, held, owners, n = letters(), [], [], 0
    edge = np.zeros(1, np.uint32)

    def full():
        starts = np.cumsum([0, *map(len, held[:-1])])
        return np.concatenate(held), starts, owners

    for i, text in enumerate(texts):
        if not text:
            continue
        own = np.concatenate([edge, table[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")], edge])
        if len(own) > PART:
            for a in range(0, len(own), PART):
                # A piece takes the subwords that start in it: of each length all that start before its last three.
                yield own[a : a + PART + max(LENGTHS) - 1], np.zeros(1, np.int64), [~i if a + PART < len(own) else i]
            continue
        held.append(own)
        owners.append(i)
        n += len(own)
        if n > PART:
            yield full()
            held, owners, n = [], [], 0
    if held:
        yield full()


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint32(SEEN_BITS - BITS)


def sums(texts: list[str | None], table: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its subwords' rows of ``table``, and whether it has a letter.

    With ``seen``, bits in words of 64, the number of subwords whose bit is set is a last column.
    """
    columns = table.shape[1]
    out, lettered = np.zeros((len(texts), columns + (seen is not None))), np.zeros(len(texts), bool)
    for part, starts, owners in _pieces(texts):
        index = [~o if o < 0 else o for o in owners]
        lettered[index] |= np.maximum.reduceat(part, starts) > 0
        cut = PART if owners[0] < 0 else len(part)
        for at, ids in _ids(part):
            keep = np.searchsorted(at, cut)
            run = np.searchsorted(at[:keep], starts)
            got = table[_buckets(ids[:keep])]
            parts = [got[:, col] for col in range(columns)]
            if seen is not None:
                parts.append(seen[ids[:keep] >> 6] >> (ids[:keep] & np.uint32(63)).astype(np.uint64) & np.uint64(1))
            for col, part_of in enumerate(parts):
                total = np.concatenate([[0.0], np.cumsum(part_of, dtype=np.float64)])
                out[index, col] += total[np.append(run[1:], keep)] - total[run]
    return out, lettered


def histogram(text: str | None) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for part, _, owners in _pieces([text]):
        cut = PART if owners[0] < 0 else len(part)
        for at, ids in _ids(part):
            out += np.bincount(_buckets(ids[: np.searchsorted(at, cut)]), minlength=BUCKETS)
    return out


def mark(texts: list[str | None], seen: np.ndarray) -> None:
    """Set the bits of all subwords of ``texts`` in ``seen``."""
    for part, _, owners in _pieces(texts):
        cut = PART if owners[0] < 0 else len(part)
        for at, ids in _ids(part):
            ids = np.unique(ids[: np.searchsorted(at, cut)])
            np.bitwise_or.at(seen, ids >> 6, np.uint64(1) << (ids & np.uint32(63)).astype(np.uint64))


def no_bits() -> np.ndarray:
    return np.zeros(1 << (SEEN_BITS - 6), np.uint64)


@dataclass
class Model:
    """``table``: a column of logits for each of ``langs``, then 1; ``seen``: the bits of subwords that training saw."""

    langs: list[str]
    table: np.ndarray
    seen: np.ndarray | None = None
    temperature: float = 1.0
    least_score: float = 0.0
    least_seen: float = 0.0
    #: Shares rejected of the calibration rows, and of these with their letters shuffled.
    rejects: float = 0.0
    rejects_noise: float = 0.0

    def scores(self, total: np.ndarray) -> np.ndarray:
        k = len(self.langs)
        logits = total[:, :k] / np.maximum(total[:, k : k + 1], 1) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which texts are rejected."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        total, lettered = sums(texts, self.table, self.seen)
        p = self.scores(total)
        best, score = p.argmax(axis=1), np.where(lettered, p.max(axis=1), 0.0)
        rejected = ~lettered | (score < self.least_score)
        if self.seen is not None:
            rejected |= shares(total) < self.least_seen
        return [self.langs[b] if x else UND for b, x in zip(best, lettered)], score, rejected


def shares(total: np.ndarray) -> np.ndarray:
    """Of each text's subwords the share that training has seen, from ``sums`` with those counted."""
    return total[:, -1] / np.maximum(total[:, -2], 1)


def floor(values: np.ndarray) -> float:
    """The value below which SPARED of sound rows lie, from calibration rows' ``values`` of at most 1.

    Of fewer than 1/SPARED rows none is that rare, and the lowest tenth, taken as an
    exponential tail, is drawn out to it, or to the least of them if that is lower.
    """
    values = np.sort(values)
    if SPARED * len(values) >= 1:
        return float(values[int(SPARED * len(values))])
    k = max(1, len(values) // 10)
    edge = values[min(k, len(values) - 1)]
    return float(min(values[0], edge - (edge - values[:k]).mean() * np.log(k / len(values) / SPARED)))


def crc_fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(3))


def drawn(docs: DataFrame, usable: Column, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, int]:
    """Labelled rows drawn by a hash, written: lang, h and text; and the most rows to collect.

    A language's rows are those whose hash is below a bound that lets about
    ``rows`` through; half as many again are the most that are taken.
    """
    spark = docs.sparkSession
    labelled = docs.filter(F.col(f"`{lang_col}`").isNotNull() & usable).select(F.col(f"`{lang_col}`").alias("lang"), F.abs(F.xxhash64(F.lit("language sample"), F.col(f"`{id_col}`")) % (1 << 30)).alias("h"), F.col(f"`{text_col}`").alias("text"))
    counts = labelled.groupBy("lang").count().collect()
    rows = min(rows, max(1, SAMPLE_IN_ALL // max(1, len(counts))))
    bounds = spark.createDataFrame([(r["lang"], min(1 << 30, -(-rows * (1 << 30) // r["count"]))) for r in counts], "lang string, below bigint")
    bounds = F.broadcast(bounds) if len(counts) <= SAMPLE_IN_ALL else bounds
    return written(labelled.join(bounds, "lang").filter("h < below").select("lang", "h", "text"), "language-sample"), rows * 3 // 2 * max(1, len(counts))


def sample(some: DataFrame, most: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """The drawn rows ``some``, ``most`` at most: (lang, hash, buckets, counts), in a fixed order."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bins = [histogram(t) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(b) for b in bins]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([b[a].astype("<u4").tobytes() for a, b in zip(at, bins)], pa.binary())], ["lang", "h", "at", "n"])

    order = ["h", "lang", F.xxhash64("at", "n")]
    got = written(some.mapInArrow(features, "lang string, h bigint, at binary, n binary"), "language-histograms")
    sizes = got.select("h", (F.octet_length("at") + F.octet_length("n")).alias("size")).orderBy("h").toArrow()
    fit = int(np.searchsorted(np.cumsum(sizes["size"].to_numpy()), SAMPLE_BYTES, "right"))
    rows = got.orderBy(*order).limit(min(most, max(1, fit))).collect()
    return [(r["lang"], r["h"], np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u4")) for r in rows]


def seen_bits(texts: DataFrame) -> np.ndarray:
    """The bits of all subwords of the column text: a task's bits are combined by a shuffle of words of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = no_bits()
        for batch in slices(batches, "text"):
            mark(batch.column("text").to_pylist(), own)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], ["at", "bits"])

    got = texts.select("text").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = no_bits()
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _seen_shares(texts: DataFrame, model: Model, most: int) -> np.ndarray:
    """The share of seen subwords of each text with a letter."""
    held = texts.sparkSession.sparkContext.broadcast(model.seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.ones((BUCKETS, 1), np.float32)
        for batch in slices(batches, "text"):
            total, lettered = sums(batch.column("text").to_pylist(), one, held.value)
            yield pa.RecordBatch.from_arrays([pa.array(shares(total)[lettered & (total[:, 0] > 0)])], ["share"])

    return texts.select("text").mapInArrow(run, "share double").limit(most).toArrow()["share"].to_numpy()


def shuffled(text: str | None) -> str | None:
    """The text with its letters dealt anew to the letters' places: of no language, in the same script."""
    if not text:
        return text
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").copy()
    at = np.flatnonzero(letters()[codes])
    codes[at] = np.random.default_rng(len(codes)).permutation(codes[at])
    return codes.tobytes().decode("utf-32-le", "replace")


def _rates(texts: DataFrame, model: Model) -> tuple[float, float]:
    """The shares of ``texts`` that the model rejects, as they are and with their letters shuffled."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            given = [t for t in batch.column("text").to_pylist() if t]
            own, noise = (held.value.predict(x)[2].sum() for x in (given, [shuffled(t) for t in given])) if given else (0, 0)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(given), int(own), int(noise))], ["n", "own", "noise"])

    n, own, noise = texts.select("text").mapInArrow(run, "n bigint, own bigint, noise bigint").agg(F.sum("n"), F.sum("own"), F.sum("noise")).first()
    return (own / n, noise / n) if n else (0.0, 0.0)


def train(rows: list[tuple[str, int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """Fit embeddings and softmax by stochastic gradient descent, then calibrate."""
    rows = [r for r in rows if len(r[2])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32))
    kept_out = [r for r in rows if r[1] % KEPT_OUT == 0]
    fit = [r for r in rows if r[1] % KEPT_OUT] or rows
    rng = np.random.default_rng(seed)
    embed, weigh = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(langs)))
    share = {x: len(fit) / (len(langs) * max(1, sum(r[0] == x for r in fit))) for x in langs}
    steps = epochs * len(fit)
    for epoch in range(epochs):
        for k, j in enumerate(rng.permutation(len(fit))):
            lang, _, at, n = fit[j]
            x = n / n.sum()
            hidden = x @ embed[at]
            logits = hidden @ weigh
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[langs.index(lang)] -= 1
            now = rate * min(3.0, share[lang]) * (1 - (epoch * len(fit) + k) / steps)
            back = weigh @ p
            weigh -= now * np.outer(hidden, p)
            embed[at] -= now * len(at) * x[:, None] * back[None, :] * 0.1
    model = Model(langs, np.column_stack([embed @ weigh, np.ones(BUCKETS)]).astype(np.float32))
    _calibrate(model, kept_out or fit)
    return model


def _calibrate(model: Model, rows: list[tuple[str, int, np.ndarray, np.ndarray]]) -> None:
    total = np.stack([n @ model.table[at].astype(np.float64) for _, _, at, n in rows])
    truth = np.array([model.langs.index(r[0]) if r[0] in model.langs else -1 for r in rows])
    total, truth = total[truth >= 0], truth[truth >= 0]
    if not len(truth):
        return
    grid = np.geomspace(0.05, 20, 121)
    loss = []
    for model.temperature in grid:
        loss.append(-np.log(np.maximum(model.scores(total)[np.arange(len(truth)), truth], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    model.least_score = floor(model.scores(total).max(axis=1))


def fit(docs: DataFrame, usable: Column | None = None, rows: int = SAMPLE, **columns) -> Model:
    """A model learned from rows with a label, of those that ``usable`` allows."""
    some, most = drawn(docs, F.lit(True) if usable is None else usable, rows, **columns)
    model = train(sample(some, most))
    if model.langs:
        kept_out = F.col("h") % KEPT_OUT == 0
        # As in training: with no row left to learn from, all are learned from; with none kept out, those calibrate.
        learned = some.filter(~kept_out)
        learned = some if learned.isEmpty() else learned
        model.seen = seen_bits(learned)
        share = _seen_shares(some.filter(kept_out), model, most)
        share = share if len(share) else _seen_shares(learned, model, most)
        model.least_seen = floor(share) if len(share) else 0.0
        model.rejects, model.rejects_noise = _rates(some.filter(kept_out), model)
    return model


def verdicts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: row (a struct of all its columns), lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            langs, score, rejected = held.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    out = docs.toDF(*names).mapInArrow(run, schema)
    return out.select(F.struct(*(F.col(n).alias(c) for n, c in zip(names, docs.columns))).alias("row"), "lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of those names in ``docs`` are replaced."""
    new = ("lang_pred", "score", "rejected")
    return verdicts(docs, model, text_col).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new), *new)
