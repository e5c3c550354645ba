"""Quality rules (operator 9): base rules, then robust multivariate outliers.

Everything is DataFrame expressions.  A text's statistics come from arrays within its
row; nothing is exploded or shuffled but the resulting numbers.

The verdict is by minimum covariance determinant.  The statistics are transformed
(VECTOR), shares of words with SMOOTH words added so that short texts vary no more than
long ones, in units of 1/SCALE so that sums are exact and reruns agree.  For every
(language, source), every language and the whole table, all rows that pass the base
rules take part:

1. Medians and median deviations (by histogram) standardise the rows, and give three
   starts: deviations alone, the correlation of hyperbolic tangents, and the
   covariance of directions.
2. A concentration step takes the HALF of rows nearest by Mahalanobis distance, and
   their mean and covariance anew, with a consistency factor for the tails left out.
   Each start gets FIRST steps, and the one of least determinant goes on until its
   determinant falls by no more than SETTLED.  Less than half of a group's rows,
   however alike, cannot make up its estimate.
3. An estimate is drawn towards that of its language, and this towards that of all
   rows, as if PRIOR rows had come from there; so no size of a group is a switch.

A row is judged by its (language, source), and is rejected if its squared distance is
above the 1 - CUT quantile of chi-squared.  A spread has a floor, given the statistics
before it: one that most texts share exactly (no repeated line, say) does not make each
exception an outlier.

Each step is an aggregate with map-side combining over the table of numbers, by group
and by bins of the distance, so a group with a third of all rows is no task's burden.

Defined results: a null text has no words; null languages and sources are values of
their own; wordless and base-failed texts take no part in the estimates; repeated
rows give repeated results; an empty table gives no rows; other columns are not
passed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, whole_text, written

#: Words of a window whose repetition counts; least words; most percent of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Fixed by the contract: characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Units of the transformed statistics; the share of rows that the estimates rest on.
SCALE, HALF = 1024, 0.5
#: Steps of each start, and of the best one at most; the least fall of the determinant's logarithm that is worth another.
FIRST, STEPS, SETTLED = 2, 20, 0.001
#: Rows that a group's estimate takes from the coarser group's.
PRIOR = 100
#: The transformed statistics, and floors of their spread; words added to shares, and characters of a word.
VECTOR, FLOORS = ("length", "word_length", "symbols", "dup_lines", "repeats"), (1.0, 0.1, 0.5, 0.5, 0.25)
SMOOTH, WORD_CHARS = 20, 5
#: The chance that a sound row of normal statistics is rejected.
CUT = 1e-4
#: Medians are by 1/64, squared distances by 1/16 octave.
BINS, OCTAVE = 64, 16


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = whole_text(f"`{text_col}`")
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    passed = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(
        *passed,
        let(words, counted).alias("_w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(*passed, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words in windows that occur twice or more: windows are hashed, equal ones found by sorting."""
    none = F.lit(0).cast("long")
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(*(F.get(words, i + k - 1) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        same = lambda s, i, j: F.get(s, j)["h"].eqNullSafe(F.get(s, i)["h"])
        again = let(placed, lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(s, i, i - 1) | same(s, i, i + 1), x["at"])), lambda at: at.isNotNull()))
        # In order of place, each window adds what the next does not.
        added = let(F.sort_array(again), lambda p: F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW)))))
        return F.aggregate(added, none, lambda total, n: total + n)

    return F.when(F.size(words) <= WINDOW, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector() -> list[Column]:
    words, more = F.greatest(F.col("n_words"), F.lit(1)), F.col("n_words") + SMOOTH
    raw = (F.log(words), F.log((F.col("word_chars") + SMOOTH * WORD_CHARS) / more), F.log1p(100 * F.col("n_symbols") / more), F.log1p(F.col("n_dup_lines")), F.log1p(100 * F.col("n_repeat_words") / more) / 3)
    return [F.rint(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def chi_squared(d: int, at: float) -> float:
    """The distribution function of chi-squared with d degrees of freedom (a series)."""
    a, x = d / 2, at / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x else 0.0


def quantile(d: int, below: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(d, mid) < below else (low, mid)
    return (low + high) / 2


def _keys() -> Column:
    """The groups of a row, the finest first."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.array(F.concat_ws("\x1f", F.lit("2"), part("lang"), part("source")), F.concat_ws("\x1f", F.lit("1"), part("lang")), F.lit("0"))


P = len(VECTOR)
#: Places of a covariance's lower half.
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
MEAN, SPREAD, FACTOR = [f"m_{i}" for i in range(P)], [f"s_{i}_{j}" for i, j in LOWER], [f"l_{i}_{j}" for i, j in LOWER]


def _inverse(df: DataFrame) -> DataFrame:
    """Adds l_i_j, the inverse of the lower Cholesky factor of the covariance s_i_j (i >= j), and its log determinant.

    What is left of a variance, given the statistics before, is FLOORS squared at least.
    """
    c = F.col
    for j in range(P):
        below = sum((c(f"g_{j}_{k}") * c(f"g_{j}_{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"g_{j}_{j}", F.sqrt(F.greatest(c(f"s_{j}_{j}") - below, F.lit(FLOORS[j] ** 2))))
        for i in range(j + 1, P):
            cross = sum((c(f"g_{i}_{k}") * c(f"g_{j}_{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"g_{i}_{j}", (c(f"s_{i}_{j}") - cross) / c(f"g_{j}_{j}"))
    for i in range(P):
        df = df.withColumn(f"l_{i}_{i}", 1 / c(f"g_{i}_{i}"))
    for j in range(P):
        for i in range(j + 1, P):
            inner = sum((c(f"g_{i}_{k}") * c(f"l_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            df = df.withColumn(f"l_{i}_{j}", -inner / c(f"g_{i}_{i}"))
    return df.withColumn("logdet", sum((2 * F.log(f"g_{i}_{i}") for i in range(P)), F.lit(0.0)))


def _moments(x: list[Column]) -> list[Column]:
    """Exact sums of integers ``x`` and of their products, and the count."""
    return [F.count(F.lit(1)).alias("chosen"), *(F.sum(v).alias(f"a_{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"b_{i}_{j}") for i, j in LOWER)]


def _distance() -> Column:
    """The squared Mahalanobis distance of x_i under m_i and l_i_j."""
    c = F.col
    off = [c(f"x{i}") / SCALE - c(f"m_{i}") for i in range(P)]
    return sum((F.pow(sum((c(f"l_{i}_{j}") * off[j] for j in range(i + 1)), F.lit(0.0)), 2) for i in range(P)), F.lit(0.0))


def _median(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each key n and the least bin with at least half of the rows at or below it."""
    counts = df.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy(*keys)
    running = counts.withColumn("n", F.sum("k").over(whole)).withColumn("below", F.sum("k").over(whole.orderBy("bin")))
    return running.filter(2 * F.col("below") >= F.col("n")).groupBy(*keys).agg(F.max("n").alias("n"), F.min("bin").alias("bin"))


def _starts(rows: DataFrame) -> DataFrame:
    """key, start, n, mean, covariance, inverse factor and log determinant of each group's three starts."""
    c = F.col
    long = rows.select("key", F.posexplode(F.array(*(c(f"x{i}") for i in range(P)))).alias("i", "x"))
    center = _median(long.withColumn("bin", F.floor(c("x") * BINS / SCALE)), ["key", "i"]).withColumn("center", (c("bin") + 0.5) * SCALE / BINS).select("key", "i", "n", "center")
    center = written(center, "centers")
    off = long.join(_few(center), ["key", "i"]).withColumn("bin", F.floor(F.abs(c("x") - c("center")) * BINS / SCALE))
    spread = _median(off, ["key", "i"]).select("key", "i", ((c("bin") + 0.5) / BINS * 1.4826).alias("spread"))
    of = lambda name, i: F.max(F.when(c("i") == i, c(name)))
    scale = [F.greatest(of("spread", i), F.lit(FLOORS[i])).alias(f"d_{i}") for i in range(P)]
    base = written(center.join(spread, ["key", "i"]).groupBy("key").agg(F.max("n").alias("n"), *((of("center", i) / SCALE).alias(f"m_{i}") for i in range(P)), *scale), "scales")
    z = [(c(f"x{i}") / SCALE - c(f"m_{i}")) / c(f"d_{i}") for i in range(P)]
    scaled = rows.join(_few(base), "key").select("key", *(v.alias(f"z{i}") for i, v in enumerate(z)))
    size = F.greatest(F.sqrt(sum((c(f"z{i}") * c(f"z{i}") for i in range(P)), F.lit(0.0))), F.lit(1e-9))
    whole = lambda v: F.rint(v * SCALE).cast("long")
    tanh = scaled.select("key", *(whole(F.tanh(f"z{i}")).alias(f"z{i}") for i in range(P)), *(whole(c(f"z{i}") / size).alias(f"u{i}") for i in range(P)))
    sums = tanh.groupBy("key").agg(*_moments([c(f"z{i}") for i in range(P)]), *(F.sum(c(f"u{i}") * c(f"u{j}")).alias(f"u_{i}_{j}") for i, j in LOWER))
    both = base.join(sums, "key")
    cov = lambda i, j: c(f"b_{i}_{j}") / c("chosen") - c(f"a_{i}") / c("chosen") * c(f"a_{j}") / c("chosen")
    own = lambda i: F.sqrt(F.greatest(cov(i, i), F.lit(1.0)))
    shape = [
        lambda i, j: F.lit(float(i == j)),
        lambda i, j: F.lit(1.0) if i == j else cov(i, j) / own(i) / own(j),
        lambda i, j: P * c(f"u_{i}_{j}") / c("chosen") / SCALE / SCALE,
    ]
    starts = [both.select("key", F.lit(k).alias("start"), "n", *MEAN, *((c(f"d_{i}") * c(f"d_{j}") * f(i, j)).alias(f"s_{i}_{j}") for i, j in LOWER)) for k, f in enumerate(shape)]
    return written(_inverse(starts[0].union(starts[1]).union(starts[2])).select("key", "start", "n", *MEAN, *SPREAD, *FACTOR, "logdet"), "starts")


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The estimates after one concentration step of all groups and starts."""
    c = F.col
    far = rows.join(_few(now.select("key", "start", *MEAN, *FACTOR)), "key").select("key", "start", *(f"x{i}" for i in range(P)), F.floor(F.log2(_distance() + 1e-9) * OCTAVE).alias("bin"))
    sums = far.groupBy("key", "start", "bin").agg(*_moments([c(f"x{i}") for i in range(P)]))
    whole = Window.partitionBy("key", "start")
    running = sums.withColumn("n", F.sum("chosen").over(whole)).withColumn("below", F.sum("chosen").over(whole.orderBy("bin")))
    # The bins nearest to the centre, up to the one in which the half is reached.
    near = running.filter(c("below") - c("chosen") < F.ceil(c("n") * HALF)).groupBy("key", "start").agg(F.max("n").alias("n"), *(F.sum(x).alias(x) for x in ["chosen", *(f"a_{i}" for i in range(P)), *(f"b_{i}_{j}" for i, j in LOWER)]))
    mean = lambda i: c(f"a_{i}") / c("chosen") / SCALE
    factor = HALF / chi_squared(P + 2, quantile(P, HALF))
    spread = [(factor * (c(f"b_{i}_{j}") / c("chosen") / SCALE / SCALE - mean(i) * mean(j))).alias(f"s_{i}_{j}") for i, j in LOWER]
    return _inverse(near.select("key", "start", "n", *(mean(i).alias(f"m_{i}") for i in range(P)), *spread)).select("key", "start", "n", *MEAN, *SPREAD, *FACTOR, "logdet")


def _least(df: DataFrame) -> DataFrame:
    """Of each key the estimate of least determinant (of equal ones, the first start's)."""
    names = [x for x in df.columns if x != "key"]
    best = F.min(F.struct("logdet", "start", *(x for x in names if x not in ("logdet", "start")))).alias("best")
    return df.groupBy("key").agg(best).select("key", *(f"best.{x}" for x in names))


def estimates(rows: DataFrame) -> DataFrame:
    """A row for each group: key, n, mean, covariance, inverse factor and log determinant.

    ``rows`` has key and x0.. for each row and each of its groups.
    """
    now = _starts(rows)
    for step in range(FIRST):
        now = written(_step(rows, now), f"first-{step}")
    now = written(_least(now), "best-start")
    for step in range(STEPS):
        old = now.select(F.col("key").alias("old"), F.col("logdet").alias("before"))
        # Written, or the comparison of determinants would have their whole expressions in it.
        then = written(_step(rows, now), f"then-{step}")
        better = written(then.join(_few(old), then["key"] == old["old"]).filter(F.col("logdet") < F.col("before") - SETTLED).drop("old", "before"), f"step-{step}")
        if better.isEmpty():
            break
        # An estimate that has settled stays as it is, whatever other groups do.
        now = written(_least(now.join(_few(better.select("key")), "key", "left_anti").unionByName(better)), f"now-{step}")
    return now


def _drawn(own: DataFrame, coarse: DataFrame) -> DataFrame:
    """Estimates ``own`` (key, up, n, mean, covariance) drawn towards ``coarse`` (key), of which PRIOR rows are added."""
    c = F.col
    w = c("n") / (c("n") + PRIOR)
    names = [*MEAN, *SPREAD]
    other = coarse.select(c("key").alias("up"), *(c(x).alias(f"c_{x}") for x in names))
    between = lambda i, j: w * (1 - w) * (c(f"m_{i}") - c(f"c_m_{i}")) * (c(f"m_{j}") - c(f"c_m_{j}"))
    mixed = lambda x: w * c(x) + (1 - w) * c(f"c_{x}")
    out = own.join(_few(other), "up")
    return out.select("key", *(mixed(x).alias(x) for x in MEAN), *((mixed(f"s_{i}_{j}") + between(i, j)).alias(f"s_{i}_{j}") for i, j in LOWER))


#: Groups whose estimates may be broadcast: of about 500 bytes each.
BROADCAST_GROUPS = 20_000


def _few(table: DataFrame) -> DataFrame:
    """``table`` (a row for each group), to be broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def judges(sound: DataFrame) -> DataFrame:
    """key (of a language and source), mean and inverse factor by which its rows are judged.

    ``sound`` has keys (the finest first) and x0.. of each row that passes the base rules.
    """
    found = estimates(sound.select(F.explode("keys").alias("key"), *(f"x{i}" for i in range(P))))
    groups = written(sound.select(*(F.get("keys", F.lit(i)).alias(f"k{i}") for i in range(3))).distinct(), "groups")
    own = lambda key, up: found.join(groups.select(F.col(key).alias("key"), F.col(up).alias("up")).distinct(), "key")
    langs = written(_drawn(own("k1", "k2"), found), "languages")
    return written(_inverse(_drawn(own("k0", "k1"), langs)).select("key", *MEAN, *FACTOR), "judges")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the statistics, base_failed, distance and kept."""
    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    stats = statistics(given).withColumn("base_failed", base_failed())
    stats = written(stats.select("*", *_vector(), _keys().alias("keys")), "statistics")
    by = judges(stats.filter(~F.col("base_failed")).select("keys", *(f"x{i}" for i in range(P))))
    out = stats.withColumn("key", F.get("keys", F.lit(0))).join(_few(by), "key", "left")
    distance = _distance()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= quantile(P, 1 - CUT), F.lit(False))).alias("kept"))
