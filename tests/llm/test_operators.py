"""Each operator against a brute-force version, and on odd rows."""

import hashlib
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import brute

from shutterlake.llm import exact_dedup, language_id, mixing, packing, quality_rules, queries, simhash, token_counts, token_ids

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \t\n\x0b\x0c\r ", "de", None, 7),
    (4, "One two\x1cthree four\x85five six ten", "en", "a", 5),
    (4, "One two\x1cthree four\x85five six ten", "en", "a", 5),
    (5, "oNE TWO\x1cthree four\x85five six TEN", None, "b", 5),
    (None, "no id here <|endoftext|> but words", "en", "b", 3),
    (None, None, None, None, None),
    (7, LONG, "fr", "a", 1),
    (8, LONG + " more", "fr", None, 1),
    (9, "É école ÉCOLE ß İ Σς don't 12 345", "fr", "a", 1),
    (10, "É École éCOLE", "fr", "a", 1),
    (11, "a b c d e a b c d e f\na b c d e\n\n  \na b c d e", "en", "c", 1),
    (12, "日本語 テキスト   a b  c", None, "c", 1),
    (13, "##### $$$ %%% ||", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a further column whose names clash."""
    return spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit("x")).withColumn("key", F.lit("y")).withColumn("score", F.lit(1)).withColumn("digest", F.lit("z")).withColumn("C0", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_token_counts(docs, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, odd, empty):
        want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False)), len(library.encode(t or "", add_special_tokens=False)) > 2048) for d, t in texts(df))
        got = token_counts.count_tokens(df, path)
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want
        assert set(df.columns) - {"text"} <= set(got.columns)


def test_frequent_pretokens_cover_all_rows(docs):
    counts = Counter(w for _, t in texts(docs) for w in (t or "").encode().split())
    assert token_counts.frequent_pretokens(docs)[:5] == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]]


def test_frequent_pretokens_through_a_tree(docs, monkeypatch):
    want = token_counts.frequent_pretokens(docs)
    monkeypatch.setattr(token_counts, "MERGED", 3)
    got = token_counts.frequent_pretokens(docs.repartition(20))
    assert got[:20] == want[:20] and len(got) <= token_counts.FREQUENT
    plan = docs.sparkSession.conf.get("spark.sql.adaptive.enabled")
    assert plan in ("true", "false") and token_counts.frequent_pretokens(docs.limit(0)) == []


RUNS = {"blanks": " " * 2_000_000, "newlines": "\n" * 2_000_000, "inside": "x" + " " * 1_000_000 + "y", "kinds": "ab\t" + " \n" * 600_000 + "\u3000end of it", "letters": "a" * 300_000, "ideographs": " 日本語" * 3 + "日本語" * 60_000 + "\n\n x", "ends": "word" + " " * 5000 + "  " + "z" * 5000 + " " * 4096 + "\n"}


@pytest.mark.parametrize("name", RUNS)
def test_token_ids_of_long_runs(name):
    """Equal to the library's, and within seconds."""
    import time

    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    own, text = token_ids.Encoder(token_ids.tokenizer_text(path)), RUNS[name]
    began = time.time()
    got = own.ids(text)
    assert time.time() - began < 10
    assert got.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_operators_on_long_runs(spark, tmp_path):
    """Two million blanks or newlines are no more work than other texts of that size."""
    import time

    path = queries.tokenizer("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, RUNS["blanks"]), (2, RUNS["newlines"]), (3, RUNS["inside"])], "doc_id bigint, text string")
    n = {d: len(token_ids.Encoder(token_ids.tokenizer_text(path)).ids(t)) for d, t in texts(df)}
    from shutterlake.llm import token_output

    for run in (
        lambda: packing.pack_documents(df, path).groupBy("doc_id").agg(F.sum("length").alias("n")),
        lambda: token_output.write_shards(df, path, f"file://{tmp_path}/runs"),
        lambda: quality_rules.statistics(df),
    ):
        began = time.time()
        got = run().collect()
        assert time.time() - began < 40
        if "n" in got[0]:
            assert {r["doc_id"]: r["n"] - 1 for r in got} == n


def test_token_ids_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_ids.Encoder(token_ids.tokenizer_text(path))
    assert own.fast is not None
    for _, t in texts(docs) + [(0, x[1]) for x in ODD if x[1]] + [(0, "a<|endoftext|>\n\n  b 　 c\x1c\x85\xa0  d")]:
        assert own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def same_text(t):
    return hashlib.sha256((t or "").translate(brute.LOWER).encode()).hexdigest()


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_exact_dedup(which, request, spark):
    df = request.getfixturevalue(which)
    groups = defaultdict(list)
    for d, t in texts(df):
        groups[same_text(t)].append(d)
    keep = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    got = exact_dedup.membership(df, exact_dedup.DigestIndex(spark)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == Counter((d, keep[k], len(v), d == keep[k], k) for k, v in groups.items() for d in v)
    left = exact_dedup.survivors(df, exact_dedup.DigestIndex(spark))
    assert left.columns == df.columns
    assert Counter((r["doc_id"], same_text(r["text"])) for r in left.collect()) == Counter((keep[k], k) for k in groups)


def test_digest_index_persists(spark, docs):
    from shutterlake.workspace import clear

    place = f"/tmp/checkpoints/test-index-{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, place)
    first, second = docs.filter("doc_id % 2 = 0"), docs
    exact_dedup.survivors(first, index)
    clear()  # as at the end of a session: the catalog forgets the tables
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_run_")]
    index = exact_dedup.DigestIndex(spark, place)
    known = {same_text(t) for _, t in texts(first)}
    assert index.rows().count() == len(known)
    added = exact_dedup.survivors(second, index)
    assert {same_text(t) for _, t in texts(added)} == {same_text(t) for _, t in texts(docs)} - known
    assert index.rows().count() == index.rows().select("digest").distinct().count() == len({same_text(t) for _, t in texts(docs)})
    again = exact_dedup.membership(docs, index)
    assert again.filter("kept").count() == 0


def test_digest_indexes_of_one_last_name_are_two(spark, docs):
    top = f"/tmp/checkpoints/test-index-{uuid.uuid4().hex}"
    one, two = (exact_dedup.DigestIndex(spark, f"{top}/{x}/index") for x in ("en", "de"))
    n = exact_dedup.survivors(docs, one).count()
    assert two.rows().count() == 0 and exact_dedup.survivors(docs, two).count() == n == two.rows().count()


def test_digest_index_batch_run_again(spark, docs):
    """A batch run again by its name gets what it got, before and after the runs are merged; other batches do not."""
    index = exact_dedup.DigestIndex(spark)
    half = docs.filter("doc_id % 2 = 0")
    of = lambda df: Counter(map(tuple, df.collect()))
    old = exact_dedup.survivors(half, index, batch="a").count()
    want = of(exact_dedup.membership(docs, index, batch="b"))
    rows = index.rows().count()
    assert of(exact_dedup.membership(docs, index, batch="b")) == want and index.rows().count() == rows
    index.merge()
    assert of(exact_dedup.membership(docs, index, batch="b")) == want and index.rows().count() == rows
    assert exact_dedup.survivors(half, index, batch="a").count() == old
    assert index.rows().count() == rows == index.rows().select("digest").distinct().count()
    assert exact_dedup.membership(docs, index, batch="c").filter("kept").count() == 0


def test_digest_index_of_many_appends(spark, docs):
    """Runs are merged; a bucket is one file; the index is neither shuffled nor sorted."""
    index = exact_dedup.DigestIndex(spark)
    for k in range(7):
        exact_dedup.survivors(docs.filter(F.col("doc_id") % 7 == k), index)
        assert len(index.state["runs"]) <= exact_dedup.RUNS
    assert index.rows().count() == len({same_text(t) for _, t in texts(docs)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for buckets in (index.buckets, 4):
            spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
            groups = docs.select(exact_dedup.digest().alias("digest")).distinct()
            plan = index.unknown(groups)._jdf.queryExecution().executedPlan().toString()
            joins = plan.count("SortMergeJoin")
            assert joins == len(index.state["runs"]) > 1
            assert plan.count("Bucketed: true") == joins
            assert plan.count("Sort [") == 1 and plan.count("Exchange") <= 1 + (buckets != index.buckets)  # of the batch
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_language_id_held_out(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, sf_dir).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [d for d, r in got.items() if r["held_out"]]
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for r in got.values()) <= 0.02 * len(got)


def test_language_id_odd(spark, docs, odd, empty):
    model = language_id.fit(docs, queries.language_fold())
    got = language_id.identify(odd, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or (r["rejected"] and r["score"] == 0))
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty, queries.language_fold())
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}
    found = dict(zip(["fr", "und"], zip(*model.predict(["Привет мир как дела сегодня", "12"]))))
    assert all(x[2] for x in found.values())


def test_language_id_rejects_what_a_full_sample_has_not_taught(spark, sf_dir):
    """Two languages learned from a full sample; another Latin-script language and other scripts are rejected."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter("lang IN ('en', 'fr')"), queries.language_fold())
    assert model.langs == ["en", "fr"] and model.least_score > 1 / 2
    held = docs.filter(~queries.language_fold()).filter("length(text) >= 40").orderBy("doc_id").limit(1500).collect()
    rejected = lambda some: sum(model.predict(some)[2]) / len(some)
    for lang in ("en", "fr"):
        assert rejected([r["text"] for r in held if r["lang"] == lang]) <= 0.02
    for lang in ("de", "es"):
        assert rejected([r["text"] for r in held if r["lang"] == lang]) >= 0.95
    for base in (0x3B1, 0x430, 0x5D0):  # Greek, Cyrillic, Hebrew
        script = str.maketrans({chr(97 + i): chr(base + i % 24) for i in range(26)})
        assert rejected([r["text"].lower().translate(script) for r in held[:300]]) >= 0.95


def plain_prediction(model, text):
    """The model's answer for one text, by loops over its subwords."""
    sums, n, seen = [0.0] * len(model.langs), 0, 0
    runs, now = [], []
    for c in text or "":
        if c.isalpha():
            now.append(ord(c.lower()[0]))
        else:
            runs.append(now)
            now = []
    for codes in [*runs, now]:
        padded = [0, *codes, 0] if codes else []
        for k in language_id.LENGTHS:
            for i in range(len(padded) - k + 1):
                h = k
                for code in padded[i : i + k]:
                    h = ((h ^ code) * 0x01000193) & 0xFFFFFFFF
                    h ^= h >> 15
                at = (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language_id.SEEN_BITS)
                row = model.table[at >> (language_id.SEEN_BITS - language_id.BITS)]
                sums = [a + float(b) for a, b in zip(sums, row)]
                n += 1
                seen += int(model.seen[at >> 6]) >> (at & 63) & 1
    if not any(runs) and not now:
        return "und", 0.0, True
    logits = [x / max(n, 1) / model.temperature for x in sums]
    e = [np.exp(x - max(logits)) for x in logits]
    score = max(e) / sum(e)
    return model.langs[int(np.argmax(logits))], score, bool(score < model.least_score or seen / max(n, 1) < model.least_seen)


def test_language_prediction_by_loops(docs):
    model = language_id.fit(docs, queries.language_fold())
    some = [t for _, t in texts(docs)][:60] + [x[1] for x in ODD if len(x[1] or "") < 1000] + ["a", "x y", "Ünï cödé"]
    langs, score, rejected = model.predict(some)
    for t, lang, s, r in zip(some, langs, score, rejected):
        want = plain_prediction(model, t)
        assert lang == want[0] and abs(s - want[1]) < 1e-4
        assert r == want[2] or abs(s - model.least_score) < 1e-4 or not t


def test_language_rates(spark, sf_dir):
    """The rates that the model states hold on texts that it has not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs, queries.language_fold())
    held = [r["text"] for r in docs.filter(~queries.language_fold()).filter("length(text) >= 40").orderBy("doc_id").limit(1500).collect()]
    share = lambda some: model.predict(some)[2].mean()
    assert model.rejects <= 0.005 and share(held) <= 0.005
    assert model.rejects_noise >= 0.9 and share([language_id.shuffled(t) for t in held]) >= 0.9


def test_language_of_many(spark, monkeypatch):
    """No bound on languages; the histograms on the driver are bounded in bytes."""
    rows = [(i, f"{chr(0x4E00 + 7 * (i % 450))}{chr(0x5000 + 7 * (i % 450))} " * 6, f"l{i % 450:03d}", "s", 1) for i in range(2700)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(language_id.fit(df, queries.language_fold()).langs) == 450
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 20_000)
    some, most = language_id.drawn(df, queries.language_fold())
    got = language_id.sample(some, most)
    assert 10 < len(got) < 2700 and sum(6 * len(at) for _, _, at, _ in got) <= 20_000


def test_language_pieces_do_not_depend_on_company(docs, monkeypatch):
    import numpy as np

    some = [t for _, t in texts(docs)][:40] + ["", None, "x", "ab", "a b"]
    table = np.random.default_rng(1).random((language_id.BUCKETS, 3))
    alone = np.concatenate([language_id.sums([t], table)[0] for t in some])
    assert np.allclose(language_id.sums(some, table)[0], alone)
    assert np.allclose([language_id.histogram(t) @ table for t in some], alone)
    monkeypatch.setattr(language_id, "PART", 64)
    assert np.allclose(language_id.sums(some, table)[0], alone)
    assert np.allclose([language_id.histogram(t) @ table for t in some], alone)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"], r["source"], len(brute.words(r["text"]))) for r in df.collect()]
    sizes = Counter()
    for _, _, s, n in rows:
        sizes[s] += n
    want = brute.targets(sizes)
    mix = mixing.Mix(df)
    got = mix.taken().collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, n) for d, _, _, n in rows)
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in got}) == sorted({(sizes[s], round(want[s], 6)) for s in want})
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    drawn = mix.rows(marked=True).collect()
    of = Counter()
    for r in drawn:
        of[r["source"]] += len(brute.words(r["text"]))
    assert sum(of.values()) == sum(r["taken"] for r in got)
    for s in want:
        together = Counter()
        for d, t, x, n in rows:
            together[(d, t)] += n * (x == s)
        sums = {0}
        for n in together.values():
            sums |= {x + n for x in sums}
        passes = min(3, int(want[s] // sizes[s])) if sizes[s] else 0
        best = min(abs(passes * sizes[s] + x - want[s]) for x in sums)
        assert abs(of[s] - want[s]) <= best + (passes < 3 and 1e-6)  # the nearest that whole rows allow
    units = Counter(mix.units["shard"].tolist())
    assert not units or (max(units.values()) - min(units.values()) <= 1 and len(units) == mix.shards)
    # What is taken is what the shards drew, and in those shards.
    of_shard = lambda rows: Counter((r["doc_id"], m) for r in rows for m in r["mix_shards"])
    assert of_shard(got) == Counter((r["doc_id"], r["mix_shard"]) for r in drawn)
    assert all(r["taken"] == r["size"] * len(r["mix_shards"]) for r in got)
    again = mixing.Mix(df.repartition(3))
    assert Counter(map(str, again.taken().collect())) == Counter(map(str, got))
    assert Counter(map(str, again.rows(marked=True).collect())) == Counter(map(str, drawn))


def test_mixing_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 20)
    monkeypatch.setattr(mixing, "BLOCKS", 60)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.repeat(F.lit(" v"), (F.col("id") % 7).cast("int"))).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    mix = mixing.Mix(df)
    got = mix.taken().join(df, "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 6
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in got)
    assert mix.shards > 5 and mix.rows().count() > 0
    per = mix.rows(marked=True).groupBy("doc_id", "mix_pass").count().filter("count > 1").count()
    assert per == 0
    held = mix.rows(marked=True).withColumn("at", F.spark_partition_id()).groupBy("at").agg(F.min("mix_shard").alias("a"), F.max("mix_shard").alias("b")).orderBy("at").collect()
    assert len(held) > 5 and all(x["b"] < y["a"] for x, y in zip(held, held[1:]))  # ranges of shards


def test_mixing_goes_through_the_tree(spark, docs, monkeypatch):
    """What is taken, and where, is what the tree has dealt out."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    want = mixing.Mix(docs).taken().select(F.explode("mix_shards").alias("m")).groupBy("m").count().collect()
    assert len(want) > 4
    tree = mixing.split
    monkeypatch.setattr(mixing, "split", lambda *node: [(0, x, c) for _, x, c in tree(*node)])
    got = mixing.Mix(docs).taken().select(F.explode("mix_shards").alias("m")).groupBy("m").count().collect()
    assert [r["m"] for r in got] == [0]
    monkeypatch.setattr(mixing, "split", lambda *a: [(0, np.empty(0, int), np.empty(0, int))])
    with pytest.raises(IndexError):  # no tree, no draws
        mixing.Mix(docs).taken()


def test_mixing_of_many_sources(spark):
    """No bound on sources: each takes its own target."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.repeat(F.lit(" v"), (F.col("id") % 3).cast("int"))).alias("text"), F.concat(F.lit("s"), F.col("id") % 3000).alias("source"))
    got = mixing.Mix(df).taken().join(df, "doc_id").groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("size")).collect()
    assert len(got) == 3000 and all(abs(r["taken"] - r["target"]) <= r["size"] for r in got)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    rows = texts(df)
    got = simhash.membership(df).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((d, f"{brute.simhash(t):016x}") for d, t in rows)
    known = [(d, t) for d, t in rows if d is not None]
    want = brute.simhash_components(known)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    left = simhash.survivors(df)
    assert left.columns == df.columns
    kept = [d for d, in left.select("doc_id").collect() if d is not None]
    assert sorted(kept) == sorted(set(want.values()))


def test_simhash_tiles(spark, monkeypatch):
    """Many near and equal fingerprints over many tiles: the same components as by all pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    prints = [int(b) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for b in base for _ in range(12)] + [0, -1, 1, 7, 15]
    prints = sorted(set(prints))
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), tile=16)
    assert links.count() <= len(prints) * 30
    from shutterlake.operators.graph import components

    got = {r["node"]: r["root"] for r in components(links).collect()}
    x = np.array(prints, np.int64).view(np.uint64)
    root = brute.classes(len(prints), zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)))
    assert [got.get(p, p) for p in prints] == [prints[r] for r in root]


def test_components_of_a_path_and_a_star(spark):
    from shutterlake.operators.graph import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 300)] + [(5, 5)] + [(-3, -2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)} | {-3: -3, -2: -3}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_quality_statistics(which, request):
    df = request.getfixturevalue(which)
    got = quality_rules.judged(df).collect()
    want = Counter()
    for d, t in texts(df):
        q = brute.quality(t)
        failed = q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"]
        want[(d, *q.values(), failed)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def mcd_of(x):
    """The estimate of one group, in numpy: (mean, covariance)."""
    q = quality_rules
    p, floors = 5, np.array(q.FLOORS)

    def mid(v):
        bins = np.sort(np.floor(v * q.BINS))
        return (bins[-(-len(bins) // 2) - 1] + 0.5) / q.BINS

    def factor(cov):
        g = np.zeros((p, p))
        for j in range(p):
            g[j, j] = np.sqrt(max(cov[j, j] - g[j, :j] @ g[j, :j], floors[j] ** 2))
            for i in range(j + 1, p):
                g[i, j] = (cov[i, j] - g[i, :j] @ g[j, :j]) / g[j, j]
        return g

    def distance(x, m, cov):
        return (np.linalg.solve(factor(cov), (x - m).T) ** 2).sum(axis=0)

    def logdet(cov):
        return 2 * np.log(np.diag(factor(cov))).sum()

    def step(m, cov):
        bins = np.floor(np.log2(distance(x, m, cov) + 1e-9) * q.OCTAVE)
        near = x[bins <= np.sort(bins)[int(np.ceil(len(x) * q.HALF)) - 1]]
        return near.mean(axis=0), q.HALF / q.chi_squared(p + 2, q.quantile(p, q.HALF)) * np.cov(near.T, bias=True).reshape(p, p)

    mcd_of.distance = distance
    m = np.array([mid(x[:, i]) for i in range(p)])
    d = np.maximum([mid(np.abs(x[:, i] - m[i])) * 1.4826 for i in range(p)], floors)
    z = (x - m) / d
    t = np.rint(np.tanh(z) * q.SCALE)
    u = np.rint(z / np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-9)[:, None] * q.SCALE) / q.SCALE
    cov = np.cov(t.T, bias=True).reshape(p, p)
    own = np.sqrt(np.maximum(np.diag(cov), 1))
    corr = cov / np.outer(own, own)
    np.fill_diagonal(corr, 1)
    tried = []
    for k, shape in enumerate((np.eye(p), corr, p * u.T @ u / len(u))):
        now = (m, shape * np.outer(d, d))
        for _ in range(q.FIRST):
            now = step(*now)
        tried.append((logdet(now[1]), k, now))
    least, _, now = min(tried, key=lambda x: x[:2])
    for _ in range(q.STEPS):
        then = step(*now)
        if logdet(then[1]) >= least - q.SETTLED:
            break
        least, now = logdet(then[1]), then
    return now


def test_quality_verdict_against_numpy(spark, docs):
    """Estimates of each language and source, drawn to the coarser ones, and the verdicts, by numpy."""
    q = quality_rules
    stats = q.statistics(docs.select("doc_id", "lang", "source", "text")).withColumn("base_failed", q.base_failed()).select("*", *q._vector()).collect()
    rows = [r for r in stats if not r["base_failed"]]
    x = np.array([[r[f"x{i}"] for i in range(5)] for r in rows]) / q.SCALE
    judged = {r["doc_id"]: r for r in q.judged(docs).collect()}

    def drawn(own, n, coarse):
        w = n / (n + q.PRIOR)
        off = own[0] - coarse[0]
        return w * own[0] + (1 - w) * coarse[0], w * own[1] + (1 - w) * coarse[1] + w * (1 - w) * np.outer(off, off)

    everything, checked = mcd_of(x), 0
    for lang in {r["lang"] for r in rows}:
        some = np.array([r["lang"] == lang for r in rows])
        of_lang = drawn(mcd_of(x[some]), some.sum(), everything)
        for source in {r["source"] for r, s in zip(rows, some) if s}:
            at = some & np.array([r["source"] == source for r in rows])
            m, cov = drawn(mcd_of(x[at]), at.sum(), of_lang)
            want = mcd_of.distance(x[at], m, cov)
            own = [judged[r["doc_id"]] for r, k in zip(rows, at) if k]
            assert np.allclose([r["distance"] for r in own], want, rtol=1e-5, atol=1e-6)
            assert [r["kept"] for r in own] == (want <= q.quantile(5, 1 - q.CUT)).tolist()
            checked += 1
    assert checked > 8


def test_quality_rejects_at_the_stated_rate(spark, sf_dir):
    """Of texts without symbols about CUT are rejected at most; those full of symbols all go."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = quality_rules.judged(docs).filter("NOT base_failed").collect()
    sound, junk = [r for r in got if r["n_symbols"] == 0], [r for r in got if r["n_symbols"] > r["n_words"]]
    assert sum(not r["kept"] for r in sound) <= max(2, 3 * quality_rules.CUT * len(sound))
    assert len(junk) > 20 and not any(r["kept"] for r in junk)


def test_quality_rejects_a_third_of_identical_outliers(spark, docs):
    """Copies of one junk text, a third of the only (language, source), are rejected, and most sound texts are not."""
    sound = docs.select("doc_id", "text")
    junk = spark.range(sound.count() // 2).select((F.col("id") + 10**9).alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 60), i -> concat('$$$%%%###qzx', i, '***&&&|||')))").alias("text"))
    both = sound.union(junk).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    got = quality_rules.judged(both).filter("NOT base_failed").collect()
    bad, good = [r for r in got if r["doc_id"] >= 10**9], [r for r in got if r["doc_id"] < 10**9]
    assert len(bad) >= 0.3 * len(got) and not any(r["kept"] for r in bad)
    assert sum(r["kept"] for r in good if r["n_symbols"] == 0) >= 0.99 * sum(r["n_symbols"] == 0 for r in good)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [r for r in packing.pack_documents(df.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, window=20_000).collect()]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    given = {d: t for d, t in texts(df) if d is not None}
    assert set(pieces) == set(given)
    for d, own in pieces.items():
        ids = library.encode(given[d] or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r["start"] : at]))
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0  # no padding
    assert packing.pack_documents(df, path).agg(F.sum("length")).first()[0] == (sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts(df)) or None)


def test_packing_balances_cost():
    import random

    random.seed(2)
    lengths = [random.choice([5, 20, 80, 300, 900, 1024, 3000]) for _ in range(600)]
    cost = Counter()
    for _, _, n, s, _ in packing.pack(lengths):
        cost[s] += n + n * n / packing.QUADRATIC
    rows = packing.pack(lengths)
    full = [s for s, n in Counter({s: sum(r[2] for r in rows if r[3] == s) for _, _, _, s, _ in rows}).items() if n == 1024]
    shared = [cost[s] for s in full if sum(r[3] == s for r in rows) > 1]
    assert max(shared) <= 1.6 * (sum(shared) / len(shared))
