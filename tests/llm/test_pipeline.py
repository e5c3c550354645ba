"""Each stage of the pipeline on its own input, against brute force; then the whole."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from . import brute
from .test_operators import docs, empty, odd, same_text, texts  # noqa: F401

STAGES = dict(pipeline.STAGES)


def test_stages_are_named_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
@pytest.mark.parametrize("stage", list(STAGES)[:-1])
def test_columns_stay(stage, which, request, spark, sf_dir):
    df = request.getfixturevalue(which)
    out = STAGES[stage](spark, df, sf_dir)
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    given = Counter(map(str, df.collect()))
    assert set(Counter(map(str, out.collect()))) <= set(given)


def test_language_stage_keeps_prose(spark, docs, odd, sf_dir):
    assert STAGES["language_id"](spark, docs, sf_dir).count() >= 0.98 * docs.count()
    foreign = spark.createDataFrame([(10_000 + i, x, None, "a", 1) for i, x in enumerate(["Привет мир, как дела сегодня утром", "123 456", None, " "])], docs.schema)
    left = STAGES["language_id"](spark, docs.union(foreign), sf_dir)
    assert left.filter("doc_id >= 10000").count() == 0


def test_exact_stage(spark, docs, odd, sf_dir):
    for df in (docs, odd):
        best = {}
        for d, t in texts(df):
            k = same_text(t)
            best[k] = max((x for x in (best.get(k), d) if x is not None), default=None)
        out = texts(STAGES["exact_dedup"](spark, df, sf_dir))
        assert Counter((same_text(t), d) for d, t in out) == Counter(best.items())


def test_near_stage(spark, docs, sf_dir):
    near = docs.limit(20).withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat("text", F.lit(" x")))
    df = docs.union(near)
    kept = {d for d, _ in texts(STAGES["simhash_near_dedup"](spark, df, sf_dir))}
    want = brute.simhash_components(texts(df))
    assert kept == set(want.values())


def test_mixing_stage(spark, docs, sf_dir):
    out = STAGES["mixing"](spark, docs, sf_dir)
    sizes, got = Counter(), Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(brute.words(r["text"]))
    for r in out.collect():
        got[r["source"]] += len(brute.words(r["text"]))
    want = brute.targets(sizes)
    assert sum(abs(got[s] - want[s]) for s in want) <= 0.02 * sum(want.values())
    times = out.groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] <= 3


def test_run_is_its_stages(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    pieces = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.filter("start = 0").collect())
    assert pieces(out) == pieces(STAGES["packing"](spark, docs, sf_dir))


def test_library_without_this_subpackage(tmp_path):
    """The rest must import when the subpackage, its tests and the pipeline are deleted; with them, the guard hides no error."""
    import os
    import shutil
    import subprocess
    import sys

    import __spark_entry__

    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    left = tmp_path / "left"
    shutil.copytree(here, left, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'focal_summary' in q and not any(k == 'pipeline' or (k.startswith('op') and k[2].isdigit()) for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=left, env={**os.environ, "PYTHONPATH": str(left)})
    assert int(ran.stdout) > 50
    assert sum(k.startswith("op") and k[2].isdigit() for k in __spark_entry__.queries()) == 10
