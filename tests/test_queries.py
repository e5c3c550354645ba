"""Every query that has SQL gives the same rows as DuckDB; the others run."""

import duckdb
import pytest

from shutterlake import queries as analytics

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    same = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    return sorted((tuple(same(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(analytics.queries()))
def test_query(spark, sf_dir, duck, name):
    df = analytics.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = analytics.oracle_sql().get(name)
    if sql:
        res = duck.execute(sql)
        columns = [d[0] for d in res.description]
        assert sorted(columns) == sorted(df.columns)
        kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        assert {c: kinds[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in res.description}
        assert rows(df.columns, got) == rows(columns, res.fetchall())
    else:
        assert got


def test_entry_module(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(analytics.queries()) <= set(entry.queries())
