"""Each query of the library against its SQL on the smallest tables."""

import math

import pytest

from kinship import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    rel = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["country", "s1_id", "tgt_id", "p"]
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
