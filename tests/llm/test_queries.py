"""Queries that SQL can express, against it, and the entry points."""

import math

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["op1_decontaminate", "op5_chat", "op6_minhash", "op7_warc", "op8_license"])
def test_query(spark, duck, name):
    from kinship.llm import queries as q

    df = q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    rel = duck.execute(q.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_all_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(e.oracle_sql()) <= names


def test_contract_columns(spark):
    from kinship.llm import queries as q

    want = {
        "op2_token_ids": "doc_id start n_tokens ids_crc32",
        "op3_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op4_mix": "doc_id source n_tokens copies",
        "op6_minhash": "doc_id n_shingles component_id kept",
        "op9_langid": "doc_id held_out lang_pred score",
        "op10_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    }
    for name, columns in want.items():
        df = q.queries()[name](spark, DATA)
        assert df.columns == columns.split(), name
        assert df.count() == 200
