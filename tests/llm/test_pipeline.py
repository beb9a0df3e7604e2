"""The pipeline's stages on a fixture, each against plain Python on its own input."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from test_decontaminate import brute as dirty
from test_neardup import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("cast(9001 as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    extra = extra.unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "'das ist ein Text der bleiben soll' text", "cast(null as string) lang", "cast(null as string) source", "n_chars"))
    out = [docs.unionByName(extra)]
    root = tmp_path_factory.mktemp("stages")
    for i, (_, f) in enumerate(cp.STAGES):
        f(spark, out[-1], SF).write.parquet(str(root / str(i)))
        out.append(spark.read.parquet(str(root / str(i))))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language", "near duplicates", "decontamination", "mixing", "token ids"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_language_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    gone = set(before) - set(after)
    assert (9001, None) in gone and len(gone) <= 3 and not set(after) - set(before)


def test_one_of_each_group(stages):
    before, after = rows(stages[1]), rows(stages[2])
    want = {d for d, _, c in groups(before, 5, 4, 5) if d is None or d == c}
    assert sorted(map(str, (d for d, _ in after))) == sorted(map(str, want))


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    want = [d for d, _, _, _, bad in dirty(before, items) if not bad]
    assert sorted(map(str, (d for d, _ in after))) == sorted(map(str, want)) and len(after) < len(before)


def test_mixing_repeats_and_drops_none(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after) and len(before) < len(after) <= 2 * len(before) + 1


def test_token_files(spark, stages, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    at, want = 0, []
    for d, text in sorted(rows(stages[4]), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, cp.END_ID]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in stages[5].orderBy("start").collect()] == want


def test_run_is_the_stages(spark, tmp_path, monkeypatch):
    import os

    from kinship.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    got = cp.run(spark, SF)
    assert sorted(p.rsplit("-", 1)[0] for p in os.listdir(tmp_path)) == ["stage-token-ids", "token_ids"]
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 150
    assert cp.ORACLE_SQL is None
