import pytest

from kinship import registry
from kinship.operators import blocking, model


@pytest.fixture
def tables(spark, tmp_path):
    """Two source records and 150 targets of one name, each with an address of its own."""
    at = lambda i: " ".join(f"street{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{w}" for w in "abcd")
    rows = [(i, f"alpha beta gamma delta epsilon zeta {at(i)}", "en", "src0" if i < 2 else f"src{1 + i % 2}") for i in range(152)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_importances_are_of_all_pairs_of_a_large_key(spark, tables, monkeypatch):
    seen = []
    train = model.train
    monkeypatch.setattr(model, "train", lambda data, *a, **k: seen.append(data) or train(data, *a, **k))
    assert registry.queries()["feature_importance"](spark, tables).count() == len(registry._COLUMNS)
    pairs = {(r["s1_id"], r["tgt_id"]) for r in seen[0].collect()}
    assert pairs == {(f"S1-{s}", f"S{2 + t % 2}-{t}") for s in (0, 1) for t in range(2, 152)} and seen[0].count() == 300


def test_pairs_that_meet_at_keys_are_those_of_the_union(spark, tables, monkeypatch):
    """Tiles of few records, and the supplied tables: the same rows as by candidates, joined records and truth."""
    monkeypatch.setattr(blocking, "_TILE", 7)
    for d in (tables, "/root/testdata/sf0.001"):
        got, want = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.collect()] for f in (registry._all_train_pairs(spark, d), registry._train_pairs(spark, d, registry.WHOLE)))
        assert sorted(got) == sorted(want) and len(want) > 100 and any(r[2] for r in want) == (d != tables)
