import random

import pytest
from pyspark.sql import functions as F

from kinship.llm import langid as li

PARTS = {"xa": "tion ing ed the of er st".split(), "xb": "keit ung ein der ich sch au".split(), "xc": "ción mente os la que ñ ar".split()}


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        text = " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 60)))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return li.fit(spark.createDataFrame([r for r in corpus() if r[0] % 4 != 2], "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark, model):
    rows = [r for r in corpus() if r[0] % 4 == 2] + [(1000 + i, t, g) for i, t, g in corpus(100, 9)]
    out = li.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["rejected"] for r in out) <= 0.03 * len(out)


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "日本"), (None, "keit ung"), (6, "ung " * 50000), (7, "a"), (7, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("mine"), "p": F.lit(1), "row": F.lit(2)})
    out = li.judged(docs, model).select("row.doc_id", F.col("row.score").alias("own"), "lang_pred", "score", "rejected").collect()
    assert [r["lang_pred"] == "und" for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [True, True, True, False, False, False, False, False]
    assert all(r["own"] == "mine" for r in out)
    assert all((r["score"] == 0 and r["rejected"]) for r in out if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in out if r["doc_id"] in (None, 6)} == {"xb"}
    assert li.predict(docs, model).columns == ["doc_id", "text", "p", "row", "lang_pred", "score", "rejected"]


def test_predictions_do_not_depend_on_neighbours(spark, model):
    rows = corpus(60, 5)
    together = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), model).collect()}
    for r in rows[:5]:
        alone = li.predict(spark.createDataFrame([r], "doc_id long, text string, lang string"), model).first()
        assert (alone["lang_pred"], pytest.approx(alone["score"], abs=1e-6)) == together[r[0]]


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, None, "x"), (2, "a", None)], "doc_id long, text string, lang string")
    m = li.fit(none)
    assert li.predict(none, m).where("lang_pred <> 'und'").count() == 0
    m = li.fit(spark.createDataFrame([(1, "12", "x")], "doc_id long, text string, lang string"))
    assert li.predict(none, m).where("doc_id = 2").first()["lang_pred"] == "x"
    assert li.predict(none.limit(0), m).count() == 0


def test_same_model_from_any_order(spark, model):
    df = spark.createDataFrame([r for r in corpus() if r[0] % 4 != 2], "doc_id long, text string, lang string")
    again = li.fit(df.orderBy(F.xxhash64("doc_id")).repartition(5))
    assert (again.scores == model.scores).all() and again.threshold == model.threshold


def test_fold(spark):
    import zlib

    df = spark.range(50).select("id", li.fold(F.col("id"), 4).alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in df.collect())
