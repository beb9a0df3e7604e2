"""The cosine join names records inside its blocks, ranks what they make once, and counts terms a batch at a time."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from kinship.functions import cosines
from kinship.operators import blocking
from kinship.plans import view

SCHEMA = "country string, entity_id string, name_block string"


def test_results_of_blocks_are_shuffled_once(spark):
    r = spark.createDataFrame([("US", f"S{i % 2 + 1}-{i}", f"alpha beta {i % 7}") for i in range(40)], SCHEMA)
    got = blocking.cosine_topk(r.where("entity_id like 'S1%'"), r.where("entity_id like 'S2%'"), "name_block", 3, 5, 0.1, 1, 1.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 3  # terms, blocks, results; the few source records are broadcast
    assert "AggregateFunction" not in plan and "collect_list" not in plan


def test_ids_of_copies_in_blocks(spark, monkeypatch):
    """Copies on both sides, several blocks of each, fewer ids wanted than a text has: the first ids of the best."""
    monkeypatch.setattr(blocking, "_SOURCES", 2)
    monkeypatch.setattr(blocking, "_TARGETS", 2)
    names = ["alpha beta", "alpha beta gamma", "beta gamma", "delta", "alpha"]
    s = [("US", f"S1-{i}", names[i % 5]) for i in range(10)]
    t = [("US", f"S2-{i:03}", names[i % 4]) for i in range(60)]
    s1, targets = spark.createDataFrame([*s, ("US", "S1-x", None), (None, "S1-y", "alpha")], SCHEMA), spark.createDataFrame([*t, (None, "S2-y", "alpha"), ("US", "S2-x", " ")], SCHEMA)
    every = blocking.cosine_topk(s1, targets, "name_block", 3, 1000, 0.05, 1, 1.0).collect()
    want = set()
    for _, rows in itertools.groupby(sorted(every, key=lambda x: (x["s1_id"], -x["six"], x["tgt_id"])), lambda x: x["s1_id"]):
        want |= {(x["s1_id"], x["tgt_id"], x["six"]) for x in list(rows)[:17]}
    got = blocking.cosine_topk(s1, targets, "name_block", 3, 17, 0.05, 1, 1.0).collect()
    assert {(x["s1_id"], x["tgt_id"], x["six"]) for x in got} == want and len(got) == len(want) > 100
    assert all(x["six"] == 1.0 for x in every if names[int(x["s1_id"][3:]) % 5] == names[int(x["tgt_id"][3:]) % 4])


def test_blocks_are_numbered_without_gaps(monkeypatch):
    monkeypatch.setattr(blocking, "_TARGETS", 100)
    table, blocks = blocking._dealt([Row(country="b", a=10, b=5, n=7), Row(country="a", a=5000, b=250, n=400)])
    assert table.to_pylist() == [{"country": "a", "a": 5, "b": 3, "first": 0, "records": 400}, {"country": "b", "a": 1, "b": 1, "first": 15, "records": 7}]
    assert blocks == 16 and blocking._dealt([])[1] == 0


def test_six_places_are_those_of_spark(spark):
    r = random.Random(5)
    x = [0.0, 1.0, 0.0000005, 0.9999995, 0.1234565, 0.30000049999999999, 0.2500005, *((2 * r.randrange(10**6) + 1) / 2e6 for _ in range(3000)), *(r.random() for _ in range(3000))]
    want = [y[0] for y in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert cosines.six_places(np.array(x)).tolist() == want


def test_terms_counted(spark):
    r = random.Random(7)
    rows = [(r.choice(["US", "IN"]), " ".join(r.choice(["sun", "sunny", "a", "été", "日本"]) for _ in range(r.randint(0, 6))), r.randint(1, 3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "country string, text string, n long")
    for n in (None, 3):
        grams = blocking.word_grams(F.col("text")) if n is None else blocking.char_grams(F.col("text"), n)
        want = {(x["country"], x["g"]): x["df"] for x in df.select("country", "n", F.explode(F.array_distinct(grams)).alias("g")).groupBy("country", "g").agg(F.sum("n").alias("df")).collect()}
        words = sorted({g for _, g in want})
        key = dict(zip(words, cosines.whole_keys(pa.array(words)).tolist(), strict=True))
        got = df.mapInArrow(cosines.terms_counted(n), cosines.TERMS).groupBy("country", "gram").agg(F.sum("df").alias("df")).collect()
        assert {(x["country"], x["gram"]): x["df"] for x in got} == {(c, key[g]): v for (c, g), v in want.items()}
        empty = pa.record_batch({"country": ["US"], "text": [""], "n": pa.array([1], pa.int64())})
        assert [b.num_rows for b in cosines.terms_counted(n)(iter([empty]))] == [0]


def test_words_of_a_text_whose_begin_is_not_enough(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " " * 600 + " ".join(words), "x" * 600 + "\t\n" + " ".join(words), "\n" + "  ".join(words), " ".join(w * 9 for w in words), " ".join(words[:26]) + "\n", "é" * 511 + " y", "  ", None]
    spark.createDataFrame([(i, x, "en", "src1") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    all_ = F.split(F.trim(F.coalesce("text", F.lit(""))), view.SPACES)
    part = lambda a, n: F.array_join(F.slice(all_, a, n), " ")
    want = {f"S2-{r['doc_id']}": (r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", part(1, 6).alias("a"), part(7, 20).alias("b")).collect()}
    assert {r["entity_id"]: (r["business_name"], r["business_address"]) for r in view.source_view(spark, str(tmp_path)).collect()} == want
