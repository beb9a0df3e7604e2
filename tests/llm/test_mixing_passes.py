"""A tiny source beside a large target gets all its passes."""

import math

from kinship.llm import mixing as mx


def test_passes_have_no_cap(spark):
    docs = spark.createDataFrame([(1, "w", "tiny"), *((i, "w w w", "big") for i in range(2, 30))], "doc_id long, text string, source string")
    planned = mx.plan(docs, None, math.log(2) - 1e-12, budget=10**10)
    tiny = planned[1]
    assert tiny["source"] == "tiny" and tiny["passes"] == tiny["target"] > 1 << 31 and tiny["rest"] == 0
    got = {}
    for r in mx.copies(docs, planned).collect():
        got[r["row"]["source"]] = got.get(r["row"]["source"], 0) + r["n_tokens"] * r["copies"]
    for r in planned:
        assert 0 <= r["target"] - got[r["source"]] <= 3
