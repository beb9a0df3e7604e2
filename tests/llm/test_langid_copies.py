"""Copies of a text don't change what the model is fitted on."""

import numpy as np
from pyspark.sql import functions as F
from test_langid import corpus

from kinship.llm import langid as li

SCHEMA = "doc_id long, text string, lang string"


def test_copies_count_once(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for hot in (rows[0], rows[1], rows[2]):
        copies = spark.range(5000).select("id", F.lit(hot[1]).alias("text"), F.lit(hot[2]).alias("lang"))
        a, b = li.fit(docs, most=60), li.fit(docs.union(copies), most=60)
        assert a.langs == b.langs and a.threshold == b.threshold
        assert all(np.array_equal(x, y) for x, y in ((a.scores, b.scores), (a.bias, b.bias)))
