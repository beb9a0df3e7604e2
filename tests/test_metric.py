import math

import pytest
from pyspark.sql import functions as F

from kinship.operators import metric


def score(spark, pred, truth):
    df = spark.createDataFrame([(pred, truth)], "p array<string>, t array<string>")
    return df.select(metric.set_f_beta(F.col("p"), F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("pred", "truth", "want"),
    [
        (["S2-00047", "S2-00193", "S3-00812"], ["S2-00047", "S3-00812"], 0.7142857),
        ([], [], 1.0),
        (["x"], [], 0.0),
        ([], ["S2-1"], 0.0),
        (["S2-9"], ["S2-1"], 0.0),
        (["a", "b"], ["a", "b"], 1.0),
        (["a", "b", "x"], ["a", "b"], 0.7142857),
        (["a"], ["a", "b"], 0.8333333),
        (["a", "x"], ["a"], 0.5555556),
        (["a", "b", "c"], ["a", "b", "c", "d"], 0.9375),
        (["a", "b", "c", "d", "x"], ["a", "b", "c", "d"], 0.8333333),
        (["a", "a"], ["a"], 1.0),
    ],
)
def test_sets(spark, pred, truth, want):
    assert score(spark, pred, truth) == pytest.approx(want, abs=1e-7)


def tables(spark, pred, truth, entities):
    pairs = lambda d: spark.createDataFrame([(k, v) for k, vs in d.items() for v in vs], "s1_id string, tgt_id string")
    return pairs(pred), pairs(truth), spark.createDataFrame([(e,) for e in entities], "entity_id string")


def test_macro(spark):
    args = tables(spark, {"1": ["a"]}, {"1": ["a"], "2": list("bcdef")}, ["1", "2"])
    assert metric.macro_f_beta(*args).first()[0] == 0.5


def test_all_empty_scores_singletons(spark):
    ids = [str(i) for i in range(100)]
    args = tables(spark, {}, {i: ["x" + i] for i in ids[5:]}, ids)
    assert metric.macro_f_beta(*args).first()[0] == pytest.approx(0.05)


def test_no_entities(spark):
    assert metric.macro_f_beta(*tables(spark, {}, {}, [])).first()[0] == 0.0


def test_strict(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "entity_id string")
    with pytest.raises(metric.IdError, match="missing"):
        metric.check_ids(spark.createDataFrame([("1",)], "s1_id string"), ids)
    with pytest.raises(metric.IdError, match="unknown"):
        metric.check_ids(spark.createDataFrame([("1",), ("2",), ("3",)], "s1_id string"), ids)


def test_breakdown(spark):
    args = tables(spark, {"2": ["z"], "3": ["a", "b"], "4": ["a"]}, {"3": ["a", "b"], "4": ["a", "b"]}, ["1", "2", "3", "4"])
    r = metric.breakdown(*args).first()
    assert (r["singleton_mean"], r["singleton_n"], r["non_singleton_n"]) == (0.5, 2, 2)
    assert r["non_singleton_mean"] == pytest.approx(0.9166667, abs=1e-7)
    assert r["singleton_part"] + r["non_singleton_part"] == pytest.approx(r["macro_f"])
    only = metric.breakdown(*tables(spark, {}, {"1": ["a"]}, ["1"])).first()
    assert math.isnan(only["singleton_mean"])
