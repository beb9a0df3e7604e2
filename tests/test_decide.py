import pytest

from kinship.config import DecideConfig
from kinship.operators import decide, diagnostics, metric, model


def scored(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, tgt_id string, p double")


def pairs(df):
    return sorted((r["s1_id"], r["tgt_id"]) for r in df.collect())


def test_exclusive(spark):
    df = scored(spark, [("a", "t1", 0.9), ("b", "t1", 0.9), ("b", "t2", 0.7)])
    assert pairs(decide.exclusive(df)) == [("a", "t1"), ("b", "t2")]


def test_gate(spark):
    df = scored(spark, [("a", "t1", 0.7), ("b", "t1", 0.6), ("b", "t2", 0.85)])
    assert pairs(decide.select(df, DecideConfig(0.5, 0.8))) == [("b", "t1"), ("b", "t2")]
    assert pairs(decide.select(df, DecideConfig(0.5, 0.4))) == [("a", "t1"), ("b", "t2")]
    assert pairs(decide.select(df, DecideConfig(0.7, None, False))) == [("a", "t1"), ("b", "t2")]


def test_sweep_is_select_and_score(spark):
    df = scored(spark, [("a", "t1", 0.9), ("a", "t2", 0.3), ("b", "t1", 0.95), ("b", "t3", 0.5), ("c", "t4", 0.2)])
    truth = spark.createDataFrame([("a", "t1"), ("b", "t3"), ("e", "t9")], "s1_id string, tgt_id string")
    entities = spark.createDataFrame([(x,) for x in "abcde"], "entity_id string")
    got = {r["threshold"]: r["macro_f05"] for r in decide.sweep(df, truth, entities).collect()}
    assert len(got) == 37
    for t in (0.05, 0.3, 0.5, 0.95):
        want = metric.macro_f_beta(decide.select(df, DecideConfig(t)), truth, entities).first()[0]
        assert got[t] == pytest.approx(want)
    best = decide.best_threshold(decide.sweep(df, truth, entities)).first()
    top = max(got.values())
    assert best["threshold"] == min(t for t, v in got.items() if v > top - 1e-9)
    report = {r["threshold"]: r for r in decide.threshold_report(df, entities).collect()}
    assert report[0.2]["total"] == 4 and report[0.2]["empty_share"] == pytest.approx(0.4)
    none = {r["macro_f05"] for r in decide.sweep(df.limit(0), truth, entities).collect()}
    assert none == {0.4}


def test_split(spark):
    e = spark.range(41).selectExpr("concat('S1-', id) AS entity_id")
    assert model.group_split(e, 0.25).where("held_out").count() == 10
    assert model.group_split(e.limit(1), 0.25).where("held_out").count() == 1
    assert sorted(r[0] for r in model.group_split(e).where("held_out").collect()) == sorted(r[0] for r in model.group_split(e.repartition(5)).where("held_out").collect())


def test_calibration(spark):
    df = spark.createDataFrame([(0.05, 0), (1.0, 1), (0.95, 0)], "p double, label int")
    got = {r["bin"]: (r["n"], r["positive_rate"]) for r in model.calibration(df).collect()}
    assert got == {0: (1, 0.0), 9: (2, 0.5)}


def test_policies_and_losses(spark):
    df = scored(spark, [("a", "t1", 0.9), ("a", "t2", 0.8), ("a", "t3", 0.4), ("a", "t4", 0.39)])
    got = {}
    for r in diagnostics.prefix_policies(df, 0.5).collect():
        got.setdefault(r["policy"], []).append(r["tgt_id"])
    assert {k: len(v) for k, v in got.items()} == {"global": 2, "topk_floor": 2, "capped": 2, "leading": 2, "successive": 2, "gap": 2}
    truth = spark.createDataFrame([("a", "t1"), ("a", "t3"), ("a", "zz")], "s1_id string, tgt_id string")
    r = diagnostics.lost_pairs(truth, df, df.where("p > 0.5")).first()
    assert tuple(r) == (3, 1, 1, 1) and r["tp"] + r["fn_blocked"] + r["fn_model"] == r["total"]
