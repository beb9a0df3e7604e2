import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinship.config import LinkConfig
from kinship.functions import cosines
from kinship.functions.text import normalize, record_columns
from kinship.operators import blocking


def records(spark, rows):
    return record_columns(normalize(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")))


def names(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(3, 7))) for _ in range(60)]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(n)]


def written(spark):
    """Bytes that shuffles of this session have written so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("least", [0.2, -1.0])
@pytest.mark.parametrize("dense", [0, 256])
def test_best_cosines_against_all_pairs(monkeypatch, dense, least):
    monkeypatch.setattr(cosines, "_DENSE", dense)
    r = np.random.default_rng(dense)
    lists = lambda n: pa.array([r.integers(0, 40, r.integers(0, 12)).tolist() for _ in range(n)], pa.list_(pa.int64()))
    terms, idf = np.arange(35), r.random(35) + 1
    s, t = cosines._vectors(lists(150), terms, idf), cosines._vectors(lists(300), terms, idf)

    def full(v):
        out = np.zeros((len(v[0]) - 1, 35))
        out[np.repeat(np.arange(len(out)), np.diff(v[0])), v[1]] = v[2]
        return out

    want = full(s) @ full(t).T
    i, j, cos = cosines.best_cosines(s, t, 35, 10, least)
    assert cos == pytest.approx(want[i, j])
    got = np.zeros(want.shape, bool)
    got[i, j] = True
    tenth = np.sort(want, 1)[:, -10][:, None]
    assert got[(want > max(least, 0)) & (want >= tenth)].all()


def test_blocks_change_nothing(spark, monkeypatch):
    texts = names(500, 1)
    rows = lambda p, xs: records(spark, [(f"{p}-{i}", x, "", "US" if i % 3 else "IN") for i, x in enumerate(xs)]).localCheckpoint()
    s1, t = rows("S1", texts[:200]), rows("S2", texts[150:] + texts[150:160] * 20)
    cfg = LinkConfig(name_top=7)
    all_ = lambda: sorted((r["s1_id"], r["tgt_id"], round(r["cos"], 6)) for r in blocking.name_blocker(s1, t, cfg).collect())
    one = all_()
    monkeypatch.setattr(blocking, "_SOURCES", 30)
    monkeypatch.setattr(blocking, "_TARGETS", 50)
    assert all_() == one and len(one) > 1000


def test_shuffles_hold_texts_and_not_products(spark):
    """Two thousand names of few words share grams in most pairs; copies are compared once."""
    texts = names(1000, 2) * 2
    s1, t = (records(spark, [(f"{p}-{i}", x, "", "US") for i, x in enumerate(texts)]).localCheckpoint() for p in ("S1", "S2"))
    before = written(spark)
    assert blocking.name_blocker(s1, t, LinkConfig()).count() == 40 * 2000
    assert written(spark) - before < 6_000_000


def test_shuffles_hold_texts_and_not_their_grams(spark):
    """Long addresses, of which each block gets its own copy; one result of each."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9))) for _ in range(20)) for _ in range(1500)]
    s1, t = (records(spark, [(f"{p}-{i}", "", x, "US") for i, x in enumerate(texts)]).localCheckpoint() for p in ("S1", "S2"))
    before = written(spark)
    assert blocking.addr_blocker(s1, t, LinkConfig(addr_top=1)).count() == 1500
    size = written(spark) - before
    assert size < 2_500_000, size


@pytest.mark.parametrize("n", [None, 2, 3, 5])
def test_terms_are_those_of_spark(spark, n):
    texts = ["sun a", "", "a", "été  à bientôt", " x yy zzz ", "𝒜b 日本語 𝒜b"]
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    want = [x[0] for x in df.select(blocking.word_grams(F.col("c")) if n is None else blocking.char_grams(F.col("c"), n)).collect()]
    got = cosines.term_lists(pa.array(texts), n).to_pylist()
    flat = sorted({x for xs in want for x in xs})
    key = dict(zip(flat, cosines.whole_keys(pa.array(flat)).tolist(), strict=True))
    assert len(set(key.values())) == len(flat)
    assert [sorted(key[x] for x in xs) for xs in want] == [sorted(xs) for xs in got]


@pytest.mark.parametrize("shared", [1, 7, 256])
def test_targets_in_turn_against_all_pairs(monkeypatch, shared):
    """Columns shared by several terms bound cosines, bars that rise between tiles lose no pair."""
    monkeypatch.setattr(cosines, "_DENSE", 3)
    monkeypatch.setattr(cosines, "_SHARED", shared)
    monkeypatch.setattr(cosines, "_TILE", 16)
    r = np.random.default_rng(shared)
    lists = lambda n: pa.array([r.integers(0, 40, r.integers(0, 12)).tolist() for _ in range(n)], pa.list_(pa.int64()))
    terms, idf = np.arange(35), r.random(35) + 1
    s = cosines._vectors(lists(90), terms, idf)
    parts = [cosines._vectors(lists(n), terms, idf) for n in (50, 1, 200)]

    def full(v):
        out = np.zeros((len(v[0]) - 1, 35))
        out[np.repeat(np.arange(len(out)), np.diff(v[0])), v[1]] = v[2]
        return out

    want = full(s) @ np.concatenate([full(v) for v in parts]).T
    best = cosines.Best(s, 35, 4, 0.2)
    for v in parts:
        best.meet(v)
    i, j, cos = best.best()
    assert cos == pytest.approx(want[i, j])
    got = np.zeros(want.shape, bool)
    got[i, j] = True
    fourth = np.sort(want, 1)[:, -4][:, None]
    assert got[(want > 0.2) & (want >= fourth)].all()
    assert not got[(want < 0.2 - 1e-4) | (want < fourth - 1e-4)].any()
