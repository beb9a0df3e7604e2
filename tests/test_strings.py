import pytest
import slow_strings as slow
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinship.functions import strings as s


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


word = st.text("abcd é日🙂", max_size=20) | st.text("ab ", max_size=200)


@given(st.lists(st.tuples(word, word), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_many_against_one_by_one(pairs):
    a, b = map(list, zip(*pairs, strict=True))
    assert s.lcs(a, b).tolist() == [slow_lcs(x, y) for x, y in pairs]
    for name, one in slow.SCORES.items():
        assert s.SCORES[name](a, b).tolist() == pytest.approx([one(x, y) for x, y in pairs], abs=1e-12), name


def test_ratios():
    one = lambda f, a, b: f([a], [b])[0]
    assert one(s.indel_ratio, "martha", "marhta") == pytest.approx(0.8333333)
    assert one(s.indel_ratio, "", "") == 1.0
    assert one(s.indel_ratio, "a", "") == 0.0
    assert one(s.token_sort_ratio, "b a", "a b") == 1.0
    assert one(s.token_set_ratio, "a b c", "a b") == 1.0
    assert one(s.token_set_ratio, "", "a") == 0.0
    assert one(s.token_set_ratio, "abc", "abd") == pytest.approx(2 / 3)
    assert one(s.jaro_winkler, "martha", "marhta") == pytest.approx(0.9611111)
    assert one(s.jaro_winkler, "", "") == 1.0
    assert one(s.jaro_winkler, "abc", "xyz") == 0.0


def test_many_pairs():
    a = [("x%d " % (i % 97)) * (i % 60) for i in range(5000)]
    b = [("x%d y" % (i % 89)) * (i % 50) for i in range(5000)]
    got = s.indel_ratio(a, b)
    assert [got[i] for i in range(0, 5000, 501)] == pytest.approx([slow.indel_ratio(a[i], b[i]) for i in range(0, 5000, 501)])


def test_udf(spark):
    df = spark.createDataFrame([("a b", "b a"), (None, "x"), ("", "")], "a string, b string")
    got = df.select(s.similarities(F.col("a"), F.col("b")).alias("s")).select("s.*").collect()
    assert got[0]["token_sort"] == 1.0
    assert got[1]["ratio"] == 0.0
    assert got[2]["ratio"] == 1.0
    assert df.limit(0).select(s.similarities(F.col("a"), F.col("b")).alias("s")).collect() == []


def test_places_looked_up_are_those_compared(monkeypatch):
    import numpy as np

    from kinship.functions import strings

    r = np.random.default_rng(1)
    x, y = r.integers(0, 30, (40, 128)).astype(np.uint8), r.integers(0, 30, (40, 70)).astype(np.uint8)
    looked_up = [strings._places(x, y)(j) for j in range(70)]
    monkeypatch.setattr(strings, "_TABLE", 0)
    assert np.array_equal(looked_up, [strings._places(x, y)(j) for j in range(70)])
    assert np.array_equal(np.unpackbits(np.ascontiguousarray(np.array(looked_up[69]).T).view(np.uint8), axis=1, bitorder="little").astype(bool), x == y[:, 69:])
