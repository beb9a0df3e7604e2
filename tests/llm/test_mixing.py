import math
import random
from collections import Counter, defaultdict

import pytest

from kinship.llm import mixing as mx

DOCS = "doc_id long, text string, source string, t int, ahead string"


def corpus(spark, rows=None):
    rng = random.Random(1)
    if rows is None:
        sizes = {"big": 600, "mid": 60, "low": 9, None: 20}
        rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
        rows += [(5000, None, "empty"), (5001, "", "empty"), (7, rows[7][1], "big")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


def shares(docs):
    n = Counter()
    for r in docs.collect():
        n[r["source"]] += len((r["text"] or "").split())
    total = sum(n.values())
    return n, {k: v / total for k, v in n.items() if v}


def brute_alpha(sh, limit):
    """The least alpha whose most repeated source stays within the limit, on a fine grid."""
    top = max(sh.values())
    return next(a / 10000 for a in range(10001) if max((top / s) ** (1 - a / 10000) for s in sh.values()) <= limit)


def test_bisection(spark):
    _, sh = shares(corpus(spark))
    a = mx.bisected(sh, max_repeats=3.0)
    assert a == pytest.approx(brute_alpha(sh, 3.0), abs=2e-4)
    assert max(mx.repetitions(sh, a).values()) == pytest.approx(3.0, abs=1e-6)
    target = 0.9 * math.log(len(sh))
    e = mx.bisected(sh, None, target)
    assert mx.entropy(mx.tempered(sh, e)) == pytest.approx(target, abs=1e-9)
    assert mx.bisected({"a": 0.5, "b": 0.5}, 2.0) == 0.0
    assert mx.bisected(sh, None, 99.0) == pytest.approx(0.0)


def test_cover_keeps_all_and_meets_targets(spark):
    docs = corpus(spark)
    tokens, sh = shares(docs)
    planned = mx.plan(docs, max_repeats=3.0)
    got, rows = Counter(), defaultdict(list)
    for r in mx.copies(docs, planned).collect():
        rows[r["row"]["source"]].append(r)
        got[r["row"]["source"]] += r["n_tokens"] * r["copies"]
        assert r["copies"] >= 1
    for p in planned:
        s = p["source"]
        own = [r["copies"] for r in rows[s]]
        assert max(own) - min(own) <= 1
        if s in sh:
            longest = max(r["n_tokens"] for r in rows[s])
            assert p["target"] - 2 * longest < got[s] <= p["target"]
            # Repetitions by formula.
            assert p["target"] / tokens[s] == pytest.approx(mx.repetitions(sh, mx.bisected(sh, 3.0))[s], rel=1e-2)
    assert {r["copies"] for r in rows["empty"]} == {1}


def test_budget_takes_parts(spark):
    docs = corpus(spark)
    planned = mx.plan(docs, max_repeats=None, min_entropy=0.8, budget=2000)
    got = Counter()
    for r in mx.copies(docs, planned).collect():
        got[r["row"]["source"]] += r["n_tokens"] * r["copies"]
    assert sum(got.values()) <= 2000 + len(planned)
    assert sum(got.values()) > 2000 - 62 * len(planned)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(mx, "PER_BLOCK", 3)
    test_cover_keeps_all_and_meets_targets(spark)


def test_rows_and_columns(spark):
    docs = corpus(spark)
    out = mx.mixed(docs)
    assert out.columns == docs.columns
    n = Counter(r["doc_id"] for r in out.collect())
    assert set(n) == {r["doc_id"] for r in docs.collect()}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, mx.mixed(docs.repartition(7)).collect()), key=str)


def test_empty_and_tokenless(spark):
    assert mx.mixed(corpus(spark, []).limit(0)).count() == 0
    none = corpus(spark, [(1, None, "a"), (2, "", None)])
    assert mx.mixed(none).count() == 2
    assert mx.mixed(none, budget=5).count() == 0
    assert mx.mixed(corpus(spark, [(1, "one", "a"), (1, "one", "a"), (None, "two", "a")])).count() == 3
