import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinship.llm import lm

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DOCS = "doc_id long, text string"


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute(docs, strength):
    """By the definition, n-gram by n-gram."""
    w = [(i, held(i), tokens(t)) for i, t in docs]
    order = len(strength) + 1
    padded = lambda ts: [0] * (order - 1) + ts
    count, state = Counter(), Counter()
    for _, h, ts in w:
        for k in range(len(ts)) if not h else ():
            for n in range(order):
                gram = tuple(padded(ts)[k + order - 1 - n : k + order])
                count[gram] += 1
                state[gram[:-1]] += 1
    n, v = state[()], sum(len(g) == 1 for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 0.5) / (n + 0.5 * (v + 1))
        m = strength[len(gram) - 2]
        return (count[gram] + m * p(gram[1:])) / (state[gram[:-1]] + m)

    out = []
    for i, h, ts in w:
        grams = [tuple(padded(ts)[k : k + order]) for k in range(len(ts))]
        out.append((i, h, len(ts), sum(count[x,] > 0 for x in ts), n, sum(math.log10(p((x,))) for x in ts), sum(math.log10(p(g)) for g in grams)))
    return sorted(out, key=str)


DATA = [(i, " ".join(f"w{(i * j) % (3 + i % 11)}" for j in range(i % 23)) + (" Rare%d" % i) * (i % 3)) for i in range(80)]
DATA += [(1, "w1 w1"), (1, "w1 w1"), (None, "w1 null id"), (200, None), (201, ""), (202, " \t\n "), (203, "É é A a b"), (204, "long " * 30000)]


@pytest.mark.parametrize("strength", [(), (100.0,), (20.0, 4.0), (9.0, 2.5, 0.5)])
def test_against_brute_force(spark, strength, monkeypatch):
    docs = spark.createDataFrame(DATA, DOCS).withColumns({"chunk": F.lit("x"), "n": F.lit(1), "held_out": F.lit("y")})
    got = sorted((tuple(r) for r in lm.lm_scores(docs.repartition(3), lm.every_fifth(F.col("doc_id")), len(strength) + 1, strength).collect()), key=str)
    want = brute(DATA, strength)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-9)


def built(texts, strength, extra=()):
    """The automaton of some texts, and their words by number; extra words are in no training text."""
    order = len(strength) + 1
    rows = [tokens(t) for t in texts] + [list(extra)]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    grams, counts = [], []
    for n in range(1, order + 1):
        keys = [tuple(([0] * order + r)[k + order - n + 1 : k + order + 1]) for r in rows for k in range(len(r))]
        names = {x: i for i, x in enumerate(dict.fromkeys(keys))}
        trained = Counter(k for k, i in zip(keys, row.tolist(), strict=True) if i < len(texts))
        grams.append(np.array([names[k] for k in keys]))
        counts.append(np.array([trained[k] for k in names]))
    n_tokens, words = int(counts[0].sum()), int((counts[0] > 0).sum())
    return lm.automaton(grams, counts, row, n_tokens, words, len(texts), list(strength))[0], grams[0]


@pytest.mark.parametrize("strength", [(), (5.0,), (5.0, 2.0), (5.0, 2.0, 1.0)])
def test_states_are_distributions(strength):
    # From each state, all known words and one unknown have probabilities that sum to 1.
    a, word = built(["a b a c", "a b b", "c a b a c", ""], strength, ["zzz"])
    reached, todo = set(), [a.start]
    while todo:
        state = todo.pop()
        if state in reached:
            continue
        reached.add(state)
        to, weight = a.read(np.full(a.words, state), np.arange(a.words))
        assert (10**weight).sum() == pytest.approx(1.0)
        todo += to[np.arange(a.words) != word[4]].tolist()  # nothing follows an end
    assert len(reached) > len(strength)


def test_failure_arcs_are_followed():
    a, word = built(["a b a b a b", "c b"], (5.0, 2.0), ["zzz"])
    number = dict(zip(["a", "b"], word[:2].tolist(), strict=True)) | {"c": int(word[7]), "zzz": int(word[-1])}
    state, seen = np.array([a.start]), 0
    for x in "ab":
        state, _ = a.read(state, np.array([number[x]]))
    # No training text has "a b c": two failure arcs lead to the root, whose arc reads c.
    key = int(state[0]) * a.words + number["c"]
    assert key not in a.key and a.fail[a.fail[state[0]]] == 0
    after, weight = a.read(state, np.array([number["c"]]))
    by_hand = a.fail_weight[state[0]] + a.fail_weight[a.fail[state[0]]] + a.weight[a.key.tolist().index(number["c"])]
    assert weight[0] == pytest.approx(by_hand) and after[0] > 0
    # A word that training lacks leads to the root, which has no failure arc.
    after, weight = a.read(state, np.array([number["zzz"]]))
    assert after[0] == 0 and weight[0] == pytest.approx(a.fail_weight[state[0]] + a.fail_weight[a.fail[state[0]]] + a.unknown)


def test_chunks_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(DATA[:85], DOCS).coalesce(1)
    args = (docs, lm.every_fifth(F.col("doc_id")))
    whole = sorted((tuple(r) for r in lm.lm_scores(*args).collect()), key=str)
    apart = sorted((tuple(r) for r in lm.lm_scores(docs.repartition(40), args[1]).collect()), key=str)
    assert [x[:5] for x in whole] == [x[:5] for x in apart] and [x[6] for x in whole] == pytest.approx([x[6] for x in apart])


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], DOCS)
    assert lm.lm_scores(empty, lm.every_fifth(F.col("doc_id"))).collect() == []
    one = spark.createDataFrame([(1, "a b")], DOCS)
    r = lm.lm_scores(one, F.lit(True)).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["score"]) == (0, 0, 3, 0.0)


def test_packing():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, (1 << 64) - 1, 1000, dtype=np.uint64))
    assert (lm._unpack(lm._pack(keys), len(keys)) == keys).all()
    x = rng.integers(0, 1 << 40, 77)
    assert (lm._unpack_numbers(lm._pack_numbers(x), 77) == x).all()
    assert len(lm._unpack(lm._pack(keys[:0]), 0)) == 0


def test_more_words_raise_the_score_of_the_known(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(40)], DOCS)
    r = lm.lm_scores(docs, lm.every_fifth(F.col("doc_id"))).first()
    assert r["score"] > r["base_score"]


def test_words_read_at_once_are_the_walk(monkeypatch):
    """All words are read in few calls, to the same scores as word by word; a text read from a wrong state is walked again."""
    rng = np.random.default_rng(5)
    size = rng.integers(1, 40, 60)
    row, trains = np.repeat(np.arange(60), size), np.repeat(rng.random(60) < 0.6, size)
    h = rng.zipf(1.5, len(row)).astype(np.uint64)
    found = list(lm._counted(h, row, trains, 3, {}))
    counts = [np.bincount(g.number, trains, len(g.keys)).astype(np.int64) for g in found]
    a, _ = lm.automaton([g.number for g in found], counts, row, int(trains.sum()), 9, 36, [20.0, 4.0])
    want, calls, read = lm._stepped(a, found[0].number, row, 60), [], lm.Automaton.read
    monkeypatch.setattr(lm.Automaton, "read", lambda self, state, word: calls.append(1) or read(self, state, word))
    assert np.array_equal(lm.walked(a, found[0].number, row, 60), want) and len(calls) == 1
    a.expected[::7] = a.start
    assert np.array_equal(lm.walked(a, found[0].number, row, 60), want) and len(calls) > 1
