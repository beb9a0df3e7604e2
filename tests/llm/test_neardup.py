import random
import re

import numpy as np
import pytest

from kinship.llm import neardup as nd

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DOCS = "doc_id long, text string"


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, up, down):
    """Rows are nodes: [(doc_id, n, component)] sorted."""
    sets = [shingles(t, k) for _, t in docs]
    part = list(range(len(docs)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    named = [i for i, (d, _) in enumerate(docs) if d is not None and sets[i]]
    for a in named:
        for b in named:
            if a < b and down * len(sets[a] & sets[b]) >= up * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    least = {}
    for i in named:
        least[find(i)] = min(least.get(find(i), docs[i][0]), docs[i][0])
    return sorted(((d, len(sets[i]), least[find(i)] if i in named else d) for i, (d, _) in enumerate(docs)), key=str)


def run(spark, docs, k=3, threshold=(85, 100)):
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS key", "'x' AS set", "2 AS n", "3 AS sig")
    rows = nd.near_duplicates(df, k, threshold).collect()
    for r in rows:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    out = []
    for i in range(n):
        if out and rng.random() < 0.7:
            w = (rng.choice(out)[1] or "").split()
            for _ in range(rng.randint(0, 6)):
                if w:
                    w[rng.randrange(len(w))] = word()
            out.append((i, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
        else:
            out.append((i, " ".join(word() for _ in range(rng.randint(1, 120)))))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "threshold"), [(3, (85, 100)), (5, (4, 5))])
def test_against_brute_force(spark, k, threshold):
    docs = corpus(k)
    assert run(spark, docs, k, threshold) == brute(docs, k, *threshold)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 9000}" for i in range(20000))
    docs = [(5, None), (4, ""), (3, " \t\n"), (9, "one two"), (8, "ONE\ttwo"), (7, "two one"), (None, "one two"), (None, None), (1, long), (2, long + " tail"), (2, "same id, other text entirely here"), (6, "a b c"), (6, "a b c"), (10, "É a b c d"), (11, "é a b c d"), (-5, "neg one two three four"), (3, "neg one two three four"), (-(1 << 63), "least of all ids here"), ((1 << 63) - 1, "least of all ids here")]
    assert run(spark, docs) == brute(docs, 3, 85, 100)


def test_empty(spark):
    assert run(spark, []) == []


def test_one_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(900):
        w = list(base)
        for j in range(3 + i % 9):
            w[(i * 7 + j * 31) % 200] = f"x{i}_{j}"
        docs.append((i, " ".join(w)))
    assert run(spark, docs) == brute(docs, 3, 85, 100)


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    docs = corpus(11)
    assert run(spark, docs) == brute(docs, 3, 85, 100)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for n, j in ((3, 0.5), (40, 0.6), (2000, 0.8)):
        both = rng.integers(0, 1 << 53, max(1, round(2 * n * j / (1 + j))), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 53, n - len(both), dtype=np.uint64)))) for _ in range(2))
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = nd.sketches(2, np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), 4096)
        assert (s < (1 << 64) - 1).all()
        assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_bands_miss_seldom():
    assert nd.rows_per_band(0.85) == 7 and nd.rows_per_band(0.8) == 5


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000), dtype=np.uint64)) for _ in range(7)]
    got = nd.intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_components(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"y", b"x")]
    got = {bytes(r["v"]): bytes(r["comp"]) for r in nd.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert {got[bytes([i])] for i in range(41)} == {b"\0"} and got[b"y"] == b"x"


def test_one_of_each_keeps_columns(spark):
    rows = [(2, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (None, "a b c d e f", 3, "z"), (4, None, 4, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, sig string")
    out = nd.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["sig"] for r in out.collect()) == ["u", "y", "z"]
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "another text that has no copy"), (3, "twice the same row here now"), (3, "twice the same row here now")]
    out = nd.one_of_each(spark.createDataFrame(rows, DOCS))
    assert sorted(r["text"] for r in out.collect()) == ["a b c d e f", "another text that has no copy", *["twice the same row here now"] * 2]
