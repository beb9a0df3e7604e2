import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kinship.llm.decontaminate import decontaminate, remove_contaminated

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items, size=13):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, s in items:
            v = words(s)
            for a in range(max(1, len(v) - size + 1) if v else 0):
                win = v[a : a + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **k):
    df = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **k)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"]), r["contaminated"]) for r in df.collect()), key=str)


PASSAGE = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals"
ITEM = [(1, PASSAGE), (2, "One Two"), (10, "single"), (3, ""), (4, None), (5, "é É x"), (6, "a b c a b c a b c a b c a b c"), (7, "ΟΔΟΣ'Α ΟΔΟΣ")]
TEXTS = [
    (1, PASSAGE.upper()),
    (2, "before " + PASSAGE.replace(" ", ", ") + " after"),
    (3, " ".join(PASSAGE.split()[:12])),
    (4, "one, TWO! one-two " + "pad " * 200),
    (5, "x single y"),
    (6, None),
    (7, ""),
    (8, "!!! ..."),
    (9, "é É x"),
    (11, "é é x"),
    (12, "a b c " * 9),
    (12, "a b c " * 9),
    (13, " ".join(PASSAGE.split()[2:]) + " " + PASSAGE),
    (None, PASSAGE),
    (14, "filler " * 20000 + PASSAGE),
    (14, "other text, same id"),
    (16, "ΟΔΟΣ Α ΟΔΟΣ'"),
    (15, "İstanbul " + PASSAGE + " ẞ K"),
]


def test_against_brute_force(spark):
    assert run(spark, TEXTS, ITEM) == brute(TEXTS, ITEM)


def test_empty_tables(spark):
    assert run(spark, [], ITEM) == []
    assert run(spark, TEXTS, []) == brute(TEXTS, [])
    assert run(spark, TEXTS, [(1, None), (2, "")]) == brute(TEXTS, [])


def test_null_item_id_hits_without_a_name(spark):
    got = run(spark, [(1, "one two")], [(None, "one two")])
    assert got == [(1, 2, 2, "", True)]


def test_many_windows_share_a_rare_word(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"w{i % 50} " + " ".join(long.split()[i % 40 : i % 40 + 20])) for i in range(200)]
    assert run(spark, docs, [(1, long), (2, long + " end")]) == brute(docs, [(1, long), (2, long + " end")])


def test_removal_keeps_columns_with_any_names(spark):
    rows = [(1, PASSAGE, "a", 7), (2, "clean text", "b", 8), (None, "clean", "c", 9), (2, "clean text", "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_hit int").withColumns({"h": F.lit(1), "w": F.lit(2), "row": F.lit(3)})
    items = spark.createDataFrame([(1, PASSAGE, 5)], "item_id long, text string, key int")
    out = remove_contaminated(docs, items)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["key"], r["n_hit"], r["row"]) for r in out.collect()) == [(0, "c", 9, 3), (2, "b", 8, 3), (2, "b", 8, 3)]


def test_query_digest(spark, tmp_path):
    from kinship.llm.queries import op1_decontaminate

    spark.createDataFrame(TEXTS, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEM, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["doc_id"], r["n_words"]): r["items_sha256"] for r in op1_decontaminate(spark, str(tmp_path)).collect()}
    for i, n, _, ids, _ in brute(TEXTS, ITEM):
        assert got[i, n] == hashlib.sha256(ids.encode()).hexdigest()


@pytest.mark.parametrize("share", [(1, 20), (1, 2)])
def test_share(spark, share):
    docs = [(1, PASSAGE + " pad" * 20), (2, PASSAGE)]
    got = {r[0]: r[4] for r in run(spark, docs, [(1, PASSAGE)], min_share=share)}
    assert got == {1: share == (1, 20), 2: True}
