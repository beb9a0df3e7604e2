import random
import re

import pytest
from pyspark.sql import functions as F

from kinship.llm import licenses as li

DOCS = "doc_id long, text string"


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]


def bigrams(t):
    w = words(t)
    return set(zip(w, w[1:], strict=False))


def brute(text, t):
    parts = re.split(r"\r\n|[\r\n]", text or "")
    parts += [p for p in re.split(r"(?:\r\n|[\r\n])[ \t]*(?:\r\n|[\r\n])\s*", text or "") if re.search(r"[\r\n]", p)]
    found, n = {}, 0
    for p in parts:
        a = bigrams(p)
        best = {}
        for name, notice in li.TEMPLATES:
            b = bigrams(notice)
            d = 2 * len(a & b) / (len(a) + len(b))
            if a and d >= t - 1e-12:
                best[name] = max(best.get(name, 0), d)
        n += len(best)
        for k, v in best.items():
            found[k] = max(found.get(k, 0), v)
    return n, ",".join(sorted(found)), max(found.values(), default=0.0)


def variants():
    rng = random.Random(4)
    out = [None, "", "\n\n", "one", "License", "Released under the MIT License.", "RELEASED, under; the mit -- license!", "text\r\nLicensed under CC BY-NC 4.0.\rmore"]
    for _, notice in li.TEMPLATES:
        for _ in range(8):
            w = notice.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["foo", "the", "License"])
            line = " ".join(w)
            out.append("prose before it\n" + line + "\nprose after " * rng.randint(0, 30))
            cut = rng.randrange(1, len(w))
            out.append("intro\n\n" + " ".join(w[:cut]) + "\n" + " ".join(w[cut:]) + "\n \nend")
    out.append("filler words go on " * 20000 + "\nReleased under the MIT License.")
    return out


@pytest.mark.parametrize("t", [(4, 5), (1, 2), (1, 1)])
def test_against_brute_force(spark, t):
    rows = [(i, x) for i, x in enumerate(variants())]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "n": F.lit("a"), "part": F.lit(0)})
    got = {r["doc_id"]: r for r in li.license_scan(docs, t).collect()}
    for i, x in rows:
        n, names, best = brute(x, t[0] / t[1])
        assert (got[i]["n_matches"], got[i]["licenses"]) == (n, names), x
        assert got[i]["best_dice"] == pytest.approx(best)


def test_repeats_nulls_and_empty(spark):
    x = "Released under the MIT License."
    out = li.license_scan(spark.createDataFrame([(1, x), (1, x), (None, x), (1, "other")], DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n_matches"], r["best_dice"]) for r in out) == [("1", 0, 0.0), ("1", 1, 1.0), ("1", 1, 1.0), ("None", 1, 1.0)]
    assert li.license_scan(spark.createDataFrame([], DOCS)).count() == 0
    assert li.license_scan(spark.createDataFrame([(1, x)], DOCS), notices=[]).first()["n_matches"] == 0
