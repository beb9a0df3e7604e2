"""Notices inside lines and paragraphs, by the registered query and against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_licenses import DOCS, bigrams, words

from kinship.llm import licenses as li
from kinship.llm import queries as q

ALL = li.TEMPLATES + li.TEXTS


def pairs(w):
    return list(zip(w, w[1:], strict=False))


def brute(text, t):
    text = text or ""
    lines = re.split(r"\r\n|[\r\n]", text)
    paragraphs = re.split(r"(?:\r\n|[\r\n])[ \t]*(?:\r\n|[\r\n])\s*", text)
    whole = []
    for part, p in [*enumerate(lines), *((-1 - i, p) for i, p in enumerate(paragraphs) if re.search(r"[\r\n]", p))]:
        a, best = bigrams(p), {}
        for name, notice in li.TEMPLATES:
            d = 2 * len(a & bigrams(notice)) / (len(a) + len(bigrams(notice)))
            if a and d >= t - 1e-12:
                best[name] = max(best.get(name, 0), d)
        whole += [(k, part, d) for k, d in best.items()]
    line = [i for i, x in enumerate(lines) for _ in words(x)]
    para = [-1 - i for i, x in enumerate(paragraphs) for _ in words(x)]
    a, wins = pairs(words(text)), set()
    for name, notice in ALL:
        b, size = bigrams(notice), len(words(notice))
        for s in {max(0, min(s, len(a) + 1 - size)) for s, x in enumerate(a) if x in b}:
            win = a[s : s + size - 1]
            d = 2 * len(b & set(win)) / (len(b) + len(set(win)))
            if d >= t - 1e-12:
                wins.add((name, s, s + len(win), d))
    n, best, inside = len(whole), [d for _, _, d in whole], {}
    for name, s, stop, d in wins:
        touched = {*line[s : stop + 1], *para[s : stop + 1]}
        counted = any(p in touched and (k == name or e > d) for k, p, e in whole)
        if not counted and not any(k != name and e > d and u <= stop and s <= v for k, u, v, e in wins):
            inside.setdefault(name, []).append((s, -stop))
            best.append(d)
    for v in inside.values():
        end = -1
        for s, back in sorted(v):
            if s > end:
                n, end = n + 1, -back
    return n, ",".join(sorted({*(k for k, _, _ in whole), *inside})), max(best, default=0.0)


def texts():
    rng = random.Random(5)
    out = [None, "", "License", "Released under the MIT License. " * 3]
    for i, (_, notice) in enumerate(ALL):
        w = notice.split()
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randint(0, len(w) // 10)):
                v[rng.randrange(len(v))] = rng.choice(["foo", "the", "License"])
            cut = rng.randrange(1, len(v))
            out.append("Some words of prose stand here. " + " ".join(v) + " And some more follow.")
            out.append("intro words\n" + " ".join(v[:cut]) + rng.choice(["\n", "\n\n", "\r\n \r\n"]) + " ".join(v[cut:]) + " and on\nend\n" + ALL[i - 1][1])
    return out


@pytest.mark.parametrize("t", [(4, 5), (1, 2)])
def test_against_brute_force(spark, t):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "license": F.lit("a"), "b": F.lit(0)})
    got = {r["doc_id"]: r for r in li.license_scan(docs, t, inside=ALL).collect()}
    for i, x in rows:
        n, names, best = brute(x, t[0] / t[1])
        assert (got[i]["n_matches"], got[i]["licenses"]) == (n, names), x
        assert got[i]["best_dice"] == pytest.approx(best)


def test_query_finds_notices_that_share_their_line(spark, tmp_path):
    mit = dict(li.TEXTS)["MIT"]
    rows = [
        (1, "Some words of prose stand here. Licensed under the Apache License, Version 2.0. And some more follow."),
        (2, "Copyright 2020 Foo. Released under the MIT License."),
        (3, "Copyright 2020 Foo. " + mit + " " + "prose goes on " * 500),
        (4, "No notice in this text."),
        (5, "Foo.\n" + next(x for n, x in li.TEXTS if n == "GPL-3.0") + " Bar."),
        (6, "On a page: this work is licensed under the GNU General Public License, version 3."),
    ]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_matches"], r["licenses"]) for r in q.op8_license(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "Apache-2.0"), 2: (1, "MIT"), 3: (1, "MIT"), 4: (0, ""), 5: (1, "GPL-3.0"), 6: (1, "GPL-3.0")}
