"""Licence scan: lines, paragraphs and windows of words against licence templates by the Dice coefficient of their word bigrams, in
DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant, row_key, stored
from .decontaminate import loose_words

#: Short notices by which texts name their licence: (SPDX identifier, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Bigrams of a short template.
SHORT = 25
#: Standard headers, bodies of short licences, and headings of the long ones: (SPDX identifier, text).
TEXTS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def _pairs(w: Column) -> Column:
    """Pairs of consecutive words, hashed."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def _bigrams(w: Column) -> Column:
    return F.array_distinct(_pairs(w))


LINE_END = r"\r\n|[\r\n]"
PARAGRAPH_END = r"(\r\n|[\r\n])[ \t]*(\r\n|[\r\n])\s*"


def templates(spark: SparkSession, notices=TEMPLATES) -> DataFrame:
    """(template, license, notice) numbered by place."""
    return constant(spark, [(i, *x) for i, x in enumerate(notices)], "template int, license string, notice string")


def license_matches(docs: DataFrame, min_dice: tuple[int, int] = (4, 5), notices=TEMPLATES, text: str = "text", key: str = "key") -> DataFrame:
    """(key, part, license, dice): each line (part 0 and up), and each paragraph of more than one line (part -1 and down), that matches
    a template, with the template's licence. docs needs key, which tells rows apart.

    Only parts with a word that some template makes necessary are cut into bigrams. With a and b distinct bigrams, a Dice coefficient
    of t needs a and b to be within t / (2 - t) of each other; a template whose size is out of that range for a part is no candidate.
    Parts of under two words have no bigrams and match nothing."""
    up, down = min_dice
    spark = docs.sparkSession
    t = templates(spark, notices).select("template", "license", _bigrams(loose_words(F.col("notice"))).alias("b"))
    t = t.select("template", "license", F.size("b").alias("m"), F.explode("b").alias("h"))
    t = F.broadcast(t)  # fixed in number by the list of notices
    lines = F.transform(F.split(F.col(text), LINE_END), lambda x, i: F.struct(i.alias("part"), x.alias("s")))
    paragraphs = F.transform(F.split(F.col(text), PARAGRAPH_END), lambda x, i: F.struct((-1 - i).alias("part"), x.alias("s")))
    parts = F.concat(lines, F.filter(paragraphs, lambda p: p["s"].rlike(r"[\r\n]")))
    sizes = [len(set(zip(w, w[1:]))) for w in (_plain_words(n) for _, n in notices)]
    words = necessary(notices, min_dice)
    least, most = min(sizes, default=0) * up, max(sizes, default=0) * (2 * down - up)
    p = docs.where(_has_any(F.lower(F.col(text)), words)).select(key, F.explode(parts).alias("p"))
    p = p.where(_has_any(F.lower(F.col("p.s")), words))
    p = p.select(key, F.col("p.part").alias("part"), _bigrams(loose_words(F.col("p.s"))).alias("b")).withColumn("n", F.size("b"))
    p = p.where((F.col("n") * (2 * down - up) >= least) & (F.col("n") * up <= most))
    hit = p.select(key, "part", "n", F.explode("b").alias("h")).join(t, "h")
    hit = hit.where((F.col("n") * (2 * down - up) >= F.col("m") * up) & (F.col("m") * (2 * down - up) >= F.col("n") * up))
    both = hit.groupBy(key, "part", "template", "license", "n", "m").agg(F.count_distinct("h").alias("c"))  # rows that agree in key count once
    both = both.where(2 * F.col("c") * down >= (F.col("n") + F.col("m")) * up)
    return both.groupBy(key, "part", "license").agg(F.max(2 * F.col("c") / (F.col("n") + F.col("m"))).alias("dice"))


def notices_inside(docs: DataFrame, min_dice: tuple[int, int] = (4, 5), notices=TEMPLATES, text: str = "text", key: str = "key") -> DataFrame:
    """(key, license, start, stop, parts, dice): each window of a text's words that matches a template. A window begins wherever a
    bigram of the template does, and holds as many words as the template: near the end of a text it is its last words, and a shorter
    text is one window. It may cross line ends and blank lines. start and stop are its first and last word; parts are the lines and
    paragraphs, numbered as in license_matches, it touches.

    A template is looked for in a text that has enough of its bigrams anywhere, and a window is cut where enough of them begin."""
    up, down = min_dice
    spark = docs.sparkSession
    t = templates(spark, notices).select("template", "license", loose_words(F.col("notice")).alias("w"))
    t = t.select("template", "license", F.size("w").alias("size"), _bigrams(F.col("w")).alias("tb")).withColumn("m", F.size("tb"))
    t = t.withColumn("least", F.ceil(F.col("m") * up / (2 * down - up) - F.lit(1e-9)).cast("int"))
    t = F.broadcast(t.groupBy().agg(F.collect_list(F.struct("template", "license", "size", "m", "least", "tb")).alias("ts")))  # one row
    d = docs.where(_has_any(F.lower(F.col(text)), necessary(notices, min_dice))).select(key, text, _pairs(loose_words(F.col(text))).alias("b"))
    # Of the text's bigrams those that some template has are few; each template is tried against these.
    d = d.crossJoin(t).withColumn("of", F.array_intersect("b", F.flatten(F.transform("ts", lambda x: x["tb"]))))
    d = d.select(key, text, "b", F.explode(F.filter("ts", lambda x: F.size(F.array_intersect(x["tb"], F.col("of"))) >= x["least"])).alias("t"))
    at = F.filter(F.transform("b", lambda x, i: F.when(F.array_contains(F.col("t.tb"), x), i)), lambda i: i.isNotNull())
    d = d.select(key, text, "b", "t", at.alias("at"))
    last = lambda i: F.try_element_at(F.col("at"), (i + F.col("t.least")).cast("int"))
    starts = F.filter("at", lambda x, i: F.coalesce(last(i) <= x + F.col("t.size") - 2, F.lit(False)))
    d = d.select(key, text, "b", "t", F.explode(starts).alias("start"))
    d = d.withColumn("start", F.greatest(F.lit(0), F.least("start", F.size("b") + 1 - F.col("t.size"))))
    d = d.withColumn("win", F.slice("b", F.col("start") + 1, F.col("t.size") - 1))
    d = d.withColumn("n", F.size(F.array_distinct("win"))).withColumn("c", F.size(F.array_intersect("win", F.col("t.tb"))))
    d = d.where(2 * F.col("c") * down >= (F.col("n") + F.col("t.m")) * up).withColumn("stop", F.col("start") + F.size("win"))
    d = d.select(key, text, "t.license", "start", "stop", (2 * F.col("c") / (F.col("n") + F.col("t.m"))).alias("dice"))
    d = d.groupBy(key, text, "license").agg(F.collect_set(F.struct("start", "stop", "dice")).alias("wins"))
    numbers = lambda end, no: F.flatten(F.transform(F.split(F.col(text), end), lambda x, i: F.array_repeat(no(i), F.size(loose_words(x)))))
    d = d.select(key, "license", "wins", numbers(LINE_END, lambda i: i).alias("line"), numbers(PARAGRAPH_END, lambda i: -1 - i).alias("para"))
    touched = lambda of, w: F.array_distinct(F.slice(of, w["start"] + 1, w["stop"] - w["start"] + 1))
    wins = F.transform("wins", lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop"), F.concat(touched("line", w), touched("para", w)).alias("parts"), w["dice"].alias("dice")))
    return d.select(key, "license", F.explode(wins).alias("w")).select(key, "license", "w.*")


def _disjoint(wins: Column) -> Column:
    """Windows of a list sorted by start, longest first, without those that overlap one taken before, counted."""
    step = lambda s, w: F.when(w["start"] > s["stop"], F.struct((s["n"] + 1).alias("n"), (-w["back"]).alias("stop"))).otherwise(s)
    return F.aggregate(wins, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("stop")), step, lambda s: s["n"])


def necessary(notices, min_dice: tuple[int, int]) -> set[str]:
    """Words of which a part that matches a template has one at least. A match shares t / (2 - t) of the template's m bigrams or more,
    so of any m less that, plus one, it has one; the bigrams with the longest words are taken, and of each its longer word. Of a long
    template those are taken that the fewest words cover, words of others first."""
    up, down = min_dice
    out = set()
    for _, notice in sorted(notices, key=lambda x: len(x[1])):
        w = _plain_words(notice)
        pairs = set(zip(w, w[1:]))
        shared = -(-len(pairs) * up // (2 * down - up))
        if len(pairs) <= SHORT:
            pairs = sorted(pairs, key=lambda p: (-max(map(len, p)), p))
            out |= {max(p, key=lambda x: (len(x), x)) for p in pairs[: len(pairs) - shared + 1]}
            continue
        need, left = len(pairs) - shared + 1, {p for p in pairs if not out & set(p)}
        while len(pairs) - len(left) < need:
            words = {x for p in left for x in p}
            words = {x for x in words if len(x) > 5} or words
            best = max(words, key=lambda x: (sum(x in p for p in left), len(x), x))
            out.add(best)
            left = {p for p in left if best not in p}
    return out


def _has_any(low: Column, words: set[str]) -> Column:
    """Whether lower-cased text may have some of the words: long ones as parts of words too, which is fast; short ones by themselves."""
    long = [w for w in sorted(words, key=len) if len(w) > 3]
    long = [w for i, w in enumerate(long) if not any(v in w for v in long[:i])]
    out = F.lit(False)
    for w in long:
        out = out | F.contains(low, F.lit(w))
    if short := [w for w in sorted(words) if len(w) <= 3]:
        inside = r"[0-9a-z\x{80}-\x{10FFFF}]"
        out = out | low.rlike(f"(?<!{inside})(?:{'|'.join(short)})(?!{inside})")
    return out


def _plain_words(notice: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in notice.lower()).split()


def license_scan(docs: DataFrame, min_dice: tuple[int, int] = (4, 5), notices=TEMPLATES, doc_id: str = "doc_id", text: str = "text", inside=()) -> DataFrame:
    """For each row of docs: doc_id, n_matches (parts and licences that match), licenses (distinct, sorted, comma-joined) and best_dice,
    the highest coefficient (0 without a match). Null and empty texts match nothing; rows stand for themselves, ids may repeat or be
    null (rows that agree in id and text get the same result); other columns are not read.

    Windows of words that match a notice of inside count too, of a licence from the first on those that do not overlap one before. Left out are those
    that touch a part which matches the same licence as a whole, as that part is counted, and those that touch a part or a window
    which matches another licence better, as licences differ in few words."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d = d.withColumn("key", row_key("doc_id", "text"))
    m = license_matches(d, min_dice, notices).select("key", "license", "part", "dice").withColumn("n", F.lit(1))
    if inside:
        whole = stored(m, "licenses")
        w = notices_inside(d, min_dice, inside).groupBy("key").agg(F.collect_set(F.struct("license", "start", "stop", "parts", "dice")).alias("wins"))
        w = w.join(whole.groupBy("key").agg(F.collect_list(F.struct("license", "part", "dice")).alias("whole")), "key", "left")
        counted = lambda v: F.exists("whole", lambda x: F.array_contains(v["parts"], x["part"]) & ((x["license"] == v["license"]) | (x["dice"] > v["dice"])))
        better = lambda v: F.exists("wins", lambda x: (x["license"] != v["license"]) & (x["dice"] > v["dice"]) & (x["start"] <= v["stop"]) & (v["start"] <= x["stop"]))
        w = w.select("key", F.explode(F.filter("wins", lambda v: ~F.coalesce(counted(v), F.lit(False)) & ~better(v))).alias("w")).select("key", "w.*")
        w = w.groupBy("key", "license").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("stop")).alias("back")))).alias("w"), F.max("dice").alias("dice"))
        m = whole.select("key", "license", "dice", "n").unionByName(w.select("key", "license", "dice", _disjoint(F.col("w")).alias("n")))
    m = m.groupBy("key").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("dice"))
    out = d.select("doc_id", "key").join(m, "key", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("dice", F.lit(0.0)).alias("best_dice"))
