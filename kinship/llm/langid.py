"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

A text's subwords are the runs of 2, 3 and 4 bytes inside its words, a space added at both ends, letters lower-cased; each falls into
one of 2**BITS buckets, each bucket has an embedding. The text's vector is the average of its subwords' embeddings, and a softmax
over a linear map of it gives the languages' probabilities. Training runs in numpy on counts of subwords. As the map is linear, a
prediction averages the buckets' scores for each language, so that the time goes into one gather a byte.

Scores are calibrated on labelled rows that training did not see: a temperature is fitted to their log likelihood, and the
rejection threshold is the score that all but a given share of their right answers reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, lean, released
from .textbytes import LOWER, pieces

BITS, DIM, GRAMS = 15, 16, (2, 3, 4)
#: The name of no language.
UNKNOWN = "und"
_MULT = [np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)]


def _folded() -> np.ndarray:
    """Bytes with A-Z lower-cased and ASCII other than letters as spaces: digits and marks tell no language."""
    out = LOWER.copy()
    ascii_ = np.arange(128)
    out[:128][~np.isin(out[:128], np.arange(97, 123)) & (ascii_ < 128)] = 32
    return out


_FOLD = _folded()


def subwords(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each subword length: (length, bucket of the subword that begins at each byte, whether it counts). A subword counts
    unless it has a space inside or is nothing but spaces."""
    d = _FOLD[data]
    space = d == 32
    h = d.astype(np.uint32)
    for g in range(2, max(GRAMS) + 1):
        m = len(d) - g + 1
        if m <= 0:
            return
        h = (h[:m] * np.uint32(0x01000193)) ^ (d[g - 1 :].astype(np.uint32) + np.uint32(g))
        inner = np.ones(m, bool)
        for i in range(1, g - 1):
            inner &= ~space[i : i + m]
        inner &= ~(space[:m] & space[g - 1 :])
        if g in GRAMS:
            x = h * _MULT[g - 2]
            x ^= x >> np.uint32(15)
            yield g, (x >> np.uint32(32 - BITS - 3)) & np.uint32((1 << BITS) - 1), inner


def _spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows apart: two spaces between them, so that no subword reaches over."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    to = offsets[:-1] + 2 * np.arange(1, n + 1)
    out = np.full(len(data) + 2 * (n + 1), 32, np.uint8)
    out[np.arange(len(data)) + 2 * (np.repeat(np.arange(n), size) + 1)] = data
    return out, np.append(to, len(data) + 2 * (n + 1))


@lean
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label and (bucket, count) of each row: at most 2**BITS of them, whatever the text's length."""
    for b in batches:
        ids, counts, labels = [], [], []
        for at, end, data, offsets in pieces(b.column(1), 1 << 20):
            for i in range(end - at):
                d = np.concatenate(([32], data[offsets[i] : offsets[i + 1]], [32])).astype(np.uint8)
                c = np.zeros(1 << BITS, np.int64)
                for _, h, ok in subwords(d):
                    c += np.bincount(h[ok], minlength=1 << BITS)
                ids.append(np.flatnonzero(c).astype(np.int32).tolist())
                counts.append(c[c > 0].tolist())
                labels.append(b.column(0)[at + i].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["lang", "ids", "counts"])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    scores: np.ndarray  #: (buckets, languages): embedding times map, and the temperature
    bias: np.ndarray
    threshold: float

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language's number, its probability) of each row."""
        d, at = _spread(data, offsets)
        n, k = len(offsets) - 1, len(self.langs)
        total, number = np.zeros((n, k)), np.zeros(n)
        for _, h, ok in subwords(d):
            idx = np.append(np.where(ok, h, np.uint32(1 << BITS)), np.full(len(d) - len(h) + 1, 1 << BITS, np.uint32))
            for j in range(k):
                total[:, j] += np.add.reduceat(self.scores[j][idx], at[:-1]) if n else 0
            number += np.add.reduceat(idx[:-1] != 1 << BITS, at[:-1], dtype=np.int64) if n else 0
        z = total / np.maximum(number, 1)[:, None] + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(n), best]


def learned(x: list[dict], y: np.ndarray, k: int, epochs: int = 6, rate: float = 0.8, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings times map, bias) by stochastic gradient descent on the softmax's cross entropy, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM
    out, bias = np.zeros((DIM, k)), np.zeros(k)
    steps, at = epochs * ((len(x) + batch - 1) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo : lo + batch]
            ids = np.concatenate([x[i]["ids"] for i in rows])
            weight = np.concatenate([x[i]["weight"] for i in rows])
            own = np.repeat(np.arange(len(rows)), [len(x[i]["ids"]) for i in rows])
            v = np.zeros((len(rows), DIM))
            np.add.at(v, own, emb[ids] * weight[:, None])
            z = v @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            lr = rate * (1 - at / steps)
            at += 1
            back = p @ out.T
            out -= lr * (v.T @ p)
            bias -= lr * 0.1 * p.mean(0)
            np.add.at(emb, ids, -lr * weight[:, None] * back[own] * DIM)
    return emb @ out, bias


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", most: int = 600, reject_share: float = 0.001) -> Model:
    """Fit on the rows of labelled whose lang and text are not null.

    most bounds the distinct texts of each language that are looked at, those of the least hashes; copies count once, and all texts of
    a rare language are kept. Texts are thinned by their hash first, so that no task orders many. Only subword counts reach the
    driver, 2**BITS a text at most; languages are classes of the model, and so are listed there too. A fifth of the sample calibrates. reject_share: the share of right answers that the threshold may reject. With no labelled row the model has no
    languages, and predicts UNKNOWN."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    total = {r["lang"]: r["n"] for r in rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(total)
    if not langs:
        return Model([], np.zeros((0, (1 << BITS) + 1), np.float32), np.zeros(0), 0.0)
    # So many that fewer than `most` of a language are left with a chance of less than 1e-9.
    share = F.create_map(*(F.lit(v) for x in langs for v in (x, min(1.0, (most + 10 * most**0.5 + 50) / total[x]))))
    die = F.pmod(F.col("hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("die", "hash"))
    sample = rows.withColumn("die", die).where(F.col("die") < share[F.col("lang")]).groupBy("lang", "hash", "die").agg(F.min("text").alias("text"))
    sample = sample.withColumn("place", place).where(F.col("place") <= most).select("lang", "text")
    got = sample.mapInArrow(_counts, "lang string, ids array<int>, counts array<long>").toArrow()
    x = []
    for b in got.to_batches():
        ids, counts = (c.values.to_numpy(zero_copy_only=False) for c in b.columns[1:])
        at = b.column(1).offsets.to_numpy()
        for i, lang_ in enumerate(b.column(0).to_pylist()):
            mine, often = ids[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]
            if len(mine):
                x.append({"y": langs.index(lang_), "ids": mine, "weight": often / often.sum(), "key": (mine.tobytes(), often.tobytes())})
    if not x:
        return Model(langs, np.zeros((len(langs), (1 << BITS) + 1), np.float32), np.zeros(len(langs)), 0.0)
    x.sort(key=lambda r: (r["y"], r["key"]))  # whatever the order in which rows came
    y = np.array([r["y"] for r in x])
    held = np.arange(len(x)) % 5 == 4
    train = np.flatnonzero(~held)
    scores, bias = learned([x[i] for i in train], y[train], len(langs))
    z = np.array([r["weight"] @ scores[r["ids"]] + bias for r in x])[held]
    best, temper = None, 1.0
    for t in np.geomspace(0.05, 20, 60) if held.any() else ():
        q = z / t
        q = q - q.max(1, keepdims=True)
        loss = -(q[np.arange(len(q)), y[held]] - np.log(np.exp(q).sum(1))).mean()
        if best is None or loss < best:
            best, temper = loss, t
    threshold = 0.0
    if held.any():
        q = np.exp((z - z.max(1, keepdims=True)) / temper)
        q /= q.sum(1, keepdims=True)
        right = q.max(1)[q.argmax(1) == y[held]]
        threshold = float(np.sort(right)[int(reject_share * len(right))]) if len(right) else 0.0
    table = np.zeros((len(langs), (1 << BITS) + 1), np.float32)
    table[:, :-1] = (scores / temper).T
    return Model(langs, table, bias / temper, min(threshold, 0.5))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected added; columns of these names are replaced. See judged()."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return judged(docs, model, text).select(*kept, "lang_pred", "score", "rejected")


def judged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, lang_pred, score, rejected): each row of docs as a struct, with what the model says of its text.

    A text that is null or has no letter is UNKNOWN with score 0 and rejected; another gets the most probable language, and is
    rejected if its score is under the model's threshold. Equal texts get equal results; only the text is read."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers a language
    langs = model.langs

    def run(column: pa.Array) -> pa.Array:
        kept(__name__)
        m = held.value
        best, score = [], []
        if langs:
            for _, _, data, offsets in pieces(column, 1 << 20):
                b, s = m(data, offsets)
                best.append(b)
                score.append(s)
        best = np.concatenate(best or [np.zeros(len(column), np.int64)])
        score = np.concatenate(score or [np.zeros(len(column))])
        names = pa.array(langs or [UNKNOWN], pa.string()).take(pa.array(best))
        released()
        return pa.StructArray.from_arrays([names, pa.array(score, pa.float64())], ["lang", "score"])

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    guess = F.arrow_udf(run, "lang string, score double")(F.col(text))
    known = F.coalesce(has_letter(F.col(text)), F.lit(False)) & F.lit(bool(langs))
    out = docs.select(F.struct(*docs.columns).alias("row"), known.alias("known"), guess.alias("p"))
    out = out.select("row", F.when(F.col("known"), F.col("p.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("known"), F.col("p.score")).otherwise(0.0).alias("score"))
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < model.threshold))


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))
