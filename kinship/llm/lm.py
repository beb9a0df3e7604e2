"""Language-model scores by a weighted backoff automaton.

States are the n-grams of the training texts shorter than the model's order, the empty one being the root; an arc of a state reads a
word that followed it there, and leads to the longest state that ends what has been read. With c counts, p the probability one order
below and m the strength of smoothing, the arc of word w from state h weighs

    log10((c(hw) + m p(w)) / (c(h) + m)),

and its failure arc, to the state without the oldest word, which reads nothing, weighs log10(m / (c(h) + m)), so that each state's
words sum to 1. The root's words weigh log10((c(w) + 0.5) / (N + 0.5 (V + 1))); a word that training lacks leads back to the root. A
text is read once from left to right, from the state of a text's begin; its end is a word. Reading a word from a state, failure arcs
are followed until a state has an arc for it. The state after a word is where the arc of the longest n-gram that ends there leads; so
all words of a chunk are read at once, each from the state that is expected before it, and those reads are the walk if each leads to
the state expected after it. A text of which one does not is walked word by word.

The automaton grows with the corpus and is never in one place. Texts are packed into chunks of some megabytes, in the order of the
table. Each chunk sends the distinct n-grams of its texts, with their counts in its training texts, to buckets by the n-gram's hash,
packed as one row for each chunk, order and bucket that has some, so never more rows than n-grams; a bucket adds up and answers with
the corpus's counts in the same order. From three words on, an n-gram is sent only if both its parts of one word less come in other
chunks too, as otherwise the chunk has all that there is of it; so each order from the third takes a round of its own. A chunk thus
gets the part of the automaton that its texts can reach. A hot word or n-gram is one number in each chunk; buckets are as many as the
corpus's size asks for.

N-grams are told apart by 64 bits of a hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import estimated_bytes, lean, released, small_batches, stored
from .langid import fold
from .textbytes import combined, pieces, word_hashes

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bytes of text in a chunk, unless one text has more, and megabytes of the table that a bucket answers for.
CHUNK, BUCKET_MB = 4 << 20, 6
#: Words that are read at once.
_AT_ONCE = 1 << 17
CHUNKS = "chunk long, doc_id array<long>, held_out array<boolean>, size array<long>, texts binary"
ASKED = "bucket long, n int, chunk long, size long, keys binary, counts binary"
_ASKED = [c.split()[0] for c in ASKED.split(", ")]
ANSWERS = "chunk long, n int, bucket long, size long, counts binary, tokens long, words long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@lean
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) as chunks, one row each."""
    number, held, size, ids, out, texts = TaskContext.get().partitionId() << 32, 0, [], [], [], []

    def chunk() -> pa.RecordBatch:
        raw = b"".join(texts)
        columns = [[number], [ids], [out], [size], [pa.compress(raw, "zstd", asbytes=True) if raw else b""]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()), strict=True)], ["chunk", "doc_id", "held_out", "size", "texts"])

    for b in batches:
        for doc_id, held_out, text in zip(*(b.column(i) for i in range(3)), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if ids and held + len(raw) > CHUNK:
                yield chunk()
                number, held, size, ids, out, texts = number + 1, 0, [], [], [], []
            for to, x in ((ids, doc_id.as_py()), (out, held_out.as_py()), (size, len(raw)), (texts, raw)):
                to.append(x)
            held += len(raw)
    if ids:
        yield chunk()


def _texts(size: pa.Scalar, data: pa.Scalar) -> pa.Array:
    """The texts of a chunk."""
    ends = np.append(0, np.cumsum(size.values.to_numpy(zero_copy_only=False)))
    raw = pa.decompress(data.as_py(), int(ends[-1]), "zstd") if ends[-1] else pa.py_buffer(b"")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), raw])


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each token of a column of texts: its words, then END."""
    hashes, rows = [], []
    for at, end, data, offsets in pieces(column, 1 << 20):
        h, row = word_hashes(data, offsets)
        size = np.bincount(row, minlength=end - at) + 1
        out = np.full(int(size.sum()), END)
        ends = np.cumsum(size)
        out[np.arange(len(h)) + row] = h
        hashes.append(out)
        rows.append(at + np.repeat(np.arange(end - at), np.diff(ends, prepend=0)))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def _grams(h: np.ndarray, row: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each order from 1: a key of the n-gram that ends at each token, words before the text's begin being BEGIN."""
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    key, back = h, h
    for n in range(1, order + 1):
        if n > 1:
            back = np.where(first, BEGIN, np.concatenate((back[:1], back[:-1])))
            key = combined(key, back)
        yield combined(key, np.uint64(n) * np.ones(1, np.uint64))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, in ascending order with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, byte by byte of equal weight, compressed."""
    return _pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack_numbers(data, n).view(np.uint64))


def _pack_numbers(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unpack_numbers(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T).reshape(-1).view("<u8").astype(np.int64)


@dataclass(frozen=True)
class _Grams:
    """A chunk's n-grams of one order: the number of the one that ends at each token, among the distinct ones in the order of their
    keys; how often the chunk's training texts have each, and the corpus's; and which the chunk asks for."""

    number: np.ndarray
    keys: np.ndarray
    own: np.ndarray
    total: np.ndarray
    asked: np.ndarray


def _counted(h: np.ndarray, row: np.ndarray, trains: np.ndarray, order: int, answers: dict[int, np.ndarray]) -> Iterator[_Grams]:
    """The n-grams of each order from 1. Words and pairs are asked for; of longer ones only those of which both parts that lack a word
    at an end come in other chunks too: otherwise all that the corpus has of the n-gram is here, and no one else asks for it. answers:
    by order, what the corpus has of those asked for, doubled, and 1 more for those that several chunks have; without one, own counts
    stand in."""
    opens = np.ones(len(row), bool)
    opens[1:] = row[1:] != row[:-1]
    before, shared = None, None
    for n, g in enumerate(_grams(h, row, order), 1):
        by_key, which, first = _groups(g)
        number = np.empty(len(g), np.int32)
        number[by_key] = which
        own = np.add.reduceat(trains[by_key].astype(np.int64), first) if len(g) else np.zeros(0, np.int64)
        at = by_key[first]  # a token at which each ends
        asked = np.ones(len(first), bool) if n < 3 else shared[before[at]] & (opens[at] | shared[before[at - 1]])
        total, several = own.copy(), np.zeros(len(own), bool)
        if n in answers:
            if len(answers[n]) != asked.sum():
                raise RuntimeError("a chunk's texts are not those that it asked for")
            total[asked], several[asked] = answers[n] >> 1, answers[n] & 1
        before, shared = number, several
        yield _Grams(number, g[by_key][first], own, total, asked)


def _packed(chunk: int, n: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """N-grams and their counts, a row for each bucket that has some."""
    own = _bucket(keys, buckets)
    edges = np.append(np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1))), len(own))
    many = len(edges) - 1
    columns = [own[edges[:-1]].astype(np.int64), np.full(many, n, np.int32), np.full(many, chunk), np.diff(edges)]
    packed = [[f(x[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)] for f, x in ((_pack, keys), (_pack_numbers, counts))]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *(pa.array(p, pa.binary()) for p in packed)], _ASKED)


def _asked(order: int, buckets: int):
    """A chunk's words and pairs."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held_out, size, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                h, row, trains = _read(held_out, size, data)
                for n, g in enumerate(_counted(h, row, trains, order, {}), 1):
                    yield _packed(chunk.as_py(), n, g.keys, g.own, buckets)

    return run


def _asked_next(n: int, buckets: int):
    """A chunk's n-grams of the next order, those that need asking for."""

    def run(t: pa.Table, right: pa.Table) -> pa.Table:
        released()
        h, row, trains = _read(*(t.column(c)[0] for c in ("held_out", "size", "texts")))
        *_, g = _counted(h, row, trains, n, _unpacked(right))
        return pa.Table.from_batches([_packed(t.column("chunk")[0].as_py(), n, g.keys[g.asked], g.own[g.asked], buckets)])

    return run


def _read(held_out: pa.Scalar, size: pa.Scalar, texts: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, whether training reads it) of each token of a chunk."""
    h, row = _tokens(_texts(size, texts))
    return h, row, ~held_out.values.to_numpy(zero_copy_only=False).astype(bool)[row]


def _unpacked(answers: pa.Table) -> dict[int, np.ndarray]:
    """By order, the counts of what a chunk asked for, in the order of the keys."""
    rows = sorted(zip(answers.column("n").to_pylist(), answers.column("bucket").to_pylist(), range(len(answers)), strict=True))
    size, counts = answers.column("size").to_pylist(), answers.column("counts")
    return {n: np.concatenate([_unpack_numbers(counts[i].as_py(), size[i]) for _, _, i in own]) for n, own in itertools.groupby(rows, lambda r: r[0])}


def _answered(key: tuple, t: pa.Table) -> pa.Table:
    """The counts over all chunks, doubled, and 1 more where several chunks ask, to each chunk in the order of its keys; the bucket's
    totals stand in its first row."""
    rows = t.to_pydict()
    sizes = rows["size"]
    keys = np.concatenate([_unpack(k, n) for k, n in zip(rows["keys"], sizes, strict=True)])
    counts = np.concatenate([_unpack_numbers(c, n) for c, n in zip(rows["counts"], sizes, strict=True)])
    order, which, first = _groups(keys)
    total = np.add.reduceat(counts[order], first)
    several = np.diff(first, append=len(keys)) > 1
    out = np.empty(len(keys), np.int64)
    out[order] = (total << 1 | several)[which]
    ends = np.cumsum(sizes)
    rest = [0] * (len(sizes) - 1)
    return pa.table(
        {
            "chunk": t.column("chunk"),
            "n": t.column("n"),
            "bucket": t.column("bucket"),
            "size": t.column("size"),
            "counts": pa.array([_pack_numbers(out[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary()),
            "tokens": pa.array([int(total.sum()), *rest], pa.int64()),
            "words": pa.array([int((total > 0).sum()), *rest], pa.int64()),
        }
    )


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts the keys, number of the distinct key at each place of that order, where each distinct key begins in it)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


@dataclass(frozen=True)
class Automaton:
    """States are numbers from 0, the root; arcs lie in the order of key, state times words plus word."""

    words: int
    key: np.ndarray
    weight: np.ndarray
    to: np.ndarray
    fail: np.ndarray  #: each state's failure arc: the state that it leads to, and its weight
    fail_weight: np.ndarray
    unknown: float  #: the weight of a word that the root has no arc for
    start: int
    expected: np.ndarray | None = None  #: the state expected after each token of the texts that it was made for

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, weight) of reading a word from a state, for many at once."""
        to, total = np.zeros(len(state), np.int64), np.zeros(len(state))
        left, at = np.arange(len(state)), state
        while len(left):
            key = at * self.words + word[left]
            i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            has = self.key[i] == key if len(self.key) else np.zeros(len(key), bool)
            done = left[has]
            total[done] += self.weight[i[has]]
            to[done] = self.to[i[has]]
            left, at = left[~has], at[~has]
            total[left[at == 0]] += self.unknown
            left, at = left[at > 0], at[at > 0]
            total[left] += self.fail_weight[at]
            at = self.fail[at]
        return to, total


def automaton(grams: list[np.ndarray], counts: list[np.ndarray], row: np.ndarray, tokens: int, words: int, begins: int, strength: list[float]) -> tuple[Automaton, np.ndarray]:
    """(the part of the automaton that some texts can reach, the root's probability of each word). grams: for each order from 1 the
    number of the n-gram that ends at each token, among the distinct ones; counts: how often training has each of those; row: the text
    of each token; tokens, words, begins: N, V and the number of training texts; strength: m for each order from 2."""
    order = len(grams)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    opens = np.zeros(len(row), bool)
    opens[first] = True
    # States: the root; for each order below the model's, the begin of a text, then the n-grams.
    base = np.cumsum([1, *(1 + len(c) for c in counts[: order - 1])])
    fail, fail_weight = np.zeros(base[-1], np.int64), np.zeros(base[-1])
    seen = np.zeros(base[-1])  # how often training reads a word from a state
    keys, weights, targets = [], [], []
    expected = np.zeros(len(row), np.int64)
    below = None
    for n in range(1, order + 1):
        g, c = grams[n - 1], counts[n - 1].astype(float)
        at = np.zeros(len(c), np.int64)
        at[g] = np.arange(len(g))  # a token at which each n-gram ends
        word = grams[0][at]
        if n == 1:
            p, state = (c + 0.5) / (tokens + 0.5 * (words + 1)), np.zeros(len(c), np.int64)
        else:
            m = strength[n - 2]
            state = np.where(opens[at], base[n - 2], base[n - 2] + 1 + grams[n - 2][at - 1])
            p = (c + m * below[grams[n - 2][at]]) / (seen[state] + m)
        if n < order:
            own = base[n - 1] + 1 + np.arange(len(c))
            seen[base[n - 1]], seen[own] = begins, c
            shorter = base[n - 2] + 1 + grams[n - 2][at] if n > 1 else 0
            fail[own], fail[base[n - 1]] = shorter, base[n - 2] if n > 1 else 0
            for i in (own, base[n - 1]):
                fail_weight[i] = np.log10(strength[n - 1] / (seen[i] + strength[n - 1]))
        else:
            own = base[n - 2] + 1 + grams[n - 2][at] if n > 1 else np.zeros(len(c), np.int64)
        has = c > 0
        keys.append((state * max(1, len(counts[0])) + word)[has])
        weights.append(np.log10(p[has]))
        targets.append(own[has])
        expected = np.where(has[g], own[g], expected)
        below = p
        root = p if n == 1 else root  # noqa: F821
    key = np.concatenate(keys)
    by = np.argsort(key)
    unknown = float(np.log10(0.5 / (tokens + 0.5 * (words + 1))))
    start = int(base[order - 2]) if order > 1 else 0
    return Automaton(max(1, len(counts[0])), key[by], np.concatenate(weights)[by], np.concatenate(targets)[by], fail, fail_weight, unknown, start, expected), root


def walked(a: Automaton, word: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
    """The log10 probability of each text, whose words lie one after the other, read from left to right with the state carried on."""
    if a.expected is None:
        return _stepped(a, word, row, texts)
    before = np.full(len(row), a.start)
    same = row[1:] == row[:-1]
    before[1:][same] = a.expected[:-1][same]
    weight, wrong = np.empty(len(row)), np.zeros(texts, bool)
    for lo in range(0, len(row), _AT_ONCE):
        own = slice(lo, lo + _AT_ONCE)
        to, weight[own] = a.read(before[own], word[own])
        wrong[row[own][to != a.expected[own]]] = True
    score = np.bincount(row, weight, texts)
    if wrong.any():
        again = wrong[row]
        score[wrong] = _stepped(a, word[again], (np.cumsum(wrong) - 1)[row[again]], int(wrong.sum()))
    return score


def _stepped(a: Automaton, word: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
    """walked(), a word of all texts at a time."""
    size = np.bincount(row, minlength=texts)
    begin = np.cumsum(size) - size
    longest = np.argsort(-size, kind="stable")
    lanes = np.searchsorted(-size[longest], -np.arange(int(size.max(initial=0))), "left")  # texts that have a word at each step
    state, score, begin = np.full(texts, a.start), np.zeros(texts), begin[longest]
    for step, k in enumerate(lanes.tolist()):
        state[:k], weight = a.read(state[:k], word[begin[:k] + step])
        score[:k] += weight
    out = np.empty(texts)
    out[longest] = score
    return out


def _scored(order: int, tokens: int, words: int, begins: int, strength: list[float]):
    def run(t: pa.Table, right: pa.Table) -> pa.Table:
        released()
        h, row, trains = _read(*(t.column(c)[0] for c in ("held_out", "size", "texts")))
        answers = _unpacked(right)
        found = [(g.number, g.total) for g in _counted(h, row, trains, order, {n: answers.get(n, np.zeros(0, np.int64)) for n in range(1, order + 1)})]
        del h, trains, answers
        grams, counts = [g for g, _ in found], [c for _, c in found]
        a, root = automaton(grams, counts, row, tokens, words, begins, strength)
        ids, held_out = t.column("doc_id")[0].values, t.column("held_out")[0].values
        score = walked(a, grams[0], row, len(ids))
        base = np.bincount(row, np.log10(root)[grams[0]], len(ids))
        n_tokens, known = np.bincount(row, minlength=len(ids)), np.bincount(row, counts[0][grams[0]] > 0, len(ids)).astype(np.int64)
        columns = {"n_tokens": n_tokens, "n_known": known, "train_tokens": np.full(len(ids), tokens), "base_score": base, "score": score}
        return pa.table({"doc_id": ids, "held_out": held_out} | columns)

    return run


def lm_scores(docs: DataFrame, held_out, order: int = 3, strength: tuple[float, ...] = (20.0, 4.0), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, held_out, n_tokens, n_known (tokens that training has), train_tokens, base_score (the root's
    log10 probability of the text) and score (the automaton's).

    held_out, a boolean column, tells the rows that training leaves out; null counts as false. order is 1 at least, strength has m for
    each order from 2. Null and empty texts are an end alone. Rows stand for themselves; ids, which are cast to long, may repeat or be
    null; other columns are not read. Without training rows N and V are 0, and every score is 0."""
    if order < 1 or len(strength) < order - 1 or min(strength[: order - 1], default=1) <= 0:
        raise ValueError("order is 1 at least, with a strength above 0 for each order from 2")
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    with small_batches(spark):
        chunks = stored(d.mapInArrow(_chunks, CHUNKS), "chunks", rows=4)
        buckets = max(1, estimated_bytes(d) // (BUCKET_MB << 20))
        answered = lambda asked: stored(asked.groupBy("bucket", "n").applyInArrow(_answered, ANSWERS), "lm")
        answers = answered(chunks.select("chunk", "held_out", "size", "texts").mapInArrow(_asked(min(order, 2), buckets), ASKED))
        for n in range(3, order + 1):
            both = chunks.groupBy("chunk").cogroup(answers.select("chunk", "n", "bucket", "size", "counts").groupBy("chunk"))
            answers = answers.unionByName(answered(both.applyInArrow(_asked_next(n, buckets), ASKED)))
    total = answers.where("n = 1").agg(F.sum("tokens"), F.sum("words")).first()
    begins = chunks.agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    score = _scored(order, total[0] or 0, total[1] or 0, begins, list(strength[: order - 1]))
    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "n", "bucket", "size", "counts").groupBy("chunk")).applyInArrow(score, SCORES)


def every_fifth(doc_id):
    """Held out: crc32 of the id as text is 1 modulo 5."""
    return fold(doc_id, 5) == 1
