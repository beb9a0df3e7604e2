"""Token ids of documents as files of range-coded blocks.

A file is a Parquet table, which any file system that Spark knows can hold and which Spark commits whole or not at all. Each row is
a record of some whole documents in ascending doc_id order: part, the number of the range of doc_ids that it belongs to; before, ids
of that range ahead of the record; doc_id and n_tokens of each document; and blocks, as rangecoder writes them, of all their ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, partitions_for, shuffles_removed, small_batches, stored
from .rangecoder import BLOCK, decode, encode
from .textbytes import pieces, span_hashes

#: Bytes of text that are cut at once; what that takes is some tens of times as much.
PIECE = 1 << 19
RECORD = "part int, before long, doc_id array<long>, n_tokens array<long>, blocks array<binary>"


_LETTER, _DIGIT, _SPACE, _OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of each byte of plain text; all bytes past ASCII are of letters there."""
    out = np.full(256, _OTHER, np.int8)
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
    out[48:58] = _DIGIT
    out[[9, 10, 13, 32]] = _SPACE
    return out


_CLASS = _classes()


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in plain texts that lie one after the other: what the pattern of byte-level BPE,

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+,

    finds, worked out for all bytes at once: runs of a class, where the last space of a run of white space goes to what follows it, or
    stands alone if it is no blank, and an apostrophe alone takes the letters of a contraction."""
    n = len(data)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, bool)  # where a text begins or ends
    edge[offsets] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else of the same text.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n]) if n else np.zeros(0, np.int64)
    start[last] = True
    start[last + 1] = data[last] != 32
    # An apostrophe that is a run by itself, and begins a piece, before letters.
    mark = np.flatnonzero((data[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~edge[1:n]) if n else last
    if len(mark):
        one, two = data[mark + 1], data[np.minimum(mark + 2, n - 1)]
        inside = (mark + 2 < n) & ~edge[np.minimum(mark + 2, n)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for m, size in ((mark[short], 2), (mark[long], 3)):
            start[m + 1] = False
            after = m + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


_ODD = np.ones(256, bool)
_ODD[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = False


def odd(data: np.ndarray) -> np.ndarray:
    """Places of bytes of UTF-8 that are not of plain text: printable ASCII, tab, newlines, the letters of U+00C0 to U+024F."""
    out = _ODD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    out[lead[(after == 0x97) | (after == 0xB7)]] = True  # the signs of multiplication and division
    lead = np.flatnonzero(data[:-1] == 0xC9)
    out[lead[data[lead + 1] > 0x8F]] = True
    return np.flatnonzero(out)


class _Table:
    """64-bit keys to numbers from 0 on, in open addressing, many at a time."""

    def __init__(self, bits: int = 20):
        self.bits, self.key, self.number, self.n = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.number[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            out[todo] = self.number[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.key[slot[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new, distinct keys."""
        if (self.n + len(keys)) * 4 > 3 << self.bits:
            old = self.key[self.number >= 0][np.argsort(self.number[self.number >= 0])]
            while (self.n + len(keys)) * 4 > 3 << self.bits:
                self.bits += 1
            self.key, self.number, self.n = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0
            self.add(old)
        mask = np.int64((1 << self.bits) - 1)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.number[slot[todo]] < 0]
            self.number[slot[free]] = free + self.n  # of several, the last stays
            done = free[self.number[slot[free]] == free + self.n]
            self.key[slot[done]] = keys[done]
            left = np.ones(len(keys), bool)
            left[done] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        self.n += len(keys)


class ByteBpe:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    The tokenizer first cuts a text by a fixed pattern and then merges bytes inside a piece, so a text's ids are those of its pieces
    in a row. Pieces repeat, so each distinct one, told by a 64-bit hash, is given to the library once; the ids of at most `most` of
    them are kept. Texts with characters outside printable ASCII, tab, newlines and Latin letters up to U+024F, of which two
    libraries' Unicode tables might think differently, go to the library whole, and so do texts that hold the name of an added token,
    such as the end of a text: the library gives that token's id for it, also with add_special_tokens=False.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cuts = made["pre_tokenizer"] or {}
        self.by_pieces = made["normalizer"] is None and made["model"]["type"] == "BPE" and cuts.get("type") == "ByteLevel" and not cuts["add_prefix_space"] and cuts.get("use_regex", True)
        self.added = [t["content"].encode() for t in made["added_tokens"] if t["content"]]
        if self.by_pieces:
            self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
            self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True  # a blank's letter in byte-level BPE
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.table = _Table()
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of pieces. Words go to the library many at a time: those after a blank one behind the other, as each
        begins with an id whose bytes begin with a blank, others with a newline between them, which is a piece of its own before a
        word. Other pieces go one by one."""
        kind = np.array([(2 if p[0] == " " else 1) if p[-1].isalpha() else 0 for p in pieces], np.int8)
        sizes = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * 3
        for k in range(3):
            own = [p for p, x in zip(pieces, kind.tolist(), strict=True) if x == k]
            if not own:
                continue
            if k:
                gap = "" if k == 2 else "\n"
                joined = [gap.join(own[i : i + 64]) + gap for i in range(0, len(own), 64)]
                x = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
                if k == 2:
                    size = np.diff(np.flatnonzero(self.blank[x]), append=len(x))
                else:
                    size = np.diff(np.flatnonzero(x == self.newline), prepend=-1) - 1
                    x = x[x != self.newline]
                if len(size) != len(own) or size.sum() != len(x):
                    raise RuntimeError("the tokenizer does not keep words apart")
            else:
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                size, x = [len(i) for i in ids], np.array([i for y in ids for i in y], np.int32)
            sizes[kind == k], parts[k] = size, x
        total = np.zeros(int(sizes.sum()), np.int32)
        of = np.repeat(kind, sizes)
        for k in range(3):
            total[of == k] = parts[k]
        return total, sizes

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        ids, sizes = self._encoded(pieces)
        first = self.table.n
        self.table.add(keys)
        while len(self.size) < self.table.n:
            self.size, self.start = np.concatenate((self.size, self.size * 0)), np.concatenate((self.start, self.start * 0))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate((self.flat, self.flat * 0))
        self.size[first : self.table.n] = sizes
        self.start[first : self.table.n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of plain texts in UTF-8 that lie one after the other."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        if self.table.n > self.most:
            self._reset()
        begin = cut(data, offsets)
        end = np.append(begin[1:], len(data))
        keys = span_hashes(data, begin, end)
        n = self.table.find(keys)
        new = np.flatnonzero(n < 0)
        if len(new):
            distinct, at = np.unique(keys[new], return_index=True)
            self._learn(data, begin[new[at]], end[new[at]], distinct)
            n[new] = self.table.find(keys[new])
        size = self.size[n]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat((self.start[n] - ends + size).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(begin, offsets)])

    def _named(self, data: np.ndarray) -> np.ndarray:
        """Where names of added tokens begin, overlapping ones too."""
        raw, out = data.tobytes(), []
        for name in self.added:
            at = raw.find(name)
            while at >= 0:
                out.append(at)
                at = raw.find(name, at + 1)
        return np.array(out, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in order; null has none."""
        for at, end, data, offsets in pieces(column, PIECE):
            plain = np.full(end - at, self.by_pieces)
            plain[np.searchsorted(offsets, odd(data), "right") - 1] = False
            plain[np.searchsorted(offsets, self._named(data), "right") - 1] = False
            if plain.all():
                ids, sizes = self.plain(data, offsets)
            else:
                size = np.diff(offsets)
                ids, sizes = self.plain(data[np.repeat(plain, size)], np.append(0, np.cumsum(np.where(plain, size, 0))))
            ends = np.cumsum(sizes)
            for i in range(end - at):
                yield ids[ends[i] - sizes[i] : ends[i]] if plain[i] else self.whole(column[at + i].as_py() or "")

    def __call__(self, text: str | None) -> np.ndarray:
        return next(iter(self.batch(pa.array([text], pa.string()))))


def encoder(path: str) -> ByteBpe:
    """The worker's encoder of a file, which knows the pieces of its earlier tasks. A function of the module, as one inside another is
    sent with copies of the globals that it reads, and keeps nothing."""
    mine = kept(__name__)
    return mine.get(path) or mine.setdefault(path, ByteBpe(path))


def _records(path: str, end_id: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        part, before, held, docs, many = TaskContext.get().partitionId(), 0, 0, [], []

        def record() -> pa.RecordBatch:
            ids = np.concatenate([x for x in many])
            blocks = [encode(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) for x in many]], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["part", "before", "doc_id", "n_tokens", "blocks"])

        for b in batches:
            for doc_id, ids in zip(b.column(0), bpe.batch(b.column(1)), strict=True):
                ids = np.append(ids, np.int32(end_id))
                if many and held + len(ids) > BLOCK:
                    yield record()
                    before, held, docs, many = before + held, 0, [], []
                docs.append(doc_id.as_py())
                many.append(ids)
                held += len(ids)
        if many:
            yield record()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode the whole texts of docs (null: empty) by the tokenizer file, end_id after each, and write them to path in ascending
    order of doc_id; null ids come first, rows of one id in order of their texts. Other columns are not read. Ids are those of the
    library without further options: a text that spells a special token, as "<|endoftext|>", gets that token's id there."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.repartitionByRange(partitions_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession), shuffles_removed(docs.sparkSession):
        d.mapInArrow(_records(tokenizer, end_id), RECORD).write.option("compression", "none").parquet(path)


def _read_back(with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, docs, sizes, blocks in zip(*(b.column(i) for i in range(5)), strict=True):
                ids = np.concatenate([decode(x.as_py()) for x in blocks.values])
                size = np.array(sizes.values, np.int64)
                ends = np.cumsum(size)
                if ends[-1] != len(ids):
                    raise ValueError("a record has more or fewer ids than its documents")
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                columns = {"doc_id": docs.values, "part": pa.array([part.as_py()] * len(size), pa.int32()), "at": pa.array(before.as_py() + ends - size), "n_tokens": pa.array(size), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def read_tokens(spark, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files, from their decoded blocks. start: ids of all
    documents before it. Only one number for each range of doc_ids passes the driver."""
    df = spark.read.schema(RECORD).parquet(path)
    total = df.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    at, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in total):
        offsets.append((part, at))
        at += n
    offsets = spark.createDataFrame(offsets, "part int, offset long")
    columns = "doc_id long, part int, at long, n_tokens long, ids_crc32 long"
    rows = df.mapInArrow(_read_back(ids), columns + ", ids array<long>" * ids)
    if not ids:  # few bytes a document: stored, so that records are decoded in small batches
        rows = stored(rows, "token_rows")
    out = rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("at") + F.col("offset"))  # one row a partition written
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)
