"""Near-duplicate documents: sketches by fast similarity sketching, banding, exact verification, connected components.

The sketch is that of Dahlgaard, Knudsen and Thorup (FOCS 2017). A set is thrown into t bins in rounds: in rounds 0 to t-1 each
element goes to a bin by that round's hash, in rounds t to 2t-1 all go to the one bin of that round. A bin keeps the least (round,
hash) that came to it, so that each bin is filled for sure, after about one round for sets of over t log t elements, and
coordinates agree with a chance of the Jaccard similarity, concentrated as if they were independent.

Documents with equal sets are one class; only classes are compared. Classes that share a band meet in a bucket. No bucket is
expanded into all its pairs: its least class is compared with all others on full sets, links are merged into components, and only
buckets whose classes are then of several components are looked at again: in each, the classes outside the largest component meet
one another and that component in tiles of two blocks, as products of matrices, and a tile yields no more links than it joins
components. So every two classes that share a bucket end up compared or connected, and nothing is capped. The work beyond one
comparison a class grows with the number of classes that share a bucket without being linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, row_key, stored
from .textbytes import combined, mix, pieces, word_hashes

BANDS = 32
#: Classes of a block; two blocks are compared in one task.
BLOCK, BLOCK_SEED = 512, (1 << 31) - 1
_ROUND, _SIGN = 0xA0761D6478BD642F, -(1 << 63)


def rows_per_band(threshold: float, bands: int = BANDS, miss: float = 1e-5) -> int:
    """The most rows a band for which two sets at the threshold miss each other in all bands with a chance of miss at most."""
    r = 1
    while (1 - threshold ** (r + 1)) ** bands <= miss:
        r += 1
    return r


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, sorted by both. Fewer than k words are one shingle; none, none.

    Hashes keep the bits that the number of rows leaves of 64, 53 at least."""
    h, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.bincount(row, minlength=n)
    begin = np.concatenate(([0], np.cumsum(words)))[:-1]
    s = h.copy()
    place = np.arange(len(h)) - begin[row]
    for i in range(1, k):
        there = place + i < words[row]
        s[there] = combined(s[there], h[np.flatnonzero(there) + i])
    ok = (place + k <= words[row]) | ((place == 0) & (words[row] < k))
    # A short row's one shingle is of all its words: the loop has combined what there was.
    bits = max(1, int(n - 1).bit_length())
    key = np.sort((row[ok].astype(np.uint64) << np.uint64(64 - bits)) | (mix(s[ok]) >> np.uint64(bits)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key = key[fresh]
    return (key >> np.uint64(64 - bits)).astype(np.int64), key & np.uint64((1 << (64 - bits)) - 1)


#: Rows that share a batch for shingle_sets: 11 bits.
ROWS = 2048


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, 53-bit hash), the hashes alike in any batch."""
    for at, end, data, offsets in pieces(column, 1 << 20):
        for lo in range(0, end - at, ROWS):
            hi = min(lo + ROWS, end - at)
            part = data[offsets[lo] : offsets[hi]]
            own = np.concatenate((offsets[lo : hi + 1] - offsets[lo], np.full(ROWS - (hi - lo), offsets[hi] - offsets[lo])))
            row, h = shingle_sets(part, own, k)
            yield at + lo, hi - lo, row, h


def signatures(n: int, row: np.ndarray, h: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for the whole set of each row; None for an empty one."""
    size = np.bincount(row, minlength=n)
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h * np.uint64(seed) + np.uint64(seed)), out=total[1:])
        ends = np.cumsum(size)
        out.append(mix(total[ends] - total[ends - size] + size.astype(np.uint64)))
    both = np.stack(out, 1)
    return [both[i].tobytes() if size[i] else None for i in range(n)]


def sketches(n: int, row: np.ndarray, h: np.ndarray, t: int) -> np.ndarray:
    """n x t coordinates; rows without elements have the largest number."""
    none = np.uint64((1 << 64) - 1)
    out = np.full(n * t, none, np.uint64)
    size = np.bincount(row, minlength=n)
    left = np.flatnonzero(size > 0)
    for i in range(2 * t):
        if i:
            lacks = (out.reshape(n, t)[left] == none).any(1)
            if not lacks.any():
                break
            if not lacks.all():
                left = left[lacks]
                todo = np.zeros(n, bool)
                todo[left] = True
                keep = todo[row]
                row, h = row[keep], h[keep]
        x = mix(h + np.uint64(_ROUND * (i + 1) % (1 << 64)))
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        value = (np.uint64(i) << np.uint64(48)) | (mix(x) >> np.uint64(16))
        np.minimum.at(out, row * t + bins, value)
    return out.reshape(n, t)


def _sketch_batches(k: int, bands: int, r: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, row, h in _sets(b.column(2), k):
                size = np.bincount(row, minlength=n)[:n]
                lists = _bands(sketches(n, row, h, bands * r), bands)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(size.astype(np.int64)), pa.array(signatures(n, row, h), pa.binary()), lists], ["doc_id", "key", "n", "set", "bands"])

    return run


def _bands(coordinates: np.ndarray, bands: int) -> pa.Array:
    n = len(coordinates)
    s = coordinates.reshape(n, bands, -1)
    band = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    for j in range(s.shape[2]):
        band = combined(band, s[:, :, j])
    return pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(band.reshape(-1).view(np.int64)))


def _set_batches(k: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, n, row, h in _sets(b.column(0), k):
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)[:n])))
                yield pa.RecordBatch.from_arrays([pa.array(signatures(n, row, h), pa.binary()), pa.array([h[ends[i] : ends[i + 1]].tobytes() for i in range(n)], pa.binary())], ["set", "hashes"])

    return run


def _verified(up: int, down: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                ok.append(down * both >= up * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets have in common: products of slices of the matrix of sets by shared elements."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)  # whole numbers under 2**24 are exact
    total = np.zeros((n, n), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        x = np.zeros((n, 4096), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        np.matmul(x, x.T, out=out)
        total += out.astype(np.int64)
    return total


def _tile(up: int, down: int):
    """Links between classes of two blocks that are of different components; of several that join the same components, one."""

    def run(t: pa.Table) -> pa.Table:
        sig, comp = t.column("sig").to_pylist(), t.column("comp").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets])
        both = intersections(sets)
        root = {c: c for c in comp}

        def find(c: bytes) -> bytes:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for x, y in zip(*np.nonzero(np.triu(down * both >= up * (size[:, None] + size[None, :] - both), 1)), strict=True):
            a, b = find(comp[x]), find(comp[y])
            if a != b:
                root[a] = b
                links.append((sig[x], sig[y]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the least vertex that each end of an edge (a, b) can reach. Each round takes the least label among a vertex's
    neighbours and then that label's own label, so long chains shorten by half; it ends when no label changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    label = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        step = label.join(near, "v").select("v", "comp", F.least("comp", "near").alias("to"))
        jump = label.select(F.col("v").alias("to"), F.col("comp").alias("far"))
        moved = stored(step.join(jump, "to", "left").select("v", F.least("to", F.coalesce("far", "to")).alias("comp"), (F.least("to", F.coalesce("far", "to")) != F.col("comp")).alias("moved")), "labels")
        label = moved.select("v", "comp")
        if not moved.where("moved").take(1):
            return label


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components (v, comp) after more links: only components that these join are labelled anew."""
    if not links.take(1):
        return comp
    a = comp.select(F.col("v").alias("a"), F.col("comp").alias("ca"))
    b = comp.select(F.col("v").alias("b"), F.col("comp").alias("cb"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    to = components(between.where("a <> b")).select(F.col("comp").alias("to"), F.col("v").alias("comp"))
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(comp, "v", "left_anti").select("v", F.col("v").alias("comp"))
    return stored(comp.unionByName(ends).join(to, "comp", "left").select("v", F.coalesce("to", "comp").alias("comp")), "labels")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, key (a hash of id and text), kept.

    Rows are linked if the sets of k-word shingles of their lower-cased (A-Z) texts have a Jaccard similarity of threshold (a
    fraction) or more; component_id is the least doc_id reachable. kept tells the row with that doc_id, so that where ids do not
    repeat one row of each component stays. Texts without words, empty or null, have no shingles and no links. Rows whose doc_id
    is null are not linked either: component_id is null, and they are kept. If a doc_id repeats, each row is judged by its own
    text and gets its own component. An empty table gives an empty result; other columns are not read.
    """
    up, down = threshold
    r = rows_per_band(up / down)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("key", row_key("doc_id", "text"))
    rows = stored(docs.select("doc_id", "key", "text").mapInArrow(_sketch_batches(k, BANDS, r), "doc_id long, key long, n long, set binary, bands array<long>"), "sketches")
    named = rows.where("set is not null and doc_id is not null")
    classes = named.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # A class goes by its least doc_id and its set, in bytes that sort like the doc_id: a component's least name tells its least doc_id.
    name = F.concat(F.unhex(F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(_SIGN))), 16, "0")), F.col("set"))
    classes = stored(classes.withColumn("sig", name), "classes")
    # Buckets of two classes or more.
    members = classes.select("sig", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("sig").alias("hub")).where("c > 1")
    members = stored(members.join(shared, "bucket"), "members")
    star = members.where("sig <> hub").select(F.col("hub").alias("a"), F.col("sig").alias("b")).distinct()
    # Full sets of the classes that share a bucket, computed again from their texts.
    wanted = stored(classes.select("sig", "set", "doc_id").join(members.select("sig").distinct(), "sig", "left_semi"), "wanted")
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi")
    sets = texts.select("text").mapInArrow(_set_batches(k), "set binary, hashes binary")
    sets = stored(sets.join(wanted.select("sig", "set"), "set").groupBy("sig").agg(F.first("hashes").alias("hashes")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.withColumnsRenamed({"sig": "a", "hashes": "x"}), "a").join(sets.withColumnsRenamed({"sig": "b", "hashes": "y"}), "b")
        return stored(full.select("a", "b", "x", "y").mapInArrow(_verified(up, down), "a binary, b binary"), "links")

    comp = components(linked(star))
    # Each hub has met all of its bucket; what is left to compare is the others of a bucket that are of several components. Those
    # outside the bucket's largest component meet each other and that component, in tiles of two blocks of classes.
    now = members.where("sig <> hub").select("bucket", "sig").join(comp.withColumnRenamed("v", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    by = stored(now.groupBy("bucket", "comp").agg(F.count("*").alias("c")), "mixed")
    by = by.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("c")).where("main.c < c")
    now = now.join(by, "bucket")
    place = F.abs(F.xxhash64("sig") % BLOCK_SEED)
    main, rest = F.ceil(F.col("main.c") / BLOCK).cast("int"), F.ceil((F.col("c") - F.col("main.c")) / BLOCK).cast("int")
    own = F.when(F.col("comp") == F.col("main.comp"), -1 - place % main).otherwise(place % rest).cast("int")
    others = F.sequence(F.lit(0), rest - 1)
    tiles = F.when(F.col("own") < 0, F.transform(others, lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))).otherwise(
        F.concat(
            F.transform(others, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))),
            F.transform(F.sequence(F.lit(1), main), lambda i: F.struct((-i).alias("i"), F.col("own").alias("j"))),
        )
    )
    tiled = now.withColumn("own", own).select("bucket", "sig", "comp", F.explode(tiles).alias("tile")).select("bucket", "tile.i", "tile.j", "sig", "comp")
    # Alone in its tile or with its own component only, a class has none to meet.
    mixed = tiled.groupBy("bucket", "i", "j").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi")
    tiled = tiled.join(stored(mixed, "tiles"), ["bucket", "i", "j"]).join(sets, "sig")
    links = tiled.groupBy("bucket", "i", "j").applyInArrow(_tile(up, down), "a binary, b binary")
    comp = merged(comp, stored(links.distinct(), "links"))
    least = F.conv(F.hex(F.substring(F.coalesce("comp", "sig"), 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    to = classes.select("set", "sig").join(comp.withColumnRenamed("v", "sig"), "sig", "left").select("set", least.alias("component_id"))
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles"), "set").join(stored(to, "roots"), "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs, all columns, whose document is kept; docs must have doc_id and text. Rows that agree in both are one document,
    and stay or go together."""
    gone = near_duplicates(docs, k, threshold).where("not kept").select("key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("key"))
    return rows.join(stored(gone, "copies"), "key", "left_anti").select("row.*")
