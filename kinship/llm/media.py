"""Media columns: byte payloads stored as lossless WebP images, and features of the pixels read back.

A payload's bytes are the green of opaque pixels, UNIT to a row, and an image holds ROWS rows at most: a longer payload is a list of
images, each a file of its own. So no text is too long for the format, and images are written and read many at a time, however
different the texts that they come from.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, stored
from .webpbatch import decode_many, encode_rows

#: Samples of a row of pixels, to a multiple of which payloads are padded; what they are padded with; most rows of an image.
UNIT, FILL, ROWS = 576, 255, 16
#: Bytes of payload that are written, or read, at once.
WRITTEN, READ = 1 << 20, 10 << 20


def padded(data: bytes) -> bytes:
    """The data, then FILL up to a positive multiple of UNIT."""
    return data + bytes([FILL]) * (-len(data) % UNIT if data else UNIT)


def images_of(payload: bytes) -> list[bytes]:
    """The samples of each image of a payload."""
    return [payload[i : i + ROWS * UNIT] for i in range(0, len(payload), ROWS * UNIT)]


class Feature:
    """Size, mean, and the share of neighbours in a row that differ, of samples that come in parts."""

    def __init__(self):
        self.rows = self.total = self.edges = 0

    def add(self, samples: np.ndarray) -> None:
        self.rows += len(samples)
        self.total += int(samples.sum(dtype=np.int64))
        self.edges += int(np.count_nonzero(samples[:, 1:] != samples[:, :-1]))

    def __str__(self) -> str:
        return f"{UNIT}x{self.rows};{self.total / (UNIT * self.rows):.3f};{self.edges / ((UNIT - 1) * self.rows):.3f}"


def _in_runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items of so many bytes together at most, or of one."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if sizes:
        yield start, len(sizes)


@lean
def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(t.as_py() or "").encode() for t in b.column(1)]
        for lo, hi in _in_runs([len(t) + UNIT for t in texts], 6 * WRITTEN):  # some megabytes go out at a time
            payloads = [padded(t) for t in texts[lo:hi]]
            images = [images_of(p) for p in payloads]
            flat = [x for own in images for x in own]
            files = [f for i, j in _in_runs([len(x) for x in flat], WRITTEN) for f in encode_rows(flat[i:j], UNIT)]
            ends = np.cumsum([0, *map(len, images)]).astype(np.int32)
            columns = [b.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array([len(p) for p in payloads], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(files, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "media"])


def write_media(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Store each text (null: empty), as UTF-8, as images: (doc_id, n_bytes, payload_bytes, media) in Parquet at path.

    Rows stand for themselves: ids, which are cast to long, may repeat or be null. Texts of any length that a row can hold are
    stored whole. Other columns are not read; an empty table gives no row."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        d.mapInArrow(_stored, "doc_id long, n_bytes long, payload_bytes long, media array<binary>").write.option("compression", "none").parquet(path)


@lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for b in batches:
        media = b.column(3)
        files = [f.as_py() for f in media.flatten()]
        row = np.repeat(np.arange(len(b)), np.diff(media.offsets.to_numpy()))
        digests, stored = [hashlib.sha256() for _ in range(len(b))], [hashlib.sha256() for _ in range(len(b))]
        tails, sizes, features = [b""] * len(b), [0] * len(b), [Feature() for _ in range(len(b))]
        left = b.column(2).to_pylist()
        # An image is as large as its payload once it is read, which is known only for whole rows: ROWS rows at most.
        for lo, hi in _in_runs([min(ROWS * UNIT, left[i]) for i in row.tolist()], READ):
            for i, data, pixels in zip(row[lo:hi].tolist(), files[lo:hi], decode_many(files[lo:hi]), strict=True):
                samples = np.ascontiguousarray(pixels[:, :, 1])
                raw = samples.tobytes()
                digests[i].update(raw)
                stored[i].update(data)
                tails[i] = (tails[i] + raw[-32:])[-32:]
                sizes[i] += len(data)
                features[i].add(samples)
                left[i] -= len(raw)
        if any(left):
            raise ValueError("images do not hold as many samples as their payload")
        columns = [[d.hexdigest() for d in digests], [zlib.crc32(t) for t in tails], sizes, [d.hexdigest() for d in stored], [str(f) for f in features]]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names)


def read_media(spark, path: str) -> DataFrame:
    """Digests and features of the payloads decoded from the images at path, one row a payload: payload_sha256 and tail_crc32 of what
    was read back, media_bytes and media_sha256 of its images one behind the other."""
    df = spark.read.parquet(path).select("doc_id", "n_bytes", "payload_bytes", "media")
    rows = df.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return stored(rows, "media_rows", batch=(8000, 10))  # few bytes a payload; images of a batch are decoded together
