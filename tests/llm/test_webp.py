import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinship.llm import media, webp, webpbatch
from kinship.llm.common import new_path


def pixels(h, w, colours, seed=0):
    return np.random.default_rng(seed).integers(0, colours, (h, w, 4)).astype(np.uint8)


def test_a_known_file():
    # The widely used one-pixel test image for lossless support.
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[[0, 0, 0, 0]]]


def test_near_places():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-2:] == [(8, 6), (8, 7)]


@pytest.mark.parametrize(("h", "w"), [(1, 1), (1, 7), (5, 3), (13, 17)])
@pytest.mark.parametrize("colours", [2, 9, 256])
def test_every_tool(h, w, colours):
    px = pixels(h, w, colours)
    rows, columns = (h + 3) // 4, (w + 3) // 4
    modes = np.random.default_rng(1).integers(0, 16, (rows, columns))
    elements = np.random.default_rng(2).integers(0, 256, (rows, columns, 3))
    groups = (2, np.random.default_rng(3).integers(0, 3, (rows, columns)))
    tools = [
        {}, {"references": True}, {"cache_bits": 4}, {"cache_bits": 11, "references": True}, {"groups": groups}, {"transforms": [(webp.SUBTRACT_GREEN,)]},
        {"transforms": [(webp.PREDICTOR, 2, modes)]}, {"transforms": [(webp.CROSS_COLOUR, 2, elements)]},
        {"transforms": [(webp.PREDICTOR, 2, modes), (webp.CROSS_COLOUR, 2, elements), (webp.SUBTRACT_GREEN,)], "cache_bits": 2, "references": True, "groups": groups},
    ]
    for k in tools:
        assert (webp.decode(webp.encode(px, **k)) == px).all(), k


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(n):
    rng = np.random.default_rng(n)
    px = rng.integers(0, 256, (n, 4)).astype(np.uint8)[rng.integers(0, n, (9, 13))]
    assert (webp.decode(webp.encode(px, [(webp.PALETTE,)], references=True)) == px).all()


def test_references_reach_back():
    px = np.tile(pixels(1, 40, 256, 4), (30, 1, 1))
    small, large = webp.encode(px, references=True), webp.encode(px)
    assert len(small) < len(large) / 4 and (webp.decode(small) == px).all()


def test_predictors_by_hand():
    left, top, corner, ahead = (np.array(v) for v in ([10, 20, 30, 40], [50, 60, 70, 80], [0, 100, 30, 255], [7, 9, 11, 13]))
    p = lambda m: webp.predicted(m, left, top, corner, ahead).tolist()
    assert p(0) == [0, 0, 0, 255] and p(1) == left.tolist() and p(2) == top.tolist() and p(3) == ahead.tolist() and p(4) == corner.tolist()
    assert p(7) == [30, 40, 50, 60] and p(5) == [29, 37, 45, 53]
    assert p(12) == [60, 0, 70, 0]
    assert p(13) == [45, 10, 60, 0]


@pytest.mark.parametrize("cut", [3, 20, 30, 60])
def test_broken_files(cut):
    data = webp.encode(pixels(8, 8, 256))
    with pytest.raises(webp.BadWebp):
        webp.decode(data[:cut])
    with pytest.raises(webp.BadWebp):
        webp.decode(b"RIFF" + b"x" * 40)


def test_many_files_at_a_time():
    files, want = [], []
    for h, w in ((1, 1), (5, 3), (13, 17), (40, 9)):
        for colours in (2, 9, 256):
            px = pixels(h, w, colours, h)
            rows, columns = (h + 3) // 4, (w + 3) // 4
            modes = np.random.default_rng(1).integers(0, 16, (rows, columns))
            elements = np.random.default_rng(2).integers(0, 256, (rows, columns, 3))
            groups = (2, np.random.default_rng(3).integers(0, 3, (rows, columns)))
            mixed = {"transforms": [(webp.PREDICTOR, 2, modes), (webp.CROSS_COLOUR, 2, elements), (webp.SUBTRACT_GREEN,)], "cache_bits": 2, "references": True}
            for k in ({}, {"references": True}, {"cache_bits": 4}, {"cache_bits": 11, "references": True}, {"groups": groups}, mixed, mixed | {"groups": groups}):
                files.append(webp.encode(px, **k))
                want.append(px)
    for got, px in zip(webpbatch.decode_many(files), want, strict=True):
        assert (got == px).all()
    assert webpbatch.decode_many([]) == []


@given(st.lists(st.binary(min_size=1, max_size=200) | st.text("ab c\xe9", max_size=90).map(lambda t: (t * 9).encode() or b"."), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_rows_of_bytes(texts):
    images = [t + b"\xff" * (-len(t) % 24) for t in texts]
    files = webpbatch.encode_rows(images, 24)
    for many, one, data in zip(webpbatch.decode_many(files), map(webp.decode, files), images, strict=True):
        assert (many == one).all() and many[:, :, 1].tobytes() == data
        assert not many[:, :, [0, 2]].any() and (many[:, :, 3] == 255).all()


def test_long_runs_and_broken_files():
    images = [b"z" * 9216, bytes(range(256)) * 36, b"abcd" * 2304, bytes(576)]
    files = webpbatch.encode_rows(images, 576)
    assert [p[:, :, 1].tobytes() for p in webpbatch.decode_many(files)] == images
    assert len(files[0]) < 100 and len(files[2]) < 200
    for cut in (3, 20, 40, len(files[1]) // 2):
        with pytest.raises(webp.BadWebp):
            webpbatch.decode_many([files[0], files[1][:cut]])


def test_media_rows(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (None, "é" * 300), (4, "x" * 576), (4, "x" * 577), (4, "x" * 577), (5, "long " * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"media": F.lit(1), "n_bytes": F.lit("q")})
    path = new_path(spark, "media")
    media.write_media(docs.repartition(3), path)
    got = sorted((tuple(r)[:5] for r in media.read_media(spark, path).collect()), key=str)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want, key=str)
    rows = media.read_media(spark, path).where("doc_id = 4 and n_bytes = 577").collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    empty = new_path(spark, "media")
    media.write_media(docs.limit(0), empty)
    assert media.read_media(spark, empty).count() == 0


def plain_matches(data, ends):
    """References from left to right, each to the last place of its image where the same four bytes began."""
    out, begin = [], 0
    for end in ends:
        last, refs_at = {}, begin
        for i in range(begin, end):
            four = data[i : i + 4]
            j = last.get(four)
            if i + 4 <= end:
                if i == refs_at and j is not None:
                    m = 4
                    while m < webpbatch.MOST and i + m < end and data[j + m] == data[i + m]:
                        m += 1
                    out.append((i, m, i - j))
                    refs_at = i + m
                last[four] = i
            if i == refs_at:
                refs_at = i + 1
        begin = end
    return out


@pytest.mark.parametrize("seed", range(12))
def test_references_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    images = []
    for n in rng.integers(1, 400, 9).tolist() + [4, 5, 9000]:
        piece = rng.integers(0, 2 + seed % 5 * 3, n, dtype=np.uint8).tobytes()
        at = int(rng.integers(0, n))
        images.append((piece + piece[at : at + int(rng.integers(3, 30))] + piece[: n // 2])[:9216])
    data, ends = b"".join(images), np.cumsum([len(x) for x in images])
    got = webpbatch._matches(np.frombuffer(data, np.uint8), ends)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == plain_matches(data, ends.tolist())
