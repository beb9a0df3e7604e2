"""What op10_webp stores is compressed: the decoder's general path runs on every row."""

import pytest

from kinship.llm import queries as q
from kinship.llm import webp, webpbatch


def test_query_writes_compressed_images(spark, tmp_path, monkeypatch):
    rows = [(1, "a line that comes again and again; " * 400), (2, "".join(chr(97 + i * i * 7 % 26) for i in range(5000))), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    files = []
    from kinship.llm import media

    kept = media.read_media
    monkeypatch.setattr(media, "read_media", lambda s, path: files.extend(r[0] for r in s.read.parquet(path).select("media").collect()) or kept(s, path))
    got = {r["doc_id"]: r for r in q.op10_webp(spark, str(tmp_path)).collect()}
    assert got[1]["media_bytes"] < got[1]["payload_bytes"] / 10
    assert got[2]["media_bytes"] < got[2]["payload_bytes"]
    assert sorted(map(len, files)) == [1, 1, 2]
    for data in (f for own in files for f in own):
        bits = webp._Bits(data[20:])
        bits.at = 40
        assert bits.read(1) == 1 and bits.read(2) == webp.PALETTE
    kinds = []
    read = webp._read_head
    monkeypatch.setattr(webpbatch, "_read_head", lambda *a: kinds.append(read(*a)) or kinds[-1])
    first = webpbatch.decode_many([f for own in files for f in own])
    assert len(first) == 4 and all(p.shape[1] == media.UNIT for p in first)
    green = [codes[0][0] for _, _, _, codes in kinds]
    assert max(c.bits for c in green) > 3 and max(int((c.table >> 4).max()) for c in green) >= 256  # words of several lengths, and references
    with pytest.raises(webp.BadWebp):
        webp.decode(files[0][0][: len(files[0][0]) // 2])
