import base64
import hashlib

import pytest

from kinship.llm import warc
from kinship.llm.common import new_path

PAGES = "page_id long, url string, html string"
ROWS = [(5, "http://a/", "same"), (3, "http://b/\r\nInjected: x", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (None, "u", "same"), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: x\r\n\r\n"), (8, "ü", "é日\n" * 3), (8, "ü", "é日\n" * 3), (10, "big", "x" * 300000), (11, "nul", "a\x00b\r")]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_digest(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("",), ("é日",), ("x" * 1000,)], "t string")
    assert [r[1] for r in df.select("t", warc.base32_sha1(F.col("t"))).collect()] == [digest(r[0]) for r in df.collect()]


def test_pages(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(ROWS, PAGES + "").repartition(2).sortWithinPartitions("url"), path)
    got = sorted((tuple(r) for r in warc.page_digests(spark, path).collect()), key=str)
    want, first = [], {}
    for i, (p, _, t) in enumerate(ROWS):
        first.setdefault(t or "", []).append((p is None, p, i))
    done = {}
    for i, (p, _, t) in enumerate(ROWS):
        least = min(first[t or ""])
        is_first = (p, t or "") == (least[1], t or "") and not done.get(t or "")
        done[t or ""] = done.get(t or "", False) or is_first
        want.append((p, len((t or "").encode()), digest(t), "response" if is_first else "revisit", None if is_first else least[1]))
    assert got == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES), path, min_bytes=3)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.page_digests(spark, path).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_captures(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "http://x/", "<p>é"), (2, "http://y/", "<p>é")], PAGES), path)
    records = warc.read_records(spark, path)
    assert records.count() == 6
    c = {r["metadata"]["fields"]["page-id"]: r for r in warc.captures(records).collect()}
    one = c["1"]
    assert one["capture"]["payload"].decode() == "<p>é" and one["capture"]["record_type"] == "response" and one["request"]["target_uri"] == "http://x/"
    assert one["request"]["concurrent_to"] == one["record_id"] == one["metadata"]["concurrent_to"] == c["2"]["capture"]["refers_to"]
    assert c["2"]["capture"]["payload"] is None
    alone = warc.captures(records.where("record_type = 'response'")).first()
    assert alone["request"] is None and alone["metadata"] is None


def test_files_are_plain_warc(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(ROWS[:3], PAGES).coalesce(1), path)
    data = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    kinds = [k for k, _, _ in warc.records_of(data)]
    assert kinds.count("request") == kinds.count("metadata") == 3 and kinds.count("response") == 1 and kinds.count("revisit") == 2
    for _, h, block in warc.records_of(data):
        assert int(h["content-length"]) == len(block) and h["warc-record-id"].startswith("<urn:uuid:")
    with pytest.raises(warc.BadWarc):
        list(warc.records_of(data[:-1]))
    with pytest.raises(warc.BadWarc):
        list(warc.records_of(b"x" + data))


def test_empty(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.page_digests(spark, path).count() == 0
