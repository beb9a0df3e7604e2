import pytest
from pyspark.sql import functions as F

from kinship.operators.validate import validate
from kinship.sources import sinks, tsv

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_reading(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text(HEAD + 'S1-1\t"Unbalanced\t\tUS\nS1-2\ta, b\tx\tIN\n')
    rows = tsv.scan_source(spark, str(p), check=True).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", '"Unbalanced', "", "US"), ("S1-2", "a, b", "x", "IN")]
    assert tsv.scan_source(spark, str(p), "IN").count() == 1
    assert tsv.read_source(spark, str(p), columns=["country"]).columns == ["country"]
    assert [r[0] for r in tsv.discover_countries(tsv.scan_source(spark, str(p))).collect()] == ["IN", "US"]
    plan = tsv.scan_source(spark, str(p), "US")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan


def test_headers_and_fields(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("entity_id,business_name,business_address,country\n")
    with pytest.raises(tsv.HeaderError, match="without tab"):
        tsv.read_source(spark, str(p))
    p.write_text("id\tbusiness_name\tbusiness_address\tcountry\n")
    with pytest.raises(tsv.HeaderError, match="expected"):
        tsv.read_source(spark, str(p))
    p.write_text(HEAD + "S1-1\ta\tb\tUS\textra\n")
    with pytest.raises(tsv.FieldCountError):
        tsv.read_source(spark, str(p))


def test_truth(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2,,S2-1\nS1-2\t\n\n")
    truth = tsv.read_ground_truth(spark, str(p))
    assert {r["s1_id"]: r["matched"] for r in truth.collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    assert tuple(tsv.singletons(truth).first()) == (2, 1)
    entities = spark.createDataFrame([("S1-1",)], "entity_id string")
    targets = spark.createDataFrame([("S2-1",)], "entity_id string")
    assert [tuple(r) for r in tsv.truth_for(truth, entities, targets).collect()] == [("S1-1", "S2-1")]
    p.write_text("source1_entity_id\tmatched_entity_ids\nS1-1 no tab\n")
    with pytest.raises(tsv.FieldCountError):
        tsv.read_ground_truth(spark, str(p))


def test_shards_are_disjoint(spark):
    df = spark.range(100).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("entity_id"))
    assert sum(tsv.shard_of(df, i, 3).count() for i in range(3)) == 100


def test_cleaning(spark):
    df = spark.createDataFrame([("S1-0", ["S3-2", " S2-1 ", "S2-1", "S1-9", "X-1", ""]), ("S1-1", None)], "s1_id string, ids array<string>")
    rows = {r["s1_id"]: r for r in sinks.cleaned(df).collect()}
    assert rows["S1-0"].asDict() == {"s1_id": "S1-0", "ids": ["S2-1", "S3-2"], "duplicate_in_list": 1, "self_match": 1, "bad_prefix": 1}
    assert rows["S1-1"]["ids"] == []


def test_writing_merging_validating(spark, tmp_path):
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1")], "s1_id string, tgt_id string")
    out = str(tmp_path / "m")
    stats = sinks.write_matches(pairs, entities, out)
    assert (stats["rows"], stats["empty"], stats["total_ids"]) == (2, 1, 2)
    lines = sorted(r[0] for r in spark.read.text(out).collect())
    assert lines == ["S1-1\tS2-1,S3-2", "S1-2\t", "source1_entity_id\tmatched_entity_ids"]
    sinks.write_candidates(pairs, entities, str(tmp_path / "c"))
    assert validate(spark, out, str(tmp_path / "c"), entities).ok
    with pytest.raises(sinks.SubmissionError):
        sinks.write_id_lists(sinks.id_lists(pairs, entities).where("s1_id = 'S1-1'"), str(tmp_path / "x"), sinks.MATCHES, entities)
    one, two = str(tmp_path / "p1"), str(tmp_path / "p2")
    for p, e in ((one, "S1-1"), (two, "S1-2")):
        sinks.write_matches(pairs.where(F.col("s1_id") == e), entities.where(F.col("entity_id") == e), p)
    merged = sinks.merge_partials(spark, [one, two], sinks.MATCHES, entities, str(tmp_path / "all"))
    assert merged["rows"] == 2
    with pytest.raises(sinks.SubmissionError, match="repeated"):
        sinks.merge_partials(spark, [one, one, two], sinks.MATCHES, entities, str(tmp_path / "all2"))
    with pytest.raises(sinks.SubmissionError, match="missing"):
        sinks.merge_partials(spark, [one], sinks.MATCHES, entities, str(tmp_path / "all3"))


def test_validator(spark, tmp_path):
    p = tmp_path / "m.tsv"
    entities = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    p.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2\nS1-1\tS2-1,S2-1\nS1-2\tS1-2,S3-9\nS1-9\t\nbroken\n\n")
    report = validate(spark, str(p), None, entities, known)
    rules = {e.split(": ")[1].split(" in ")[0] for e in report.errors}
    assert rules == {"malformed", "duplicate_row", "duplicate_in_list", "self_match", "bad_prefix", "unknown_id", "missing_entity", "unexpected_entity"}
    assert "FAIL" in str(report)
    assert "no such file" in validate(spark, str(tmp_path / "none"), None, entities).errors[0]
    p.write_text("source1_entity_id,matched_entity_ids\n")
    assert "commas" in validate(spark, str(p), None, entities).errors[0]
    c = tmp_path / "c.tsv"
    p.write_text("Source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-3\t\n")
    c.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\t\nS1-2\t\nS1-3\t\n")
    report = validate(spark, str(p), str(c), entities)
    assert report.ok and "1 entities" in report.warnings[0]


def test_country_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "s.tsv")
    with open(path, "w") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\t\tUS\nS1-2\tb\tx\t\nS1-3\tc\ty\tIndia\n")
    df = tsv.scan_source(spark, path, "US")
    assert "EqualTo(country,US)" in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("S1-1", "a", "", "US")]
    assert [r["entity_id"] for r in tsv.scan_source(spark, path, "").collect()] == ["S1-2"]


def test_header_comes_first_and_one_file(spark, tmp_path):
    import os

    e = spark.createDataFrame([(f"S1-{i}",) for i in range(50)], "entity_id string").repartition(7)
    pairs = spark.createDataFrame([("S1-3", "S2-1")], "s1_id string, tgt_id string")
    out, one = str(tmp_path / "out"), str(tmp_path / "one.tsv")
    sinks.write_matches(pairs, e, out)
    assert sorted(x for x in os.listdir(out) if x.startswith("part-"))[0] == sinks.HEADER
    sinks.export_file(spark, out, one)
    lines = open(one).read().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and len(lines) == 51 and "S1-3\tS2-1" in lines
    assert {r["s1_id"] for r in sinks.read_id_lists(spark, out, sinks.MATCHES).collect()} == {f"S1-{i}" for i in range(50)}


def test_sample_counts_exactly(spark):
    from kinship.operators import model

    e = spark.range(3000).selectExpr("concat('S1-', id) entity_id", "if(id % 3 = 0, 'US', 'India') country")
    got = {r["country"]: r["n"] for r in model.sample_entities(e, 700).groupBy("country").agg(F.count("*").alias("n")).collect()}
    assert got == {"US": 700, "India": 700}
    assert model.sample_entities(e, 1500).where("country = 'US'").count() == 1000
    first = {r[0] for r in model.sample_entities(e, 10).select("entity_id").collect()}
    assert first <= {r[0] for r in model.sample_entities(e, 700).select("entity_id").collect()}
