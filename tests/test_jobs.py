import os

import make_fixture
from pyspark.sql import functions as F

from kinship.__main__ import arguments
from kinship.config import DecideConfig, LinkConfig
from kinship.functions.text import normalize
from kinship.operators import decide, metric
from kinship.operators.validate import validate
from kinship.plans import pipeline
from kinship.sources import sinks, tsv
from kinship.streaming.arrivals import arriving_matches


def test_train_predict_merge(spark, tmp_path):
    root, art, out = (str(tmp_path / x) for x in ("data", "art", "out"))
    make_fixture.write(root)
    trained = pipeline.train(spark, root, art, LinkConfig(), sample=300, iterations=10)
    assert trained.score > 0.5
    saved = sinks.load_json(spark, f"{art}/threshold")
    assert saved["threshold"] == trained.threshold and len(saved["curve"]) == 37 and saved["all_empty_baseline"] < 0.3
    assert min(sinks.load_json(spark, f"{art}/blocking_recall").values()) > 0.7
    stats = pipeline.predict(spark, root, art, out)
    assert stats["matches"]["rows"] == 120
    required = tsv.read_entity_ids(spark, f"{root}/test_source1.tsv")
    assert validate(spark, f"{out}/matching_results", f"{out}/candidate_pairs", required).ok
    # A country that training never saw is linked too.
    truth = tsv.read_ground_truth(spark, f"{root}/test_ground_truth.tsv")
    pred = sinks.read_id_lists(spark, f"{out}/matching_results", sinks.MATCHES).select("s1_id", F.explode("ids").alias("tgt_id"))
    s1 = tsv.scan_source(spark, f"{root}/test_source1.tsv", "Chile")
    own = tsv.truth_pairs(truth).join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    assert metric.macro_f_beta(pred.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi"), own, s1).first()[0] > 0.5
    # No target is claimed twice, and deciding again needs the stored scores alone.
    assert pred.groupBy("tgt_id").count().where("count > 1").count() == 0
    again = decide.select(spark.read.parquet(f"{out}/scores"), DecideConfig(trained.threshold))
    assert again.count() == pred.count()
    for i in (0, 1):
        pipeline.predict(spark, root, art, f"{out}{i}", shard=i, shards=2, decision=DecideConfig(trained.threshold))
    assert pipeline.merge(spark, root, [f"{out}0", f"{out}1"], str(tmp_path / "all"))["matching_results"]["rows"] == 120


def test_arguments():
    a = arguments(["predict", "--data", "d", "--artifacts", "a", "--output", "o", "--singleton-gate", "0.9", "--shard", "1", "--shards", "3"])
    assert (a.singleton_gate, a.shard, a.shards, a.no_exclusivity) == (0.9, 1, 3, False)


def test_stream(spark, tmp_path):
    schema = "entity_id string, business_name string, business_address string, country string"
    s1 = normalize(spark.createDataFrame([("S1-1", "Great Media Inc", "1 Long Rd", "US")], schema))
    inbox = str(tmp_path / "in")
    os.makedirs(inbox)
    spark.createDataFrame([("S2-1", "Great Media", "1 Long Road", "US"), ("S2-2", "Else", "where to go", "US"), ("S2-3", "Great Media", "1 Long Road", "IN")], schema).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(schema).parquet(inbox)
    q = arriving_matches(stream, s1, 0.5).writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["s1_id"], r["tgt_id"]) for r in spark.table("hits").collect()] == [("S1-1", "S2-1")]
