"""The engine's jobs: train, predict, merge. Each is one plan over all countries; candidates and scores are stored in between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DecideConfig, LinkConfig
from ..functions.text import normalize, record_columns
from ..operators import blocking, decide, features, metric, model
from ..sources import sinks, tsv


@dataclass
class Trained:
    path: str
    threshold: float
    score: float


def prepared(records: DataFrame, path: str, romanise: bool = True) -> DataFrame:
    """Normalised records, stored at path: blocking and features read them many times."""
    return _stored(record_columns(normalize(records, romanise)), path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def featured(s1: DataFrame, targets: DataFrame, cfg: LinkConfig, work: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, features), candidates stored under work."""
    cands = _stored(blocking.candidate_union(s1, targets, cfg), f"{work}/candidates")
    return cands, features.pair_features(cands, s1, targets)


def train(spark: SparkSession, root: str, out: str, cfg: LinkConfig = LinkConfig(), sample: int = 30_000, valid_fraction: float = 0.25, seed: int = 42, iterations: int = 60) -> Trained:
    """Fit on sample source records of each country against all targets; the threshold is the best over all held-out entities."""
    s1, targets = tsv.load_split(spark, root, "train")
    s1, targets = prepared(model.sample_entities(s1, sample, seed), f"{out}/work/s1"), prepared(targets, f"{out}/work/targets")
    cands, pairs = featured(s1, targets, cfg, f"{out}/work")
    truth = tsv.truth_for(tsv.read_ground_truth(spark, f"{root}/train_ground_truth.tsv"), s1, targets)
    data = _stored(blocking.labelled(pairs, truth), f"{out}/work/labelled")
    split = model.group_split(s1, valid_fraction, seed)
    fitted = model.train(data, split, iterations=iterations, seed=seed)
    fitted.write().overwrite().save(f"{out}/model")
    held = split.where("held_out")
    scored = model.predict(fitted, data.join(held.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi"))
    scored = _stored(scored.select("country", "s1_id", "tgt_id", "p", "label"), f"{out}/work/valid")
    own = truth.join(held.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    curve = decide.sweep(scored, own, held).orderBy("threshold").collect()
    best = max(curve, key=lambda r: (round(r["macro_f05"], 9), -r["threshold"]))
    empty = metric.macro_f_beta(own.limit(0), own, held).first()[0]
    sinks.save_json(spark, {"threshold": best["threshold"], "valid_macro_f05": best["macro_f05"], "all_empty_baseline": empty, "curve": [[r["threshold"], r["macro_f05"]] for r in curve]}, f"{out}/threshold")
    per = s1.select(F.col("entity_id").alias("s1_id"), "country")
    recalls = truth.join(per, "s1_id").join(cands.select("s1_id", "tgt_id", F.lit(1).alias("hit")), ["s1_id", "tgt_id"], "left").groupBy("country").agg((F.count("hit") / F.count("*")).alias("recall"))
    sinks.save_json(spark, {r["country"]: r["recall"] for r in recalls.collect()}, f"{out}/blocking_recall")
    return Trained(f"{out}/model", best["threshold"], best["macro_f05"])


def predict(spark: SparkSession, root: str, artifacts: str, out: str, split: str = "test", country: str | None = None, cfg: LinkConfig = LinkConfig(), decision: DecideConfig | None = None, shard: int = 0, shards: int = 1) -> dict[str, dict[str, int]]:
    """Score a split, store the scores, write matches and candidates. Countries unknown to training are linked like any other."""
    from pyspark.ml import PipelineModel

    s1, targets = tsv.load_split(spark, root, split, country)
    s1, targets = prepared(tsv.shard_of(s1, shard, shards), f"{out}/work/s1"), prepared(targets, f"{out}/work/targets")
    cands, pairs = featured(s1, targets, cfg, f"{out}/work")
    if decision is None:
        decision = DecideConfig(threshold=sinks.load_json(spark, f"{artifacts}/threshold")["threshold"])
    scored = model.predict(PipelineModel.load(f"{artifacts}/model"), pairs).select("country", "s1_id", "tgt_id", "p")
    scored = sinks.save_scores(scored, f"{out}/scores")
    return decided(scored, cands, s1, out, decision)


def decided(scored: DataFrame, cands: DataFrame, s1: DataFrame, out: str, decision: DecideConfig) -> dict[str, dict[str, int]]:
    """Decide on stored scores, and write both files."""
    return {
        "matches": sinks.write_matches(decide.select(scored, decision), s1, f"{out}/matching_results"),
        "candidates": sinks.write_candidates(cands, s1, f"{out}/candidate_pairs"),
    }


def merge(spark: SparkSession, root: str, parts: list[str], out: str, split: str = "test") -> dict[str, dict[str, int]]:
    """The files of several shards or countries as one. Shards decide apart, so that two may claim a target; decide again on their
    stored scores together (decided) where that matters."""
    required = tsv.read_entity_ids(spark, f"{root}/{split}_source1.tsv")
    return {name: sinks.merge_partials(spark, [f"{p}/{name}" for p in parts], columns, required, f"{out}/{name}") for name, columns in (("matching_results", sinks.MATCHES), ("candidate_pairs", sinks.CANDIDATES))}
