"""Macro F-beta over entities' sets of matches. Sets come as pairs (s1_id, tgt_id) beside a table of all entities (entity_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IdError(ValueError):
    """Predictions for unknown entities, or none for known ones."""


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """F-beta, 0 where both are 0."""
    b = beta * beta
    down = b * precision + recall
    return F.when(down > 0, (1 + b) * precision * recall / down).otherwise(0.0)


def set_f_beta(pred: Column, truth: Column, beta: float = 0.5) -> Column:
    """F-beta of two arrays as sets: 1 if both are empty, 0 if one is or they share nothing."""
    pred, truth = F.array_distinct(pred), F.array_distinct(truth)
    hits = F.size(F.array_intersect(pred, truth))
    f = f_beta(hits / F.size(pred), hits / F.size(truth), beta)
    return F.when((F.size(pred) == 0) & (F.size(truth) == 0), 1.0).when(hits == 0, 0.0).otherwise(f)


def entity_scores(pred: DataFrame, truth: DataFrame, entities: DataFrame, beta: float = 0.5) -> DataFrame:
    """(s1_id, n_pred, n_true, n_hit, f): a row for each entity, without prediction an empty set."""
    p = pred.select("s1_id", "tgt_id").distinct().withColumn("p", F.lit(1))
    t = truth.select("s1_id", "tgt_id").distinct().withColumn("t", F.lit(1))
    n = p.join(t, ["s1_id", "tgt_id"], "full").groupBy("s1_id").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count(F.when(F.col("p") == F.col("t"), 1)).alias("n_hit"))
    n = entities.select(F.col("entity_id").alias("s1_id")).distinct().join(n, "s1_id", "left").na.fill(0)
    f = f_beta(F.col("n_hit") / F.col("n_pred"), F.col("n_hit") / F.col("n_true"), beta)
    return n.withColumn("f", F.when((F.col("n_pred") == 0) & (F.col("n_true") == 0), 1.0).when(F.col("n_hit") == 0, 0.0).otherwise(f))


def check_ids(answered: DataFrame, entities: DataFrame) -> None:
    """Strict scoring: answered (s1_id) must be just the entities."""
    need = entities.select(F.col("entity_id").alias("s1_id"))
    for what, df in (("missing", need.join(answered, "s1_id", "left_anti")), ("unknown", answered.join(need, "s1_id", "left_anti"))):
        if bad := [r["s1_id"] for r in df.select("s1_id").distinct().orderBy("s1_id").take(5)]:
            raise IdError(f"{what}: {bad}")


def macro_f_beta(pred: DataFrame, truth: DataFrame, entities: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row (macro_f): the mean over entities, 0 if there are none."""
    return entity_scores(pred, truth, entities, beta).agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("macro_f"))


def breakdown(pred: DataFrame, truth: DataFrame, entities: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row: macro_f; count, mean and contribution to it of the entities without true matches and of the others; and the share of the
    first. The mean of an empty class is NaN."""
    s = entity_scores(pred, truth, entities, beta)
    out = [F.coalesce(F.avg("f"), F.lit(0.0)).alias("macro_f")]
    for name, test in (("singleton", F.col("n_true") == 0), ("non_singleton", F.col("n_true") > 0)):
        f = F.when(test, F.col("f"))
        out += [F.count_if(test).alias(f"{name}_n"), F.coalesce(F.avg(f), F.lit(float("nan"))).alias(f"{name}_mean"), F.coalesce(F.sum(f) / F.count("*"), F.lit(0.0)).alias(f"{name}_part")]
    return s.agg(*out, F.coalesce(F.count_if(F.col("n_true") == 0) / F.count("*"), F.lit(0.0)).alias("singleton_share"))


def by_cardinality(pred: DataFrame, truth: DataFrame, entities: DataFrame, beta: float = 0.5) -> DataFrame:
    """(bucket, n, mean_f) by the number of true matches, 4 and more together."""
    s = entity_scores(pred, truth, entities, beta)
    return s.groupBy(F.least("n_true", F.lit(4)).alias("bucket")).agg(F.count("*").alias("n"), F.avg("f").alias("mean_f"))
