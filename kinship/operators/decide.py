"""From scored pairs (s1_id, tgt_id, p) to a set of targets for each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DecideConfig
from .metric import f_beta

GRID = [round(0.05 + 0.025 * i, 3) for i in range(37)]
REPORT = [round(0.20 + 0.05 * i, 2) for i in range(14)]


def exclusive(scored: DataFrame) -> DataFrame:
    """Each target's pair of the highest p, ties to the lowest entity id. Over the whole table, so that no two parts claim a target."""
    w = Window.partitionBy("tgt_id").orderBy(F.col("p").desc(), "s1_id")
    return scored.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def select(scored: DataFrame, cfg: DecideConfig = DecideConfig()) -> DataFrame:
    """Pairs with p at the threshold or over it; then, with a gate above the threshold, only of entities whose best candidate reaches the
    gate; then one entity for each target."""
    kept = scored
    if cfg.gate is not None and cfg.gate > cfg.threshold:
        kept = kept.withColumn("best", F.max("p").over(Window.partitionBy("s1_id"))).where(F.col("best") >= cfg.gate).drop("best")
    kept = kept.where(F.col("p") >= cfg.threshold)
    return exclusive(kept) if cfg.exclusive else kept


def _on_grid(scored: DataFrame, grid: list[float], enforce: bool) -> DataFrame:
    """Pairs selected at each threshold: a target's owner does not depend on the threshold, as its best pair is the first to pass any."""
    won = exclusive(scored) if enforce else scored
    steps = F.filter(F.array(*(F.lit(t) for t in grid)), lambda t: t <= F.col("p"))
    return won.select("s1_id", "tgt_id", "p", F.explode(steps).alias("threshold"))


def sweep(scored: DataFrame, truth: DataFrame, entities: DataFrame, grid: list[float] = GRID, enforce: bool = True) -> DataFrame:
    """(threshold, macro_f05) over all the given entities, those without candidates too."""
    n_true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    hit = truth.select("s1_id", "tgt_id", F.lit(1).alias("hit"))
    per = _on_grid(scored, grid, enforce).join(hit, ["s1_id", "tgt_id"], "left").groupBy("threshold", "s1_id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("n_hit"))
    per = per.join(n_true, "s1_id", "left").na.fill(0, ["n_true"])
    f = F.when((F.col("n_true") > 0) & (F.col("n_hit") > 0), f_beta(F.col("n_hit") / F.col("n_pred"), F.col("n_hit") / F.col("n_true"))).otherwise(0.0)
    won = per.groupBy("threshold").agg(F.sum(f).alias("score"), F.count_if(F.col("n_true") == 0).alias("lost"))
    # An entity without predictions scores 1 if it has no truth: all of those, less the ones that have some prediction.
    base = entities.select(F.col("entity_id").alias("s1_id")).distinct().join(n_true, "s1_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("n_true").isNull()).alias("single"))
    steps = scored.sparkSession.createDataFrame([(t,) for t in grid], "threshold double")
    out = steps.join(F.broadcast(won), "threshold", "left").na.fill(0).crossJoin(F.broadcast(base))  # a row a threshold by one row
    return out.select("threshold", F.when(F.col("n") == 0, 0.0).otherwise((F.col("score") + F.col("single") - F.col("lost")) / F.col("n")).alias("macro_f05"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """One row (threshold, macro_f05): the highest score, the lowest threshold of equal ones."""
    score = F.round("macro_f05", 9)
    return curve.agg(F.max_by(F.struct("threshold", "macro_f05"), F.struct(score, -F.col("threshold"))).alias("b")).select("b.*")


def threshold_report(scored: DataFrame, entities: DataFrame, grid: list[float] = REPORT, enforce: bool = True) -> DataFrame:
    """(threshold, empty_share, mean_size of non-empty sets, total) without labels."""
    n = entities.select("entity_id").distinct().agg(F.count("*").alias("n"))
    per = _on_grid(scored, grid, enforce).groupBy("threshold", "s1_id").agg(F.count("*").alias("size"))
    per = per.groupBy("threshold").agg(F.count("*").alias("some"), F.sum("size").alias("total"))
    steps = scored.sparkSession.createDataFrame([(t,) for t in grid], "threshold double")
    out = steps.join(F.broadcast(per), "threshold", "left").na.fill(0).crossJoin(F.broadcast(n))  # a row a threshold by one row
    return out.select("threshold", (1 - F.col("some") / F.col("n")).alias("empty_share"), F.when(F.col("some") > 0, F.col("total") / F.col("some")).otherwise(0.0).alias("mean_size"), "total")


def set_sizes(selected: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, empty, total and the mean size of non-empty sets."""
    n = selected.groupBy("s1_id").agg(F.count("*").alias("n"))
    n = entities.select(F.col("entity_id").alias("s1_id")).join(n, "s1_id", "left").na.fill(0, ["n"])
    return n.agg(F.count("*").alias("entities"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("total"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean_size"))
