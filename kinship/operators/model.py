"""Match probabilities by gradient-boosted trees."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import FEATURES


def group_split(entities: DataFrame, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """(entity_id, held_out): of n entities max(1, floor(n fraction)) are held out, those first in an order of hashes. The place of each
    is counted by the hash's leading digits first, so that no task orders all entities."""
    e = entities.select("entity_id").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "entity_id").cast("binary")))
    e = e.withColumn("lead", F.substr("h", F.lit(1), F.lit(3)))
    per = e.groupBy("lead").agg(F.count("*").alias("n"))
    base = per.withColumn("base", F.sum("n").over(Window.orderBy("lead")) - F.col("n")).select("lead", "base", F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))  # 4,096 rows
    place = F.row_number().over(Window.partitionBy("lead").orderBy("h", "entity_id")) + F.col("base")
    out = e.join(F.broadcast(base), "lead").withColumn("place", place)
    return out.select("entity_id", (F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("total") * fraction))).alias("held_out"))


def sample_entities(entities: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n source records of each country for training, by hash; targets are never sampled. The place of each in its country is counted by
    the hash's leading digits first, so that no task orders a country."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), "entity_id").cast("binary"))
    e = entities.withColumn("_h", key).withColumn("_lead", F.substr("_h", F.lit(1), F.lit(3)))
    per = e.groupBy("country", "_lead").agg(F.count("*").alias("_n"))  # 4,096 rows a country at most
    before = Window.partitionBy("country").orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_base") < n)
    place = F.row_number().over(Window.partitionBy("country", "_lead").orderBy("_h", "entity_id")) + F.col("_base")
    return e.join(per, ["country", "_lead"]).withColumn("_place", place).where(F.col("_place") <= n).select(*entities.columns)


def train(labelled: DataFrame, valid: DataFrame | None = None, features: list[str] = FEATURES, iterations: int = 60, step: float = 0.08, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Fit on labelled (features, label). valid (entity_id, held_out) tells the entities on which training stops early."""
    data = labelled.withColumn("label", F.col("label").cast("double"))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=iterations, stepSize=step, maxDepth=depth, minInstancesPerNode=20, subsamplingRate=0.8, featureSubsetStrategy="0.9", validationTol=0.001, seed=seed)
    if valid is not None:
        data = data.join(valid.select(F.col("entity_id").alias("s1_id"), "held_out"), "s1_id")
        gbt = gbt.setValidationIndicatorCol("held_out")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), gbt]).fit(data)


def predict(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """pairs with p, the probability of a match."""
    return model.transform(pairs).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(spark, model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    """(feature, gain_percent)."""
    gain = model.stages[-1].featureImportances.toArray()
    total = float(gain.sum()) or 1.0
    return spark.createDataFrame([(f, 100 * float(g) / total) for f, g in zip(features, gain, strict=True)], "feature string, gain_percent double")


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, positive_rate) in bins of equal width, 1 in the last. scored has p and label."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return scored.groupBy(b).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("positive_rate"))
