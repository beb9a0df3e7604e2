"""Analyses of a linkage run: policies on an entity's ranked candidates, lost pairs, rewrites that labels suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(scored: DataFrame) -> DataFrame:
    """scored (s1_id, tgt_id, p) with place from 1, first (the entity's best p) and before (the p one place up, null for the first)."""
    w = Window.partitionBy("s1_id").orderBy(F.col("p").desc(), "tgt_id")
    return scored.withColumns({"place": F.row_number().over(w), "first": F.first_value("p").over(w), "before": F.lag("p").over(w)})


def prefix_policies(scored: DataFrame, threshold: float, k: int = 3, floor: float = 0.5, ratio: float = 0.8, gap: float = 0.2) -> DataFrame:
    """(policy, s1_id, tgt_id) kept by six policies: global (threshold), topk_floor (k best over a floor), capped (threshold, k at most),
    leading (ratio of the best), successive (ratio of the one before, up to the first miss) and gap (up to the first fall by more)."""
    r = ranked(scored)
    so_far = Window.partitionBy("s1_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    holds = lambda ok: F.min(F.when(F.col("before").isNull() | ok, 1).otherwise(0)).over(so_far) == 1
    p, over = F.col("p"), F.col("p") >= threshold
    rules: dict[str, Column] = {
        "global": over,
        "topk_floor": (F.col("place") <= k) & (p >= floor),
        "capped": over & (F.col("place") <= k),
        "leading": (F.col("first") >= threshold) & (p >= ratio * F.col("first")),
        "successive": (F.col("first") >= threshold) & holds(p >= ratio * F.col("before")),
        "gap": (F.col("first") >= threshold) & holds(F.col("before") - p <= gap),
    }
    r = r.withColumns({f"_{k}": v for k, v in rules.items()})
    each = F.explode(F.filter(F.array(*(F.when(F.col(f"_{k}"), F.lit(k)) for k in rules)), lambda x: x.isNotNull())).alias("policy")
    return r.select(each, "s1_id", "tgt_id")


def lost_pairs(truth: DataFrame, cands: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: true pairs, found (selected), lost in blocking and lost by the decision; the three add up."""
    c = cands.select("s1_id", "tgt_id").distinct().withColumn("c", F.lit(1))
    s = selected.select("s1_id", "tgt_id").distinct().withColumn("s", F.lit(1))
    t = truth.join(c, ["s1_id", "tgt_id"], "left").join(s, ["s1_id", "tgt_id"], "left")
    return t.agg(F.count("*").alias("total"), F.count("s").alias("tp"), F.count_if(F.col("c").isNull() & F.col("s").isNull()).alias("fn_blocked"), F.count_if(F.col("c").isNotNull() & F.col("s").isNull()).alias("fn_model"))


def mined_rewrites(pairs: DataFrame, support: int = 10, confidence: float = 0.6) -> DataFrame:
    """(t_token, s_token, n, confidence) from true pairs (s_tokens, t_tokens) that differ in one token on each side: how often a target's
    token stands for a source's."""
    s, t = F.array_except("s_tokens", "t_tokens"), F.array_except("t_tokens", "s_tokens")
    one = pairs.select(s.alias("s"), t.alias("t")).where((F.size("s") == 1) & (F.size("t") == 1)).select(F.get("s", F.lit(0)).alias("s_token"), F.get("t", F.lit(0)).alias("t_token"))
    n = one.groupBy("t_token", "s_token").agg(F.count("*").alias("n"))
    total = n.groupBy("t_token").agg(F.sum("n").alias("total"))
    return n.join(total, "t_token").withColumn("confidence", F.col("n") / F.col("total")).where((F.col("n") >= support) & (F.col("confidence") >= confidence)).drop("total")


def reject_rate_by_quantile(scored: DataFrame, value: str, threshold: float, parts: int = 5) -> DataFrame:
    """(part, n, reject_rate): pairs under the threshold in each of some equal parts by a feature, whose bounds come from its distinct
    values' counts, so that no task orders all pairs."""
    n = scored.groupBy(F.round(value, 6).alias("x")).agg(F.count("*").alias("n"), F.count_if(F.col("p") < threshold).alias("out"))
    cut = n.agg(*(F.percentile("x", F.lit(i / parts), F.col("n")).alias(f"q{i}") for i in range(1, parts)))
    part = F.lit(0)
    for i in range(1, parts):
        part = part + (F.col("x") > F.col(f"q{i}")).cast("int")
    return n.crossJoin(F.broadcast(cut)).groupBy(part.alias("part")).agg(F.sum("n").alias("n"), (F.sum("out") / F.sum("n")).alias("reject_rate"))  # one row of bounds
