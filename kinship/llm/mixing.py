"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power alpha, normalised; alpha 1 keeps the shares, 0 makes all sources equal. alpha is
found by bisection: the least one for which no source repeats more often than a limit, or the one at which the weights have a target
entropy. A token budget then gives each source so many tokens; whole passes over its documents are copies of each, and the rest is
a part of a pass: documents lie in blocks by a hash, blocks in a permuted order, and those that fit the rest come along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_key, stored

#: Documents that a block holds on average.
PER_BLOCK = 256


def tempered(shares: dict, alpha: float) -> dict:
    """Normalised powers of positive shares."""
    raw = {k: s**alpha for k, s in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def repetitions(shares: dict, alpha: float) -> dict:
    """Passes over each source under a budget that just covers every source once: 1 for the largest."""
    w = tempered(shares, alpha)
    unit = min(w[k] / shares[k] for k in shares)
    return {k: w[k] / shares[k] / unit for k in shares}


def bisected(shares: dict, max_repeats: float | None = None, min_entropy: float | None = None, steps: int = 60) -> float:
    """The least alpha in [0, 1] whose repetitions stay within max_repeats, or the largest whose entropy reaches min_entropy; of
    the nearest end if none does."""
    if max_repeats is not None:
        good = lambda a: max(repetitions(shares, a).values()) <= max_repeats
    else:
        good = lambda a: entropy(tempered(shares, a)) < min_entropy
    if good(0.0):
        return 0.0
    low, high = 0.0, 1.0  # low is not good; high is, or is the end
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return low if max_repeats is None else high


def n_tokens(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def plan(docs: DataFrame, max_repeats: float | None = 2.0, min_entropy: float | None = None, budget: int | None = None, source: str = "source", text: str = "text") -> list[dict]:
    """For each source, in order of name (null last): source, n_docs, tokens, weight, target, passes (whole ones) and rest (tokens of
    the part of a pass). One row a source reaches the driver.

    Without a budget the mix covers every source once and repeats the smaller ones; a budget below that takes parts of sources.
    Sources without tokens have weight 0 and one pass without a budget, none with one."""
    rows = [r.asDict() for r in docs.select(F.col(source).cast("string").alias("source"), n_tokens(F.col(text)).alias("t")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("t").alias("tokens")).collect()]
    rows.sort(key=lambda r: (r["source"] is None, str(r["source"])))
    total = sum(r["tokens"] for r in rows)
    shares = {i: r["tokens"] / total for i, r in enumerate(rows) if r["tokens"]}
    weights, size = {}, 0.0
    if shares:
        alpha = bisected(shares, max_repeats, min_entropy)
        weights = tempered(shares, alpha)
        size = budget if budget is not None else total / min(weights[i] / shares[i] for i in shares)
    for i, r in enumerate(rows):
        w = weights.get(i, 0.0)
        r["weight"] = w
        r["target"] = round(w * size)
        r["passes"] = r["target"] // r["tokens"] if r["tokens"] else int(budget is None)
        r["rest"] = r["target"] - r["passes"] * r["tokens"] if r["tokens"] else 0
    return rows


def copies(docs: DataFrame, planned: list[dict], seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(row, n_tokens, copies): each row of docs as a struct, its tokens, and how often it comes in the mix, a long. Rows that agree in id and
    text agree in copies, and are taken or left together."""
    spark = docs.sparkSession
    sources = spark.createDataFrame([(r["source"], r["passes"], r["rest"], max(1, r["n_docs"] // PER_BLOCK)) for r in planned], "source string, passes long, rest long, blocks long")
    sources = F.broadcast(sources)  # one row a source, all of which plan() has collected
    d = docs.select(F.struct(*docs.columns).alias("row"), row_key(doc_id, text).alias("key"), n_tokens(F.col(text)).alias("n_tokens"), F.col(source).cast("string").alias("of"))
    d = d.join(sources, F.col("of").eqNullSafe(F.col("source")), "left").drop("of")
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks")))
    # Blocks in an order permuted by hash, and the tokens ahead of each. A source's blocks are summed in stretches first, so that no task
    # orders more than the stretches of a source or the blocks of a stretch.
    size = d.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"))
    size = stored(size.withColumn("at", F.xxhash64(F.lit(seed + 1), "block")).withColumn("stretch", _stretch(F.col("at"))), "blocks")
    w = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = size.groupBy("source", "stretch").agg(F.sum("t").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(w), F.lit(0))).select(F.col("source").alias("s2"), F.col("stretch").alias("st2"), "base")
    w = Window.partitionBy("source", "stretch").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = size.withColumn("in", F.coalesce(F.sum("t").over(w), F.lit(0)))
    ahead = ahead.join(before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("stretch") == F.col("st2")))
    # The block in which the rest of the budget ends: its documents follow in order of hash. Others come whole or not at all.
    ahead = stored(ahead.select(F.col("source").alias("s3"), F.col("block").alias("b3"), "t", (F.col("base") + F.col("in")).alias("ahead")), "ahead")
    d = d.join(ahead, F.col("source").eqNullSafe(F.col("s3")) & (F.col("block") == F.col("b3")), "left")
    whole = F.col("ahead") + F.col("t") <= F.col("rest")
    parts = d.where(~whole & (F.col("ahead") < F.col("rest"))).groupBy("source", "key", "rest", "ahead").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "key"), "key").rowsBetween(Window.unboundedPreceding, 0)
    last = parts.withColumn("to", F.col("ahead") + F.sum("n").over(w)).where(F.col("to") <= F.col("rest"))
    last = stored(last.select(F.col("source").alias("s4"), F.col("key").alias("k4")).distinct(), "last")
    d = d.join(last, F.col("source").eqNullSafe(F.col("s4")) & (F.col("key") == F.col("k4")), "left")
    extra = F.when(F.coalesce(whole, F.lit(False)) & (F.col("rest") > 0), 1).when(F.col("k4").isNotNull(), 1).otherwise(0)
    return d.select("row", "n_tokens", (F.coalesce("passes", F.lit(0)) + extra).cast("long").alias("copies"))


def _stretch(at: Column) -> Column:
    return F.shiftright(at, 54)


def mixed(docs: DataFrame, max_repeats: float | None = 2.0, min_entropy: float | None = None, budget: int | None = None, seed: int = 17) -> DataFrame:
    """The rows of docs, all columns, as often as the mix has them; docs must have doc_id, source and text. Rows with a null source are
    a source of their own; null texts have no tokens; an empty table stays empty."""
    c = copies(docs, plan(docs, max_repeats, min_entropy, budget), seed)
    return c.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
