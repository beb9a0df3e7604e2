"""Linking target records as they arrive: a stream joined with the stored source records by exact key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.text import normalize
from ..operators.features import jaccard


def arriving_matches(arrivals: DataFrame, s1: DataFrame, threshold: float = 1.0, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """(country, s1_id, tgt_id, p) of a stream of target records against normalised source records: the exact name or address key proposes,
    the sum of both Jaccards decides. A stream-static join keeps no state; a target that arrives twice is matched twice."""
    t = normalize(arrivals).select("country", F.col("entity_id").alias("tgt_id"), *(F.col(c).alias(f"t_{c}") for c in ("name_norm", "addr_norm", "name_block", "addr_block")))
    keys = F.explode(F.array_distinct(F.filter(F.array(F.struct(F.lit("n").alias("of"), F.col("t_name_block").alias("key")), F.struct(F.lit("a").alias("of"), F.col("t_addr_block").alias("key"))), lambda k: F.length(k["key"]) >= cfg.min_key))).alias("k")
    s = s1.select("country", F.col("entity_id").alias("s1_id"), F.col("name_norm").alias("s_name_norm"), F.col("addr_norm").alias("s_addr_norm"), "name_block", "addr_block")
    by = F.explode(F.array(F.struct(F.lit("n").alias("of"), F.col("name_block").alias("key")), F.struct(F.lit("a").alias("of"), F.col("addr_block").alias("key")))).alias("k")
    s = s.select("country", "s1_id", "s_name_norm", "s_addr_norm", "name_block", "addr_block", by).where(F.length("k.key") >= cfg.min_key)
    pairs = t.select("*", keys).join(s, ["country", "k"])
    # Both keys may hit: the name's hit counts, the address's only where the names' keys differ.
    pairs = pairs.where((F.col("k.of") == "n") | (F.col("t_name_block") != F.col("name_block")))
    return pairs.select("country", "s1_id", "tgt_id", (jaccard("name_norm") + jaccard("addr_norm")).alias("p")).where(F.col("p") >= threshold)
