"""Business records made of the documents table: a language is a country, a document's source number decides which of the three
sources it is in, its first six words are a name and the next twenty an address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, record_columns

SPACES = "[ \\t\\n\\r\\f]+"
#: Characters that hold the first 26 words of most texts.
_BEGIN = 512


def source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, entity_id, business_name, business_address)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    n = F.substr("source", F.lit(4)).cast("int") % 3 + 1
    whole = F.coalesce("text", F.lit(""))
    begin = F.split(F.trim(F.left(whole, F.lit(_BEGIN))), SPACES, 27)  # the rest of the text stays in one piece
    words = F.when(F.size(begin) == 27, begin).otherwise(F.split(F.trim(whole), SPACES, 27))  # 26 whole words, or else all of the text
    part = lambda a, k: F.array_join(F.slice(words, a, k), " ")
    return d.select(F.col("lang").alias("country"), F.concat(F.lit("S"), n.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), part(1, 6).alias("business_name"), part(7, 20).alias("business_address"))


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_columns(normalize(source_view(spark, sf_dir)))


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source 1, targets), normalised."""
    r = all_records(spark, sf_dir)
    mine = F.col("entity_id").startswith("S1-")
    return r.where(mine), r.where(~mine)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, tgt_id) of documents with the same text and language in source 1 and another."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").where("text is not null")
    n = F.substr("source", F.lit(4)).cast("int") % 3 + 1
    d = d.select("lang", F.sha2("text", 256).alias("h"), n.alias("n"), F.concat(F.lit("S"), n.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"))
    return d.where("n = 1").select("lang", "h", F.col("id").alias("s1_id")).join(d.where("n <> 1").select("lang", "h", F.col("id").alias("tgt_id")), ["lang", "h"]).select("s1_id", "tgt_id").distinct()


def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, text_id): 64 bits of a whole text, null without one. A pair of equal country and text_id is in truth."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    n = F.substr("source", F.lit(4)).cast("int") % 3 + 1
    return d.select(F.concat(F.lit("S"), n.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_id"))
