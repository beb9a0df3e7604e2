"""Queries of this subpackage: each applies its operator to a whole table and derives the columns that are compared."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table
from .sql import ORACLES


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    r = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return r.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import read_tokens, write_tokens

    path = new_path(spark, "token_ids")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(spark, path, ids=False)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import every_fifth, lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), every_fifth(F.col("doc_id")))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import copies, plan

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return copies(docs, plan(docs)).select("row.doc_id", "row.source", "n_tokens", "copies")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import TOOLS, formatted
    from .toolview import with_calls

    return formatted(with_calls(table(spark, sf_dir, "conversations")), TOOLS)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 3, (85, 100)).drop("key")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_digests, write_warc

    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_digests(spark, path)


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import TEMPLATES, TEXTS, license_scan

    return license_scan(table(spark, sf_dir, "documents"), inside=TEMPLATES + TEXTS)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, fold, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = fit(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read_media, write_media

    path = new_path(spark, "media")
    write_media(table(spark, sf_dir, "documents"), path)
    return read_media(spark, path)


QUERIES = [
    op1_decontaminate,
    op2_token_ids,
    op3_lm_score,
    op4_mix,
    op5_chat,
    op6_minhash,
    op7_warc,
    op8_license,
    op9_langid,
    op10_webp,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
