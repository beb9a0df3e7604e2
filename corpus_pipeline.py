"""From raw documents to token files: language, near duplicates, benchmark passages, mixing, token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's docs, with the columns of documents
but for the last, which returns a row for each document in the token files: doc_id, start, n_tokens, ids_crc32.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinship.llm.common import drop, new_path, scope, table
from kinship.llm.decontaminate import remove_contaminated
from kinship.llm.langid import fit, fold, judged
from kinship.llm.mixing import mixed
from kinship.llm.neardup import one_of_each
from kinship.llm.tokens import read_tokens, write_tokens

#: The vocabulary, and the id that ends a document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject; it is fitted on three quarters of the labelled ones."""
    model = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return judged(docs, model).where("not rejected").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles of a similarity of 0.8 or more."""
    return one_of_each(docs, 5, (4, 5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in passages of the benchmark."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of smaller sources again, up to two passes, by temperature."""
    return mixed(docs, max_repeats=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in range-coded files, and what each document has in them."""
    path = new_path(spark, "token_ids", keep=True)
    write_tokens(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    return read_tokens(spark, path, ids=False)


STAGES = [
    ("language", language),
    ("near duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token ids", tokens),
]
#: The classifier and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. What a stage read or stored on its way is deleted
    once it is written; the token files and the last stage's rows stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"), keep=True)
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
