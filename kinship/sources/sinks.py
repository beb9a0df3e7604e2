"""Id-list files, partial results, cached scores and small JSON artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES = ["source1_entity_id", "matched_entity_ids"]
CANDIDATES = ["source1_entity_id", "candidate_entity_ids"]


class SubmissionError(ValueError):
    """Rows that a result file may not have, or lacks."""


def cleaned(lists: DataFrame) -> DataFrame:
    """(s1_id, ids array) with ids trimmed, distinct, sorted and of sources 2 and 3 only; and what was wrong: duplicate_in_list, self_match
    and bad_prefix, counted after empty ids went."""
    ids = F.filter(F.transform(F.coalesce("ids", F.array()), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    once = F.array_distinct("ids")
    good = lambda x: x.rlike("^S[23]-")
    mine = lambda x: x.startswith("S1-")
    df = lists.select("s1_id", ids.alias("ids"))
    return df.select(
        "s1_id",
        F.array_sort(F.filter(once, good)).alias("ids"),
        (F.size("ids") - F.size(once)).alias("duplicate_in_list"),
        F.size(F.filter(once, mine)).alias("self_match"),
        F.size(F.filter(once, lambda x: ~good(x) & ~mine(x))).alias("bad_prefix"),
    )


def id_lists(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1_id, ids): a sorted list for each entity, empty if it has no pair."""
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_set("tgt_id")).alias("ids"))
    return entities.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select("s1_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def coverage(lists: DataFrame, required: DataFrame) -> DataFrame:
    """(s1_id, problem): missing, extra and repeated entities."""
    need = required.select(F.col("entity_id").alias("s1_id")).distinct()
    out = need.join(lists, "s1_id", "left_anti").select("s1_id", F.lit("missing").alias("problem"))
    out = out.unionByName(lists.select("s1_id").distinct().join(need, "s1_id", "left_anti").select("s1_id", F.lit("extra").alias("problem")))
    return out.unionByName(lists.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").select("s1_id", F.lit("repeated").alias("problem")))


def write_id_lists(lists: DataFrame, path: str, columns: list[str], required: DataFrame, strict: bool = True) -> dict[str, int]:
    """Write (s1_id, ids) as TSV. strict refuses missing, extra and repeated entities and lists that need cleaning. Returns counts."""
    clean = cleaned(lists)
    found = coverage(lists, required).groupBy("problem").agg(F.count("*").alias("n")).collect()
    stats = {"missing": 0, "extra": 0, "repeated": 0} | {r["problem"]: r["n"] for r in found}
    total = clean.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("duplicate_in_list", "self_match", "bad_prefix")), F.count("*").alias("rows"), F.count_if(F.size("ids") == 0).alias("empty"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("total_ids")).first()
    stats |= total.asDict()
    wrong = {k: v for k, v in stats.items() if k not in ("rows", "empty", "total_ids") and v}
    if strict and wrong:
        raise SubmissionError(f"{path}: {wrong}")
    lines = clean.select(F.concat_ws("\t", "s1_id", F.array_join("ids", ",")).alias("value"))
    lines.write.mode("overwrite").text(path)
    _write_header(lists.sparkSession, path, "\t".join(columns))
    return stats


#: Sorts before the part files of a folder.
HEADER = "part-00000-0-header.txt"


def _write_header(spark: SparkSession, path: str, line: str) -> None:
    """The header as a file of its own, whose name sorts before all parts, by the file system that the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{HEADER}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((line + "\n").encode()))
    finally:
        out.close()


def export_file(spark: SparkSession, path: str, to: str) -> None:
    """The folder of a result as one file, header first: its parts one behind the other, streamed by the driver, in order of name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = folder.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in sorted(str(f.getPath().toString()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")):
            source = fs.open(jvm.org.apache.hadoop.fs.Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()


def write_matches(pairs: DataFrame, entities: DataFrame, path: str, strict: bool = True) -> dict[str, int]:
    return write_id_lists(id_lists(pairs, entities), path, MATCHES, entities, strict)


def write_candidates(pairs: DataFrame, entities: DataFrame, path: str, strict: bool = True) -> dict[str, int]:
    return write_id_lists(id_lists(pairs, entities), path, CANDIDATES, entities, strict)


def read_id_lists(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """(s1_id, ids) as stored, repeats and spaces kept."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(F.col("value") != "\t".join(columns))
    parts = F.split("value", "\t", 2)
    return lines.select(parts[0].alias("s1_id"), F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: x != "").alias("ids"))


def subset_violations(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities (s1_id) with a match (s1_id, tgt_id) that is no candidate."""
    return matches.join(candidates, ["s1_id", "tgt_id"], "left_anti").select("s1_id").distinct()


def merge_partials(spark: SparkSession, paths: list[str], columns: list[str], required: DataFrame, out: str) -> dict[str, int]:
    """One result of several partial ones: refuses an entity that comes twice or is missing; extra entities are let through."""
    lists = read_id_lists(spark, paths, columns)
    bad = coverage(lists, required).where("problem <> 'extra'").orderBy("problem", "s1_id").take(5)
    if bad:
        raise SubmissionError(f"{out}: " + ", ".join(f"{r['s1_id']} {r['problem']}" for r in bad))
    return write_id_lists(lists, out, columns, required, strict=False)


def save_scores(scored: DataFrame, path: str) -> DataFrame:
    """Scored pairs as Parquet by country, so that deciding again costs one scan."""
    scored.write.mode("overwrite").partitionBy("country").parquet(path)
    return scored.sparkSession.read.schema(scored.schema).parquet(path)


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))
