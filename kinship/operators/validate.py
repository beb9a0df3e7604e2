"""Checks of a submission: an id-list file each for matches and candidates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import CANDIDATES, MATCHES

EXAMPLES = 5


@dataclass
class Report:
    """What was found: errors fail the submission, warnings do not."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors

    def __str__(self) -> str:
        lines = [f"{i}. {e}" for i, e in enumerate(self.errors, 1)] + [f"warning: {w}" for w in self.warnings]
        return "\n".join([*lines, "PASS" if self.ok else "FAIL"])


def findings(lines: DataFrame, required: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(rule, s1_id): what is wrong in the lines (value) of a file without its header. Ids are taken as they stand, spaces and all.

    malformed: no tab; duplicate_row; duplicate_in_list; self_match; bad_prefix; with known (entity_id) unknown_id; with required
    (entity_id) missing_entity and unexpected_entity. Blank lines are let be."""
    rows = lines.where(F.trim("value") != "")
    good = rows.where(F.col("value").contains("\t"))
    parts = F.split("value", "\t", 2)
    lists = good.select(parts[0].alias("s1_id"), F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: x != "").alias("ids"))
    mine = lambda x: x.startswith("S1-")
    of = lambda df, rule: df.select(F.lit(rule).alias("rule"), "s1_id")
    out = of(rows.where(~F.col("value").contains("\t")).select(F.trim("value").alias("s1_id")), "malformed")
    out = out.unionByName(of(lists.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_row"))
    out = out.unionByName(of(lists.where(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicate_in_list"))
    out = out.unionByName(of(lists.where(F.exists("ids", mine)), "self_match"))
    out = out.unionByName(of(lists.where(F.exists("ids", lambda x: ~mine(x) & ~x.rlike("^S[23]-"))), "bad_prefix"))
    if known is not None:
        ids = lists.select("s1_id", F.explode("ids").alias("entity_id")).where(F.col("entity_id").rlike("^S[23]-"))
        out = out.unionByName(of(ids.join(known, "entity_id", "left_anti").select("s1_id").distinct(), "unknown_id"))
    if required is not None:
        need = required.select(F.col("entity_id").alias("s1_id")).distinct()
        out = out.unionByName(of(need.join(lists, "s1_id", "left_anti"), "missing_entity"))
        out = out.unionByName(of(lists.select("s1_id").distinct().join(need, "s1_id", "left_anti"), "unexpected_entity"))
    return out


def read_lines(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame | None, str | None]:
    """The lines of a file, or folder of parts, after its header, or what is fatally wrong with it. Parts are read in any order."""
    lines = F.lower("value") == "\t".join(columns)
    try:
        found = spark.read.text(path).agg(F.count("*").alias("n"), F.count_if(lines).alias("heads")).first()
    except Exception as e:  # noqa: BLE001 - the file system's own error for a path that is not there
        if "PATH_NOT_FOUND" in str(e):
            return None, f"{path}: no such file"
        raise
    if not found["n"]:
        return None, f"{path}: empty"
    if not found["heads"]:
        first = spark.read.text(path).first()[0]
        return None, f"{path}: header has commas, not tabs" if first.lower().split(",") == columns else f"{path}: header {first[:80]!r}, expected {columns}"
    return spark.read.text(path).where(~lines), None


def validate(spark: SparkSession, matches: str, candidates: str | None, required: DataFrame, known: DataFrame | None = None) -> Report:
    """The report on a submission's two files; matches that are no candidates are only warned of."""
    report, pairs = Report(), []
    for path, columns in ((matches, MATCHES), (candidates, CANDIDATES)):
        if path is None:
            continue
        lines, fatal = read_lines(spark, path, columns)
        if fatal:
            report.errors.append(fatal)
            continue
        found = findings(lines, required, known)
        for r in found.groupBy("rule").agg(F.count("*").alias("n")).orderBy("rule").collect():  # a row a rule
            ids = [x[0] for x in found.where(F.col("rule") == r["rule"]).select("s1_id").distinct().orderBy("s1_id").take(EXAMPLES)]
            report.errors.append(f"{path}: {r['rule']} in {r['n']} rows, as {', '.join(ids)}")
        parts = F.split("value", "\t", 2)
        pairs.append(lines.where(F.col("value").contains("\t")).select(parts[0].alias("s1_id"), F.explode(F.split(F.get(parts, F.lit(1)), ",")).alias("tgt_id")).where("tgt_id <> ''"))
    if len(pairs) == 2:
        out = pairs[0].join(pairs[1], ["s1_id", "tgt_id"], "left_anti").select("s1_id").distinct()
        if n := out.count():
            report.warnings.append(f"{n} entities have matches that are no candidates, as {', '.join(r[0] for r in out.orderBy('s1_id').take(EXAMPLES))}")
    return report
