"""python -m kinship train|predict|merge|validate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import DecideConfig, LinkConfig


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="kinship")
    sub = top.add_subparsers(dest="job", required=True)
    p = sub.add_parser("train")
    p.add_argument("--data", required=True)
    p.add_argument("--artifacts", required=True)
    p.add_argument("--sample-entities", type=int, default=30_000)
    p.add_argument("--valid-fraction", type=float, default=0.25)
    p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("predict")
    p.add_argument("--data", required=True)
    p.add_argument("--artifacts", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--split", default="test")
    p.add_argument("--country")
    p.add_argument("--threshold", type=float)
    p.add_argument("--singleton-gate", type=float)
    p.add_argument("--no-exclusivity", action="store_true")
    p.add_argument("--threshold-report", action="store_true")
    p.add_argument("--shard", type=int, default=0)
    p.add_argument("--shards", type=int, default=1)
    p.add_argument("--numbers", action="store_true", help="propose pairs by numbers too")
    p = sub.add_parser("merge")
    p.add_argument("--data", required=True)
    p.add_argument("--split", default="test")
    p.add_argument("--output", required=True)
    p.add_argument("parts", nargs="+")
    p = sub.add_parser("validate")
    p.add_argument("--data", required=True)
    p.add_argument("--split", default="test")
    p.add_argument("--matching", required=True)
    p.add_argument("--candidate")
    p.add_argument("--check-ids", action="store_true")
    return top.parse_args(argv)


def main(argv: list[str]) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName(f"kinship-{a.job}").getOrCreate()
    from .operators import decide
    from .operators.validate import validate
    from .plans import pipeline
    from .sources import sinks, tsv

    if a.job == "train":
        print(pipeline.train(spark, a.data, a.artifacts, sample=a.sample_entities, valid_fraction=a.valid_fraction, seed=a.seed))
    elif a.job == "predict":
        stored = a.threshold if a.threshold is not None else sinks.load_json(spark, f"{a.artifacts}/threshold")["threshold"]
        decision = DecideConfig(stored, a.singleton_gate, not a.no_exclusivity)
        print(pipeline.predict(spark, a.data, a.artifacts, a.output, a.split, a.country, LinkConfig(use_numbers=a.numbers), decision, a.shard, a.shards))
        if a.threshold_report:
            s1 = tsv.scan_source(spark, f"{a.data}/{a.split}_source1.tsv", a.country)
            decide.threshold_report(spark.read.parquet(f"{a.output}/scores"), s1).orderBy("threshold").show(100)
    elif a.job == "merge":
        print(pipeline.merge(spark, a.data, a.parts, a.output, a.split))
    else:
        required = tsv.read_entity_ids(spark, f"{a.data}/{a.split}_source1.tsv")
        known = None
        if a.check_ids:
            known = tsv.read_entity_ids(spark, f"{a.data}/{a.split}_source2.tsv").unionByName(tsv.read_entity_ids(spark, f"{a.data}/{a.split}_source3.tsv"))
        report = validate(spark, a.matching, a.candidate, required, known)
        print(report)
        return 0 if report.ok else 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
