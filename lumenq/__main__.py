"""Jobs over a log or a prediction table: python -m lumenq families|split|train|shadow|gate|report|rescore --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenq.functions import dist
from lumenq.operators import fit, metrics, stats, traffic
from lumenq.sources import readers, sinks


def _policy(args: argparse.Namespace) -> stats.GatePolicy:
    return stats.GatePolicy(min_eval=args.min_eval, brier_margin=args.brier_margin, max_accuracy_drop=args.max_accuracy_drop, confidence=args.confidence)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="lumenq")
    jobs = top.add_subparsers(dest="job", required=True)
    for name in ("families", "split", "train", "shadow", "gate"):
        job = jobs.add_parser(name)
        job.add_argument("--log", required=True, help="path of the log's JSON lines")
        job.add_argument("--out", help="Parquet table to write; the default is a markdown table on standard output")
    jobs.choices["split"].add_argument("--holdout", type=float, default=0.3)
    jobs.choices["train"].add_argument("--holdout", type=float, default=0.3)
    jobs.choices["train"].add_argument("--mix", type=float, default=0.5, help="weight of the outcome in a target")
    jobs.choices["train"].add_argument("--family", help="rows of this family only")
    gate, d = jobs.choices["gate"], stats.GatePolicy()
    for name in ("shadow", "gate"):
        jobs.choices[name].add_argument("--head", required=True)
        jobs.choices[name].add_argument("--version", type=int, required=True)
    jobs.choices["shadow"].add_argument("--write", required=True, help="Parquet table of the paired rows")
    for flag in ("min_eval", "brier_margin", "max_accuracy_drop", "confidence"):
        gate.add_argument("--" + flag.replace("_", "-"), type=type(getattr(d, flag)), default=getattr(d, flag))
    for name in ("report", "rescore"):
        job = jobs.add_parser(name)
        job.add_argument("--predictions", required=True, help="Parquet table with id, task, options, p, y, n")
        job.add_argument("--out")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName(f"lumenq {args.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.job in ("families", "split", "train", "shadow", "gate"):
        rows = traffic.examples(readers.read_log(spark, args.log))
        if args.job == "families":
            result = traffic.families(rows).orderBy("first_pos")
        elif args.job == "split":
            result = traffic.split(rows, args.holdout).groupBy("family", "part").agg(F.count(F.lit(1)).alias("rows"))
        elif args.job == "train":
            own = rows if args.family is None else rows.where(F.col("family") == args.family)
            parts = traffic.split(own, args.holdout)
            held = parts.where(F.col("part") != "train").withColumn("target", dist.one_hot(F.size("teacher"), F.col("outcome")))
            made = traffic.targets(parts.where(F.col("part") == "train"), args.mix).unionByName(held)
            result = made.select("request_id", "family", "question", "state", "options", "part", "target")
        elif args.job == "shadow":
            found = traffic.shadow_rows(rows, args.head, args.version).select("request_id", "family", "question", "student", "teacher", "outcome")
            found.write.mode("overwrite").parquet(args.write)
            result = spark.read.parquet(args.write).groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
        else:
            shadow = traffic.shadow_rows(rows, args.head, args.version)
            pairs = shadow.select(F.xxhash64("request_id", "question").alias("id"), "family", "student", "teacher", F.col("outcome").alias("y"))
            result = stats.compare(pairs, "family", _policy(args)).withColumn("reasons", F.concat_ws("; ", "reasons"))
    else:
        facts = spark.read.parquet(args.predictions)
        result = metrics.report(facts, ["task"]).drop("bins", "curve") if args.job == "report" else metrics.scores(fit.cross_fit(facts, "task").withColumn("p", F.col("scaled")), ["task"])
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        print(sinks.markdown(result))


if __name__ == "__main__":
    main()
