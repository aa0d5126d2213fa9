"""Sinks: the append-only log, distributions by task and configuration, heads and reports."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.plans.model import parse


def ask_lines(asks: DataFrame) -> DataFrame:
    """Asks as log lines; a missing id is made, missing ``served_by`` and ``shadow`` are empty."""
    have = set(asks.columns)
    get = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    filled = asks.withColumns({"id": get("id", F.regexp_replace(F.uuid(), "-", "")), "served_by": get("served_by", F.lit("{}")), "shadow": get("shadow", F.lit("{}"))})
    names = ["id", "ts", "caller", "model", "state", "questions", "answers", "served_by", "shadow"]
    return filled.select(F.to_json(F.struct(F.lit("ask").alias("kind"), *(F.col(c) for c in names if c in filled.columns))).alias("value"))


def outcome_lines(reports: DataFrame) -> DataFrame:
    """Outcome reports (``id``, ``ts``, ``outcomes`` as JSON) as log lines; an empty report is an error."""
    keys = F.json_object_keys("outcomes")
    checked = F.when(keys.isNull() | (F.size(keys) == 0), F.raise_error(F.lit("an outcome report names its outcomes")).cast("string")).otherwise(F.col("outcomes"))
    return reports.select(F.to_json(F.struct(F.lit("outcome").alias("kind"), "id", "ts", checked.alias("outcomes"))).alias("value"))


def append_log(lines: DataFrame, path: str) -> None:
    """One more append: a folder of its own, named so that a later one comes after it."""
    lines.write.mode("append").text(f"{path}/append-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")


def new_ask(state: str, questions: dict, answers: dict, model: str, caller: str | None = None) -> dict:
    for q in questions.values():
        parse(q)
    return {"id": uuid.uuid4().hex, "ts": time.time(), "caller": caller, "model": model, "state": state, "questions": json.dumps(questions), "answers": json.dumps(answers)}


def write_distributions(rows: DataFrame, path: str) -> None:
    """Distributions by task, configuration and model tag; a reader prunes to one of them."""
    rows.write.mode("append").partitionBy("task", "config", "tag").parquet(path)


def save_heads(heads: DataFrame, path: str) -> None:
    """Registry rows: ``family``, ``question`` (JSON), ``version``, ``temperature``, ``weights``, ``bias``, ``promoted``, ``reasons``."""
    heads.write.mode("append").parquet(path)


def load_heads(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows whose family is really the key of their question; any other is an error."""
    from lumenq.plans.model import parsed

    rows = spark.read.parquet(path).withColumn("computed__", parsed(F.col("question"))["family"])
    wrong = F.raise_error(F.concat(F.lit("a head's family doesn't fit its question: "), "family")).cast("string")
    return rows.withColumn("family", F.when(F.col("family").eqNullSafe(F.col("computed__")), F.col("family")).otherwise(wrong)).drop("computed__")


def wire_result(answers: Column, input_tokens: Column) -> Column:
    """The response's JSON: answers and usage (nothing is generated, so no output tokens)."""
    return F.to_json(F.struct(answers.alias("answers"), F.struct(input_tokens.cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens")).alias("usage")))


def markdown(report: DataFrame, digits: int = 3) -> str:
    """A small report (one row a task or configuration) as a markdown table."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(show, r)) + " |" for r in report.collect())])
