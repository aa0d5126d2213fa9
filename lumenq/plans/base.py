"""Frames that the queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.session import load


def clean(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(x, F.lit("_"), F.lit(" ")), r"^\s+|\s+$", ""))


def clean_sql(x: str) -> str:
    return rf"lower(regexp_replace(replace({x}, '_', ' '), '^\s+|\s+$', '', 'g'))"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored predictions: ``id``, ``task``, ``split``, ``config``, ``options``, ``p``, ``y`` (0-based), ``n``."""
    raw = load(spark, sf_dir, "predictions").where(F.size("probabilities") > 0)
    rows = raw.select(
        F.col("pred_id").alias("id"),
        clean(F.col("task")).alias("task"),
        clean(F.col("split")).alias("split"),
        F.lower(F.col("config")).alias("config"),
        F.transform(F.map_keys("probabilities"), clean).alias("options"),
        F.map_values("probabilities").alias("p"),
        clean(F.col("label")).alias("label"),
    )
    placed = rows.withColumn("y", (F.array_position("options", F.col("label")) - 1).cast("int")).withColumn("n", F.size("p"))
    return placed.where(F.col("y") >= 0)


FACTS = rf"""f0 AS (SELECT pred_id AS id, {clean_sql("task")} AS task, {clean_sql("split")} AS split, lower(config) AS config,
  list_transform(map_keys(probabilities), lambda o: {clean_sql("o")}) AS options, map_values(probabilities) AS p, {clean_sql("label")} AS label
  FROM predictions WHERE cardinality(probabilities) > 0),
f AS (SELECT * FROM (SELECT *, CAST(list_position(options, label) - 1 AS INT) AS y, CAST(len(p) AS INT) AS n FROM f0) WHERE y >= 0)"""


def confidences(frame: DataFrame) -> DataFrame:
    """Facts with ``conf`` (largest probability) and ``correct``."""
    from lumenq.functions import dist

    return frame.withColumn("conf", F.array_max("p")).withColumn("correct", (dist.argmax(F.col("p")) == F.col("y")).cast("int"))


CONF = FACTS + """,
c AS (SELECT *, list_max(p) AS conf, CAST(list_position(p, list_max(p)) - 1 = y AS INT) AS correct FROM f)"""


def family_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``family``, ``qname``, ``qtype``, ``instructions``, ``options``, ``descriptions``, ``vals``."""
    return load(spark, sf_dir, "questions").select(
        "family", "qname", "qtype", "instructions", F.col("criteria.opt").alias("options"), F.col("criteria.descr").alias("descriptions"), F.col("criteria.val").alias("vals")
    )


QUESTIONS = """q AS (SELECT family, qname, qtype, instructions, list_transform(criteria, lambda c: c.opt) AS options,
  list_transform(criteria, lambda c: c.descr) AS descriptions, list_transform(criteria, lambda c: c.val) AS vals FROM questions)"""


def long(frame: DataFrame, key: str = "id", value: str = "v") -> DataFrame:
    """One row per element of an array column: ``key``, ``k``, ``v``, rounded."""
    return frame.select(key, F.posexplode(value).alias("k", "x")).select(key, "k", F.round("x", 6).alias("v"))


def long_sql(ctes: str, expr: str, source: str = "f", key: str = "id") -> str:
    return f"WITH {ctes} SELECT {key}, CAST(unnest(range(len(v))) AS INT) AS k, round(unnest(v), 6) AS v FROM (SELECT {key}, {expr} AS v FROM {source})"
