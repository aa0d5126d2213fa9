"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.operators import delivery
from lumenq.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.repeated_deliveries(load(spark, sf_dir, "traffic_log"))


def p1_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with each message once, by kind."""
    once = delivery.deliver_once(load(spark, sf_dir, "traffic_log"))
    return once.groupBy("kind").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("id").isNull()).alias("without_id"), F.min("log_pos").alias("first_pos"))


_CHAINS = """
WITH m AS (
  SELECT log_pos, kind, id, ts,
    CASE WHEN outcomes IS NULL THEN NULL
         ELSE list_transform(list_sort(json_keys(outcomes)), lambda k: k || '=' || json_extract(outcomes, '$."' || k || '"')) END AS o
  FROM traffic_log WHERE id IS NOT NULL),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY kind, id, o ORDER BY ts, log_pos) < 0.001 THEN 0 ELSE 1 END AS st FROM m),
c AS (SELECT *, sum(st) OVER (PARTITION BY kind, id, o ORDER BY ts, log_pos ROWS UNBOUNDED PRECEDING) AS ch FROM s),
r AS (SELECT log_pos, kind, min(log_pos) OVER (PARTITION BY kind, id, o, ch) AS keep FROM c)
"""

QUERIES = {"p1_found": p1_found, "p1_delivered": p1_delivered}
SQL = {
    "p1_found": _CHAINS + "SELECT log_pos FROM r WHERE log_pos <> keep",
    "p1_delivered": _CHAINS
    + """SELECT kind, count(*) AS messages, count(*) FILTER (WHERE nameless) AS without_id, min(log_pos) AS first_pos
FROM (SELECT kind, log_pos, false AS nameless FROM r WHERE log_pos = keep
      UNION ALL SELECT kind, log_pos, true FROM traffic_log WHERE id IS NULL) GROUP BY kind""",
}
