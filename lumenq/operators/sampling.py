"""Deterministic sampling and splits, and the label mappings of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.operators.ranks import hash_unit, spread_row_number


def first_per_class(rows: DataFrame, label: str, per_class: int | Column, order: list[Column]) -> DataFrame:
    """The first rows of each label. The window's limit is applied before its shuffle, so a hot label stays small."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_class)


def balanced(rows: DataFrame, label: str, per_class: int, key: str, seed: int = 0, labels: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``per_class`` rows of each label in hash order, or as many as there are.

    ``labels`` limits the classes; ``strict`` makes a short class an error.
    """
    held = rows if labels is None else rows.where(F.col(label).isin(labels))
    drawn = first_per_class(held.withColumn("u__", hash_unit(seed, key)), label, per_class, [F.col("u__"), F.col(key)]).drop("u__")
    if not strict:
        return drawn
    have = {r[label]: r["n"] for r in held.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    short = {name: have.get(name, 0) for name in (labels or have) if have.get(name, 0) < per_class}
    if short:
        raise ValueError(f"not enough rows for every class: {short}")
    return drawn


def alternate(rows: DataFrame, label: str, position: str, step: int = 100_000) -> DataFrame:
    """``half``: the rows of each label in turn, train first, by an integer position."""
    ranked = spread_row_number(rows, [label], F.floor(F.col(position) / step), [F.col(position)], "rn__")
    return ranked.withColumn("half", F.when(F.col("rn__") % 2 == 1, "train").otherwise("test")).drop("rn__")


def first_rows(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """The first row of each key by position: positions are compared first, wide columns are not shuffled for it."""
    first = rows.groupBy(*key).agg(F.min(position).alias("first__")).select("first__")
    return rows.join(first, F.col(position) == F.col("first__"), "left_semi")


def not_used(pool: DataFrame, used: DataFrame, column: str) -> DataFrame:
    """Rows of the pool whose ``column`` isn't among the used ones."""
    return pool.join(used.select(F.col(column).alias("used__")).distinct(), F.col(column) == F.col("used__"), "left_anti")


def level(value: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that the value is below, else ``rest``; null for null."""
    out = F.when(value.isNull(), None)
    for bound, name in cuts:
        out = out.when(value < bound, name)
    return out.otherwise(rest)


def toxicity_level(value: Column) -> Column:
    return level(value, [(0.1, "not toxic"), (0.4, "somewhat toxic"), (0.7, "toxic")], "very toxic")


def hate_level(score: Column) -> Column:
    return F.when(score > 0.5, "hateful").when(score < -1, "not hateful").when(score.isNotNull(), "somewhat hateful")


def decile(value: Column) -> Column:
    return F.concat(F.lit("decile "), F.least((value * 10).cast("int"), F.lit(9)).cast("string"))


def member(value: Column, options: list[str]) -> Column:
    """The value if it is one of the options, else null; ``_`` is shown as a space."""
    return F.when(value.isin(options), F.lower(F.replace(value, F.lit("_"), F.lit(" "))))


def relabel(label: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), label)


def single_label(labels: Column, neutral: Column) -> Column:
    """Yes or no from a row with exactly one label; null for any other row."""
    return F.when(F.size(labels) == 1, F.when(labels[0] == neutral, "no").otherwise("yes"))


def incident(language: Column, kind: Column) -> Column:
    return F.when((language == "en") & kind.isNotNull(), F.when(kind == "Incident", "yes").otherwise("no"))
