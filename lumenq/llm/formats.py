"""Duplicates hidden by formatting: one record for all writings of the same content."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.session import materialise

_OTHER = re.compile(r"[\W_]+")


def _plain(text: str) -> str:
    """Only letters and digits, lower-cased."""
    return _OTHER.sub("", text).lower()


class _Number(str):
    """A number as it is written in the JSON text."""


def _walk(value) -> str:
    """A text that is equal for equal JSON values: keys and strings plain, keys sorted, numbers as written."""
    if isinstance(value, _Number):
        return f"#{value}"
    if isinstance(value, str):
        return f"s{_plain(value)};"
    if isinstance(value, _Pairs):
        return "{" + ",".join(sorted(f"{_plain(k)}:{_walk(v)}" for k, v in value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_walk, value)) + "]"
    return json.dumps(value)


class _Pairs(list):
    """The members of a JSON object, repeated keys included."""


def canonical_state(state: str | None) -> str | None:
    """The canonical text of a state; null for a null or blank one.

    A JSON object (and nothing else) is walked at every depth; any other text, broken JSON
    included, keeps letters and digits only. Text of punctuation alone is the empty record.
    """
    if state is None or not state.strip():
        return None
    if state.lstrip()[:1] == "{":
        try:
            value = json.loads(state, object_pairs_hook=_Pairs, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
            if isinstance(value, _Pairs):
                return "o" + _walk(value)
        except (ValueError, RecursionError):
            pass
    return "t" + _plain(state)


def _mapped(function: Callable[[str], str | None]) -> Callable[[str], Column]:
    """A vectorised UDF from ``function``, made when a session is there."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else function(x) for x in batch], dtype=object)

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "string")


def _raw_key(family: Column, state: Column) -> Column:
    """256 bits that stand for the byte-identical raw row; the family's length keeps the two apart."""
    return F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.length(family).cast("string"), F.lit("-")), F.coalesce(family, F.lit("")), state), 256))


def _groups(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw rows by byte-identical text with their count, records by canonical text)."""
    rows = examples.select(F.col("example_id").alias("id__"), F.col("family").alias("f__"), F.col("state").alias("s__")).where(F.col("s__").isNotNull() & (F.length(F.trim("s__")) > 0))
    raw = rows.groupBy("f__", "s__").agg(F.count(F.lit(1)).alias("n__"), F.min("id__").alias("first__"))
    canonical = raw.select(
        _raw_key(F.col("f__"), F.col("s__")).alias("raw_key"),
        F.lower(F.regexp_replace("f__", r"[^\p{L}\p{N}]+", "")).alias("family_key"),
        _mapped(canonical_state)("s__").alias("text_key"),
        "n__",
        "first__",
    ).where(F.col("text_key").isNotNull())
    # Read twice below: written once, so that nothing is canonicalised a second time. 256 bits stand for the canonical text.
    digest = F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.length("family_key").cast("string"), F.lit("-")), F.coalesce("family_key", F.lit("")), "text_key"), 256))
    canonical = materialise(canonical.withColumn("record_key", digest).drop("text_key"), "formats")
    records = canonical.groupBy("record_key").agg(
        F.first("family_key").alias("family_key"),
        F.min("first__").alias("keep_id"),
        F.sum("n__").alias("copies"),
        F.count(F.lit(1)).alias("writings"),
    )
    return canonical, records


def collapse(examples: DataFrame) -> DataFrame:
    """One row per record: ``keep_id`` (smallest ``example_id``), ``family_key``, ``copies``, ``writings``.

    ``examples`` has ``example_id``, ``family`` and ``state``; other columns are ignored. Two
    rows are the same record if ``family`` and ``state`` are equal once only letters and digits
    are kept, lower-cased; JSON objects are compared member by member (see ``canonical_state``).
    Null families equal each other only; null and blank states are no records. Byte-identical
    rows are folded with their counts first (map-side), so a hot group never meets in one task
    and only distinct writings are canonicalised; their canonical texts are then grouped and
    the counts added.
    """
    _, records = _groups(examples)
    return records.select("keep_id", "family_key", "copies", "writings")


def members(examples: DataFrame) -> DataFrame:
    """(``example_id``, ``keep_id``) for every row of a record with several copies."""
    canonical, records = _groups(examples)
    shared = records.where(F.col("copies") > 1).select(F.col("record_key").alias("rk"), "keep_id")
    mapping = canonical.join(shared, F.col("record_key") == F.col("rk")).select("raw_key", "keep_id")
    rows = examples.where(F.col("state").isNotNull()).select("example_id", _raw_key(F.col("family"), F.col("state")).alias("key__"))
    return rows.join(mapping, F.col("key__") == F.col("raw_key")).select("example_id", "keep_id")
