"""The append-only log of asks and outcomes, and the examples made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.functions import dist
from lumenq.plans.model import parsed

TEACHER = "teacher"


def _json_map(text: str, kind: str = "string") -> Column:
    return F.from_json(F.col(text), f"map<string,{kind}>")


def latest_asks(log: DataFrame) -> DataFrame:
    """The last ask of each id, by log position. Ids are compared first, on two narrow columns."""
    asks = log.where((F.col("kind") == "ask") & F.col("id").isNotNull())
    last = asks.groupBy("id").agg(F.max("log_pos").alias("last__")).select("last__")
    return asks.join(last, F.col("log_pos") == F.col("last__"), "left_semi")


def latest_outcomes(log: DataFrame) -> DataFrame:
    """(``oid``, ``name``, ``raw``): the last outcome of each question of each id; JSON null is a value here."""
    reports = log.where((F.col("kind") == "outcome") & F.col("id").isNotNull()).select(F.col("id").alias("oid"), "log_pos", F.explode(_json_map("outcomes")).alias("name", "raw"))
    return reports.groupBy("oid", "name").agg(F.max_by("raw", "log_pos").alias("raw"))


def outcome_index(kind: Column, options: Column, raw: Column) -> Column:
    """0-based option of a reported outcome; null if unknown, -1 if it is none of the options."""
    noul = F.when(raw.isin("true", "yes"), 0).when(raw.isin("false", "no"), 1).otherwise(-1)
    other = F.array_position(options, raw) - 1
    return F.when(raw.isNull(), None).when(kind == "noul", noul).otherwise(other).cast("int")


def teacher_distribution(kind: Column, options: Column, answer: Column) -> Column:
    p = F.get_json_object(answer, "$.noul").cast("double")
    probabilities = F.from_json(F.get_json_object(answer, "$.probabilities"), "map<string,double>")
    return F.when(kind == "noul", F.array(p, 1 - p)).otherwise(F.transform(options, lambda o: F.try_element_at(probabilities, o)))


def examples(log: DataFrame, family: str | None = None, invalid: str = "null") -> DataFrame:
    """One row per question of each ask, with what was answered and what happened.

    ``log`` has ``log_pos``, ``kind``, ``id``, ``state``, ``questions``, ``answers``,
    ``served_by``, ``shadow`` and ``outcomes``. The last ask of an id and the last outcome of a
    question count; an outcome of JSON null means unknown. Outcomes of unknown ids or questions
    are left out, and so are rows with a null id and questions that can't be parsed. An outcome
    that is none of the options is null with ``bad_outcome`` (``invalid="null"``) or an error
    (``invalid="error"``).
    """
    # JSON is parsed once an ask, before its questions are unfolded.
    parsed_asks = latest_asks(log).select(F.col("id").alias("request_id"), "log_pos", "state", *(_json_map(c).alias(c) for c in ("questions", "answers", "served_by", "shadow")))
    asks = parsed_asks.select("request_id", "log_pos", "state", "answers", "served_by", "shadow", F.explode("questions").alias("question", "text"))
    named = asks.withColumn("q", parsed(F.col("text"))).where(F.col("q.error").isNull())
    if family is not None:
        named = named.where(F.col("q.family") == family)
    joined = named.join(latest_outcomes(log), (F.col("request_id") == F.col("oid")) & (F.col("question") == F.col("name")), "left")
    index = outcome_index(F.col("q.type"), F.col("q.options"), F.col("raw"))
    if invalid == "error":
        index = F.when(index == -1, F.raise_error(F.concat(F.lit("an outcome is none of the options: "), "raw")).cast("int")).otherwise(index)
    of = lambda column: F.try_element_at(column, F.col("question"))
    return joined.select(
        "request_id",
        F.col("q.family").alias("family"),
        "question",
        F.col("q.type").alias("type"),
        F.col("q.options").alias("options"),
        F.col("q.instructions").alias("instructions"),
        "state",
        "log_pos",
        teacher_distribution(F.col("q.type"), F.col("q.options"), of("answers")).alias("teacher"),
        F.when(index >= 0, index).alias("outcome"),
        F.coalesce(index == -1, F.lit(False)).alias("bad_outcome"),
        F.coalesce(of("served_by"), F.lit(TEACHER)).alias("source"),
        F.from_json(of("shadow"), "head string, version int, probabilities array<double>").alias("shadow"),
    )


def bucket(request_id: Column) -> Column:
    """Stable position of an id in [0, 1)."""
    return F.conv(F.substring(F.sha2(request_id, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def trainable(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("source") == TEACHER) | F.col("outcome").isNotNull())


def split(rows: DataFrame, holdout: float) -> DataFrame:
    """Rows with ``part``: temperature, evaluation or train; rows that belong to none are left out.

    Only teacher-served rows with an outcome are held out, and a request of which one row is
    held out trains with none of its rows.
    """
    u = bucket(F.col("request_id"))
    held = F.col("outcome").isNotNull() & (F.col("source") == TEACHER) & (u < holdout)
    marked = rows.withColumn("held__", F.coalesce(held, F.lit(False)))
    ids = marked.where("held__").select(F.col("request_id").alias("h__")).distinct()
    train = trainable(marked).join(ids, F.col("request_id") == F.col("h__"), "left_anti").withColumn("part", F.lit("train"))
    out = marked.where("held__").withColumn("part", F.when(u < holdout / 2, "temperature").otherwise("evaluation"))
    return out.unionByName(train).drop("held__")


def targets(rows: DataFrame, mix: float) -> DataFrame:
    """Rows with ``target``: the outcome alone where a head answered, else outcome and teacher mixed.

    A head-served row without an outcome is an error (``trainable`` leaves it out).
    """
    hot = dist.one_hot(F.size("teacher"), F.col("outcome"))
    mixed = F.zip_with(hot, "teacher", lambda h, t: mix * h + (1.0 - mix) * t)
    none = F.raise_error(F.lit("a head-served row trains on its outcome only")).cast("array<double>")
    head = F.col("source") != TEACHER
    # Always true, but not to the optimizer: the check must not be moved below filters on the rows.
    here = F.length(F.uuid()) > 0
    return rows.withColumn("target", F.when(head & F.col("outcome").isNull() & here, none).when(head, hot).when(F.col("outcome").isNull(), F.col("teacher")).otherwise(mixed))


def shadow_rows(rows: DataFrame, head: str, version: int) -> DataFrame:
    """Teacher-served rows with an outcome where this version of the head ran in shadow, with what it said."""
    picked = rows.where(F.col("outcome").isNotNull() & (F.col("source") == TEACHER) & (F.col("shadow.head") == head) & (F.col("shadow.version") == version))
    return picked.withColumn("student", F.col("shadow.probabilities"))


def families(rows: DataFrame) -> DataFrame:
    """Per family: asks, known outcomes, and name, type and wording of the question that came first in the log (``first_pos``)."""
    place = F.struct("log_pos", "question")
    first = F.min_by(F.struct("question", "type", "instructions"), place)
    found = rows.groupBy("family").agg(F.count(F.lit(1)).alias("asks"), F.count("outcome").alias("outcomes"), first.alias("first"), F.min("log_pos").alias("first_pos"))
    return found.select("family", "asks", "outcomes", "first.*", "first_pos")


def valid_outcomes(reports: DataFrame, recent: DataFrame) -> DataFrame:
    """Reports (``id``, ``name``, ``raw``) with ``status``: unknown ids are accepted, wrong names and labels aren't.

    ``recent`` has one row per question of the recent asks: ``rid``, ``question``, ``type``, ``options``.
    """
    known = recent.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("question", F.struct("type", "options")))).alias("asked"))
    joined = reports.join(known, F.col("id") == F.col("rid"), "left")
    q = F.try_element_at("asked", F.col("name"))
    bad = F.when(F.col("rid").isNull(), None).when(q.isNull(), "unknown question").when(outcome_index(q["type"], q["options"], F.col("raw")) == -1, "unknown label")
    return joined.withColumn("status", F.coalesce(bad, F.lit("accepted"))).drop("asked", "rid")
