"""The decision pipeline: plan, score, combine, debias, pool, sharpen, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.functions import dist, text
from lumenq.operators.retrieval import shortlist
from lumenq.operators.routing import null_priors
from lumenq.plans.model import SeamError, shown_state

#: (prompt prefix, branches as shown) to one list of logits a branch.
Scorer = Callable[[str, list[str], list[list[str]]], list[list[float]]]


@dataclass(frozen=True)
class Calibration:
    """How logits become probabilities. Temperature always comes last."""

    permutations: int = 1
    contextual: bool = False
    temperature: float = 1.0
    confidence: str = "margin"
    basecal: float = 0.0

    def __post_init__(self) -> None:
        if self.permutations < 1 or self.temperature <= 0 or not 0 <= self.basecal <= 1 or self.confidence not in dist.CONFIDENCES:
            raise ValueError(f"not a calibration: {self}")


def plan(questions: DataFrame, permutations: int) -> DataFrame:
    """``orderings``, ``branches`` and ``shown`` (options of each ordering) of every question."""
    placed = questions.withColumn("orderings", dist.rotations(F.size("options"), permutations))
    lines = text.option_lines(F.col("options"), F.col("descriptions"))
    shown = F.transform("orderings", lambda o: text.in_order(F.col("options"), o))
    branches = F.transform("orderings", lambda o: text.letter_branch(F.col("instructions"), text.in_order(lines, o)))
    return placed.withColumn("shown", shown).withColumn("branches", branches)


def score(rows: DataFrame, scorer: Scorer, prefix: str = "prefix") -> DataFrame:
    """``logits`` (one list an ordering) from a pluggable model; a batch's branches go to it state by state."""

    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([[list(map(float, z)) for z in scorer(p, list(b), [list(s) for s in shown])] for p, b, shown in zip(frame["prefix"], frame["branches"], frame["shown"], strict=True)], dtype=object)

    run.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    return rows.withColumn("logits", F.pandas_udf(run, "array<array<double>>")(F.struct(F.col(prefix).alias("prefix"), "branches", "shown")))


def combined(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, dist.combine(F.col("logits"), F.col("orderings"))).drop("logits")


#: (state as shown, option lines, task) to one score an option.
Ranker = Callable[[str, list[str], str], list[float]]


def narrowed(rows: DataFrame, ranker: Ranker, above: int, keep: int) -> DataFrame:
    """Rows whose long choices are cut to their ``keep`` best options; all of them stay in ``full``.

    ``rows`` has ``shown_state`` beside the question's columns. Only long choices are ranked.
    """
    lines = text.option_lines(F.col("options"), F.col("descriptions"))
    # Fixed value: the wording of a ranker's task.
    task = F.concat(F.lit("Find the answer option that best answers: "), "instructions")
    cut = (F.col("type") == "choice") & (F.size("options") > above) & (F.size("options") > keep)

    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([None if s is None else list(map(float, ranker(s, list(o), t))) for s, o, t in zip(frame["s"], frame["o"], frame["t"], strict=True)], dtype=object)

    run.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    # A null state stands for a question that isn't cut.
    scores = F.pandas_udf(run, "array<double>")(F.struct(F.when(cut, F.col("shown_state")).alias("s"), lines.alias("o"), task.alias("t")))
    ranked = rows.withColumn("full", F.col("options")).withColumn("scores__", scores)
    places = F.when(F.col("scores__").isNull(), F.sequence(F.lit(0), F.size("options") - 1)).otherwise(shortlist(F.col("scores__"), keep))
    kept = ranked.withColumn("places__", places)
    pick = lambda c: F.when(F.col(c).isNotNull(), F.transform("places__", lambda i: F.get(F.col(c), i)))
    return kept.withColumns({c: pick(c) for c in ("options", "descriptions", "vals")}).drop("scores__", "places__")


def decide(
    states: DataFrame,
    questions: DataFrame,
    scorer: Scorer,
    calibration: Calibration = Calibration(),
    base_scorer: Scorer | None = None,
    ranker: Ranker | None = None,
    above: int = 12,
    keep: int = 12,
    tokenizer: Callable[[Column], Column] = text.words,
    letters: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``p``, ``choice``, ``score``, ``confidence`` and ``input_tokens`` of every question about every state.

    ``states`` has ``id``, ``family`` and ``state`` (JSON is shown indented, keys in order),
    ``questions`` has ``family``, ``type``, ``instructions``, ``options``, ``descriptions`` and
    ``vals``. With a ``ranker``, choices of more than ``above`` options are cut to the ``keep``
    best before they are scored, and the others get probability 0. All orderings of a question
    stay in one row, so nothing is shuffled after the join. The null prior is scored once a
    question; where options were cut it is scored with the row. A ``base_scorer`` must encode the
    label letters as the scorer does: ``letters`` has both models' (``letter``, ``ids``), and a
    letter that differs is an error.
    """
    if calibration.basecal > 0 and base_scorer is None:
        raise ValueError("a weight for a base scorer needs one")
    if letters is not None and (wrong := text.differing_labels(*letters).limit(1).collect()):
        raise SeamError(f"the two models encode {wrong[0]['letter']!r} differently")
    named = questions.withColumnRenamed("family", "f__")
    models = {"p": scorer, **({"q": base_scorer} if calibration.basecal > 0 else {})}

    def with_priors(frame: DataFrame) -> DataFrame:
        empty = frame.withColumn("null__", text.prefix(F.lit(text.NULL_STATE)))
        for name, model in models.items():
            empty = combined(score(empty, model, "null__"), f"prior_{name}")
        return empty.drop("null__")

    if ranker is None:
        named = plan(named, calibration.permutations)
    if ranker is None and calibration.contextual:
        priors = null_priors(named, with_priors, "f__").select(F.col("f__").alias("g__"), *(f"prior_{m}" for m in models))
        named = named.join(priors, F.col("f__") == F.col("g__")).drop("g__")
    rows = states.withColumn("shown_state", shown_state(F.col("state"))).join(named, F.col("family") == F.col("f__")).drop("f__")
    if ranker is not None:
        rows = plan(narrowed(rows, ranker, above, keep), calibration.permutations)
    rows = rows.withColumn("prefix", text.prefix(F.col("shown_state"))).drop("shown_state")
    size = F.size(tokenizer(F.col("prefix"))) + F.aggregate(F.transform("branches", lambda x: F.size(tokenizer(x))), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("input_tokens", size)
    done = with_priors(rows) if calibration.contextual and ranker is not None else rows
    for name, model in models.items():
        done = combined(score(done, model), name)
        if calibration.contextual:
            done = done.withColumn(name, dist.debias(F.col(name), F.col(f"prior_{name}"))).drop(f"prior_{name}")
    if calibration.basecal > 0:
        done = done.withColumn("p", dist.pool(F.col("p"), F.col("q"), calibration.basecal)).drop("q")
    done = done.withColumn("p", dist.sharpen(F.col("p"), calibration.temperature))
    answered = done.withColumn("choice", F.get("options", dist.argmax(F.col("p")))).withColumn("confidence", dist.confidence(F.col("p"), calibration.confidence))
    answered = answered.withColumn("score", F.when(F.col("type") == "score", dist.dot(F.col("p"), F.col("vals")))).drop("prefix", "branches", "shown", "orderings")
    if ranker is not None:
        answered = answered.withColumn("p", dist.expand(F.col("full"), F.col("options"), F.col("p"))).drop("options").withColumnRenamed("full", "options")
    return answered


def verify(rows: DataFrame, scorer: Scorer, reference: Scorer, tolerance: float) -> DataFrame:
    """``apart``, the largest difference of an option's probability between two scorers, and whether it is within ``tolerance``.

    ``rows`` has ``prefix`` and a question's columns.
    """
    planned = plan(rows, 1)
    both = combined(score(combined(score(planned, scorer), "p__"), reference), "q__")
    apart = F.array_max(F.zip_with("p__", "q__", lambda a, b: F.abs(a - b)))
    return both.withColumn("apart", apart).withColumn("equal", F.col("apart") <= tolerance).drop("p__", "q__", "branches", "shown", "orderings")


def wire_answer(type_: Column, options: Column, vals: Column, p: Column, confidence: str = "margin") -> Column:
    """The typed answer as JSON, in the same shape whether a head or the teacher gave it."""
    as_map = F.map_from_arrays(options, p)
    conf = dist.confidence(p, confidence).alias("confidence")
    choice = F.to_json(F.struct(F.get(options, dist.argmax(p)).alias("choice"), as_map.alias("probabilities"), conf))
    score = F.to_json(F.struct(dist.dot(p, vals).alias("score"), F.map_from_arrays(options, vals).alias("legend"), as_map.alias("probabilities"), conf))
    return F.when(type_ == "choice", choice).when(type_ == "noul", F.to_json(F.struct(p[0].alias("noul")))).when(type_ == "score", score)


def keyword_scorer(prefix: str, branches: list[str], shown: list[list[str]]) -> list[list[float]]:
    """A deterministic double of a model: 3 for every option word that the state holds, by option."""
    held = set(prefix.lower().split())
    return [[3.0 * sum(w in held for w in o.lower().split()) for o in options] for options in shown]


def biased_scorer(bias: list[float]) -> Scorer:
    """A double that sees places only, never the state."""

    def scorer(prefix: str, branches: list[str], shown: list[list[str]]) -> list[list[float]]:
        return [[bias[k] if k < len(bias) else 0.0 for k in range(len(options))] for options in shown]

    return scorer
