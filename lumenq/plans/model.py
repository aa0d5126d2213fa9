"""The question model: parsing, validation, family identity, declared options."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The wire format's names and limits.
NOUL = ("yes", "no")
MOST_OPTIONS = 255
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUESTION_TYPE = "struct<type:string,instructions:string,options:array<string>,descriptions:array<string>,vals:array<double>,family:string,error:string>"


class LabelError(ValueError):
    """Options can't be labelled."""


class SeamError(ValueError):
    """A continuation doesn't begin where its context ends."""


@dataclass(frozen=True)
class Question:
    """One closed question; the order of ``options`` is part of what it is."""

    type: str
    instructions: str
    options: tuple[str, ...]
    descriptions: dict[str, str] = field(default_factory=dict)
    values: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if len(set(self.options)) != len(self.options):
            raise LabelError("options must differ")
        if not 1 <= len(self.options) <= MOST_OPTIONS:
            raise LabelError(f"a question has 1 to {MOST_OPTIONS} options")

    def wire(self) -> dict:
        """The shape on the wire; criteria in declared order, noul criteria only where given."""
        out: dict = {"type": self.type, "instructions": self.instructions}
        if self.type == "score":
            out["criteria"] = dict(zip(self.options, self.values, strict=True))
        elif self.type == "choice":
            out["criteria"] = {o: self.descriptions.get(o) for o in self.options} if self.descriptions else list(self.options)
        elif self.descriptions:
            out["criteria"] = {("true" if o == "yes" else "false"): t for o, t in self.descriptions.items()}
        return out

    @property
    def family(self) -> str:
        """16 hex digits that name the question's wording and option order."""
        return hashlib.sha256(json.dumps(self.wire()).encode()).hexdigest()[:16]

    def line(self, option: str) -> str:
        text = self.descriptions.get(option)
        return f"{option}: {text}" if text else option


def parse(data: object) -> Question:
    """A question from its wire shape; ValueError with the reason if it isn't one."""
    if not isinstance(data, dict):
        raise ValueError("a question is an object with a type")
    kind, instructions, criteria = data.get("type"), data.get("instructions"), data.get("criteria")
    if not isinstance(instructions, str) or not instructions:
        raise ValueError("instructions are missing")
    if kind == "noul":
        if criteria is not None and (not isinstance(criteria, dict) or not set(criteria) <= {"true", "false"}):
            raise ValueError("noul criteria describe true and false only")
        named = {("yes" if k == "true" else "no"): str(v) for k, v in (criteria or {}).items()}
        return Question(kind, instructions, NOUL, named)
    if kind not in ("choice", "score"):
        raise ValueError(f"unknown question type {kind!r}")
    if not isinstance(criteria, (dict, list) if kind == "choice" else dict) or len(criteria) < 2:
        raise ValueError(f"a {kind} needs two options or more")
    options = tuple(map(str, criteria))
    if kind == "score":
        return Question(kind, instructions, options, values=tuple(float(v) for v in criteria.values()))
    described = {str(k): str(v) for k, v in criteria.items() if v not in (None, "")} if isinstance(criteria, dict) else {}
    return Question(kind, instructions, options, described)


def _row(text: str | None) -> dict | None:
    if text is None:
        return None
    try:
        q = parse(json.loads(text))
    except (ValueError, TypeError) as e:
        return {"type": None, "instructions": None, "options": None, "descriptions": None, "vals": None, "family": None, "error": str(e)}
    return {"type": q.type, "instructions": q.instructions, "options": list(q.options), "descriptions": [q.descriptions.get(o) for o in q.options], "vals": list(q.values) or None, "family": q.family, "error": None}


def parsed(text: Column) -> Column:
    """``QUESTION_TYPE`` of a question's JSON text; ``error`` says why it is none.

    Byte-exact family keys need the JSON writer of the wire format, so this is a vectorised UDF;
    each distinct text is parsed once a worker.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str | None, dict | None] = {}
        for batch in batches:
            rows = []
            for text in batch:
                if text not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[text] = _row(text)
                rows.append(seen[text] or dict.fromkeys(("type", "instructions", "options", "descriptions", "vals", "family", "error")))
            yield pd.DataFrame(rows, columns=["type", "instructions", "options", "descriptions", "vals", "family", "error"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, QUESTION_TYPE)(text)


def state_body(state: str | None) -> str | None:
    """How a state is shown: text as it is, other JSON indented with sorted keys."""
    if state is None:
        return None
    try:
        value = json.loads(state)
    except ValueError:
        return state
    return value if isinstance(value, str) else json.dumps(value, indent=2, sort_keys=True) if isinstance(value, (dict, list)) else state


def shown_state(state: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([state_body(x) for x in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(state)
