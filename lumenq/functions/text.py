"""Prompt rendering and token-list operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of prompts.
PREFIX = "You are a decision engine. Read the state below, then answer the question that follows with a single letter.\n\n<state>\n"
PREFIX_END = "\n</state>\n"
QUESTION, QUESTION_END = "\n<question>\n", "\n</question>\nAnswer:"
SEQUENCE_LINE = "\nReply with one option, exactly as written.\n"
NULL_STATE = "N/A"


def prefix(state: Column) -> Column:
    """The part that all questions about a state share; no question is named in it."""
    return F.concat(F.lit(PREFIX), state, F.lit(PREFIX_END))


def option_lines(options: Column, descriptions: Column) -> Column:
    return F.zip_with(options, descriptions, lambda o, d: F.when(d.isNull() | (d == ""), o).otherwise(F.concat(o, F.lit(": "), d)))


def in_order(options: Column, ordering: Column) -> Column:
    """Options as shown under an ordering of 0-based original places; anything but a permutation is an error."""
    fits = F.array_sort(ordering) == F.sequence(F.lit(0), F.size(options) - 1)
    bad = F.raise_error(F.lit("an ordering must be a permutation of the options")).cast("array<string>")
    return F.when(fits, F.transform(ordering, lambda i: F.get(options, i))).otherwise(bad)


def letter_branch(instructions: Column, lines: Column) -> Column:
    listed = F.transform(lines, lambda line, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), line))
    return F.concat(F.lit(QUESTION), instructions, F.lit("\n"), F.array_join(listed, "\n"), F.lit(QUESTION_END))


def sequence_branch(instructions: Column, lines: Column) -> Column:
    listed = F.transform(lines, lambda line: F.concat(F.lit("- "), line))
    return F.concat(F.lit(QUESTION), instructions, F.lit(SEQUENCE_LINE), F.array_join(listed, "\n"), F.lit(QUESTION_END))


def labels(options: Column, token_ids: Column | None = None) -> Column:
    """One letter and its token per option; repeated options, more than 26 and clashing tokens are errors."""
    n = F.size(options)
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(65) + i) if token_ids is None else F.slice(token_ids, F.lit(1), n)
    bad = (
        F.when(n < 1, "a choice needs an option")
        .when(F.size(F.array_distinct(options)) < n, "options must differ")
        .when(n > 26, "more options than letters")
        .when(F.size(F.array_distinct(ids)) < n, "two labels share a token")
    )
    made = F.zip_with(options, ids, lambda o, t: F.struct(o.alias("option"), t.cast("int").alias("token_id")))
    made = F.transform(made, lambda s, i: F.struct(s["option"].alias("option"), F.char(F.lit(65) + i).alias("label"), F.concat(F.lit(" "), F.char(F.lit(65) + i)).alias("rendered"), s["token_id"].alias("token_id")))
    error = F.raise_error(bad).cast("array<struct<option:string,label:string,rendered:string,token_id:int>>")
    return F.when(bad.isNotNull(), error).otherwise(made)


def match_length(a: Column, b: Column) -> Column:
    """Length of the common beginning of two lists."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def shared_prefix_length(prefix_ids: Column, whole: Column, tolerance: int = 1) -> Column:
    """How much of the prefix all of the lists share; much less than the prefix is an error."""
    least = F.least(F.size(prefix_ids), F.array_min(F.transform(whole, lambda w: match_length(prefix_ids, w))), F.array_min(F.transform(whole, lambda w: match_length(F.get(whole, F.lit(0)), w))))
    return F.when(least < F.size(prefix_ids) - tolerance, F.raise_error(F.lit("branches leave the shared prefix early")).cast("int")).otherwise(least)


def continuation(context: Column, full: Column) -> Column:
    """What follows the context in a list that begins with it; anything else is an error."""
    rest = F.slice(full, F.size(context) + 1, F.greatest(F.lit(1), F.size(full)))
    fits = (match_length(context, full) == F.size(context)) & (F.size(rest) > 0)
    return F.when(fits, rest).otherwise(F.raise_error(F.lit("a continuation must follow its context")).cast("array<string>"))


def differing_labels(own: DataFrame, other: DataFrame) -> DataFrame:
    """Label tokens (``letter``, ``ids``) that another model encodes differently or not at all; ids are whole lists."""
    there = other.select(F.col("letter").alias("l__"), F.col("ids").alias("i__"))
    return own.join(there, (F.col("letter") == F.col("l__")) & F.col("ids").eqNullSafe(F.col("i__")), "left_anti")


def words(text: Column) -> Column:
    """The test tokenizer: an optional space and a run without space, or one white space."""
    return F.regexp_extract_all(text, F.lit(r"( ?\S+|\s)"), F.lit(1))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cut_text(text: Column, most: int = 1500) -> Column:
    """Stripped and cut to ``most`` characters; null where nothing is left."""
    bare = strip(text)
    return F.when(F.length(bare) > 0, F.substring(bare, 1, most))
