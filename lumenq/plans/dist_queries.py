"""Queries of the per-row distribution algebra (DST)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.functions import dist
from lumenq.plans.base import FACTS, facts, long, long_sql


#: A second distribution, logits and an ordering of each row, computed alike in both engines.
_GIVEN = FACTS + """,
g AS (SELECT *, list_reverse(p) AS q, list_transform(p, lambda x: 2 * ln(greatest(x, 1e-6))) AS z, range(0, n) AS idx,
  list_transform(range(0, n), lambda i: (i + 1) % n) AS o FROM f)"""


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        facts(spark, sf_dir)
        .withColumn("q", F.reverse("p"))
        .withColumn("z", F.transform("p", lambda x: 2 * F.ln(F.greatest(x, F.lit(1e-6)))))
        .withColumn("o", F.get(dist.rotations(F.col("n"), 2), F.lit(1)))
    )


def _norm(e: str) -> str:
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


def _soft(z: str, t: float = 1.0) -> str:
    return _norm(f"list_transform({z}, lambda w: exp((w - list_max({z})) / {t}))")


def _zip(a: str, b: str, body: str) -> str:
    """``body`` over s[1], s[2]."""
    return f"list_transform(list_zip({a}, {b}), lambda s: {body})"


_FLOORED = _norm("list_transform(p, lambda w: greatest(w, 1e-6))")
_CUM = "list_transform(range(1, n + 1), lambda k: list_sum(p[1:k]))"

#: name: (array expression, the same in SQL over ``g``)
ARRAYS: dict[str, tuple[Callable[[], Column], str]] = {
    "DST1_softmax": (lambda: dist.softmax(F.col("z"), 0.7), _soft("z", 0.7)),
    "DST2_rotations": (lambda: F.flatten(dist.rotations(F.col("n"), 3)).cast("array<double>"), "flatten(list_transform(range(0, 3), lambda r: list_transform(range(0, n), lambda i: ((i + r) % n)::DOUBLE)))"),
    "DST3_unpermute": (lambda: dist.unpermute(F.col("p"), F.col("o")), "list_transform(range(0, n), lambda j: p[list_position(o, j)])"),
    "DST4_average": (lambda: dist.average(F.array("p", "q", "p")), _norm(_zip("p", "q", "(2 * s[1] + s[2])"))),
    "DST5_combine": (
        lambda: dist.combine(F.array(F.col("z"), dist.permute(F.transform("z", lambda x: x / 2), F.col("o"))), F.array(F.sequence(F.lit(0), F.col("n") - 1), F.col("o"))),
        _zip(_soft("z"), _soft("list_transform(z, lambda h: h / 2)"), "(s[1] + s[2]) / 2"),
    ),
    "DST6_debias": (lambda: dist.debias(F.col("p"), F.col("q")), _norm(_zip("p", "q", "s[1] / greatest(s[2], 1e-12)"))),
    "DST7_pool": (lambda: dist.pool(F.col("p"), F.col("q"), 0.3), _soft(_zip("p", "q", "0.7 * ln(greatest(s[1], 1e-12)) + 0.3 * ln(greatest(s[2], 1e-12))"))),
    "DST8_floored": (lambda: dist.floored(F.col("p"), 0.05), _norm("list_transform(p, lambda w: greatest(w, 0.05))")),
    "DST9_sharpen": (lambda: dist.sharpen(F.col("p"), 1.7), _norm(f"list_transform({_FLOORED}, lambda h: pow(h, 1 / 1.7))")),
    "DST10_scale": (lambda: dist.scale(F.col("p"), 1.3), _soft("list_transform(p, lambda h: ln(least(greatest(h, 1e-6), 1.0)))", 1.3)),
    "DST15_expand": (lambda: dist.expand(F.col("options"), F.slice("options", 1, 3), F.slice("p", 1, 3)), "list_transform(range(1, n + 1), lambda i: CASE WHEN i <= 3 THEN p[i] ELSE 0.0 END)"),
    "DST19_log_softmax": (
        lambda: dist.log_softmax(F.col("z"), F.array(F.lit(0), F.lit(2), F.lit(-1), F.lit(3))),
        "list_transform([z[1], z[3], z[4]], lambda x: x - ln(exp(z[1]) + exp(z[3]) + exp(z[4])))",
    ),
    "GEN4_sord": (lambda: dist.sord(F.col("y"), F.col("n"), 1.5), _norm("list_transform(range(0, n), lambda i: exp(-1.5 * abs(i - y)))")),
    "GEN6_null_target": (lambda: dist.null_distribution(F.col("n")), "list_transform(p, lambda x: 1.0 / n)"),
    "GEN11_soft_target": (lambda: F.zip_with(dist.one_hot(F.col("n"), F.col("y")), "p", lambda a, b: 0.37 * a + 0.63 * b), "list_transform(range(1, n + 1), lambda i: 0.63 * p[i] + CASE WHEN i - 1 = y THEN 0.37 ELSE 0 END)"),
}

_SORTED = "list_reverse_sort(p)"
#: name: (columns, the same in SQL over ``g``)
SCALARS: dict[str, tuple[Callable[[], dict[str, Column]], dict[str, str]]] = {
    "DST11_confidence": (
        lambda: {kind: dist.confidence(F.col("p"), kind) for kind in dist.CONFIDENCES},
        {"margin": f"{_SORTED}[1] - {_SORTED}[2]", "max_prob": "list_max(p)", "entropy": "1 + list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(n)", "normalized_max": "greatest(0, (n * list_max(p) - 1) / (n - 1))"},
    ),
    "DST12_choice_answer": (
        lambda: {"choice": dist.choice_answer(F.col("options"), F.col("p"))["choice"], "confidence": dist.choice_answer(F.col("options"), F.col("p"))["confidence"]},
        {"choice": "options[list_position(p, list_max(p))]", "confidence": f"{_SORTED}[1] - {_SORTED}[2]"},
    ),
    "DST13_noul_answer": (lambda: {"noul": dist.noul_answer(F.col("p"))}, {"noul": "p[1]"}),
    "DST14_score_answer": (
        lambda: {"score": dist.expectation(F.col("p"), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i.cast("double")))},
        {"score": "list_sum(list_transform(range(1, n + 1), lambda i: i * p[i]))"},
    ),
    "DST17_entropy": (lambda: {"h": dist.entropy(F.col("p"))}, {"h": "-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))"}),
    "DST18_log_score": (lambda: {"ce": dist.cross_entropy(F.col("q"), F.col("p"))}, {"ce": "-list_sum(" + _zip("q", "p", "s[1] * ln(greatest(s[2], 1e-12))") + ")"}),
    "DST20_rps": (lambda: {"rps": dist.rps(F.col("p"), F.col("y"))}, {"rps": "list_sum(list_transform(range(1, n + 1), lambda k: pow(list_sum(p[1:k]) - CASE WHEN k - 1 >= y THEN 1 ELSE 0 END, 2))) / (n - 1)"}),
    "DST21_unimodal": (
        lambda: {"hinge": dist.unimodal_hinge(F.col("p"), dist.one_hot(F.col("n"), F.col("y")))},
        {"hinge": "list_sum(list_transform(range(1, n), lambda i: greatest(0, CASE WHEN i - 1 < y THEN p[i] - p[i + 1] ELSE p[i + 1] - p[i] END)))"},
    ),
    "TOP2_margin": (lambda: {"margin": dist.confidence(F.col("p"), "margin")}, {"margin": f"{_SORTED}[1] - {_SORTED}[2]"}),
}


def _array(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: long(_given(spark, sf_dir).select("id", ARRAYS[name][0]().alias("v")))


def _scalar(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _given(spark, sf_dir).select("id", *(c.alias(k) for k, c in SCALARS[name][0]().items()))
        return rows.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))

    return run


def _scalar_sql(name: str) -> str:
    parts = ", ".join(f"{e} AS {k}" if k == "choice" else f"round({e}, 6) AS {k}" for k, e in SCALARS[name][1].items())
    return f"WITH {_GIVEN} SELECT id, {parts} FROM g"


QUERIES = {name: _array(name) for name in ARRAYS} | {name: _scalar(name) for name in SCALARS}
SQL = {name: long_sql(_GIVEN, sql, "g") for name, (_, sql) in ARRAYS.items()} | {name: _scalar_sql(name) for name in SCALARS}


def dst16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DST16: mean and sum of token log-probabilities per option (tokens: the words of its name)."""
    rows = facts(spark, sf_dir).select("id", F.explode(F.arrays_zip("options", "p")).alias("e")).select("id", F.col("e.options").alias("option"), F.explode(F.split("e.options", " ")).alias("token"), F.ln(F.greatest("e.p", F.lit(1e-6))).alias("lp"))
    scored = rows.groupBy("id", "option").agg(F.avg(F.col("lp") / F.length("token")).alias("m"), F.sum(F.col("lp") / F.length("token")).alias("s"))
    return scored.select("id", "option", F.round("m", 6).alias("mean_logprob"), F.round("s", 6).alias("sum_logprob"))


QUERIES["DST16_continuation_score"] = dst16
SQL["DST16_continuation_score"] = f"""WITH {FACTS}, e AS (SELECT id, unnest(options) AS option, ln(greatest(unnest(p), 1e-6)) AS lp FROM f),
t AS (SELECT id, option, lp, unnest(string_split(option, ' ')) AS token FROM e)
SELECT id, option, round(avg(lp / length(token)), 6) AS mean_logprob, round(sum(lp / length(token)), 6) AS sum_logprob FROM t GROUP BY id, option"""
