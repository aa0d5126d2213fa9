"""Queries of metrics, fits and gates (AGG, FIT), with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.functions import dist
from lumenq.operators import fit, metrics, routing, stats
from lumenq.operators.ranks import hash_unit_sql
from lumenq.plans.base import CONF, FACTS, confidences, facts
from lumenq.session import load, materialise

BY = ["task"]


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in frame.dtypes))


def _scores(*names: str):
    return lambda spark, sf: rounded(metrics.scores(facts(spark, sf), BY).select("task", "n", *names))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of which a shadow head's distribution was logged: ``id``, ``family``, ``version``, ``student``, ``teacher``, ``y``."""
    shadow = F.from_json("shadow", "head string, version int, probabilities array<double>")
    rows = load(spark, sf_dir, "examples").where(F.col("shadow").isNotNull()).select(F.col("example_id").alias("id"), F.lower(F.regexp_replace("family", r"^\s+|\s+$", "")).alias("family"), shadow.alias("s"), "teacher", F.col("outcome").alias("y"))
    return rows.where(F.size("s.probabilities") == F.size("teacher")).select("id", "family", F.col("s.version").alias("version"), F.col("s.probabilities").alias("student"), "teacher", "y")


PAIRS = r"""pr AS (SELECT * FROM (SELECT example_id AS id, lower(regexp_replace(family, '^\s+|\s+$', '', 'g')) AS family,
  CAST(json_extract(shadow, '$.version') AS INT) AS version, CAST(json_extract(shadow, '$.probabilities') AS DOUBLE[]) AS student, teacher, outcome AS y
  FROM examples WHERE shadow IS NOT NULL) WHERE len(student) = len(teacher))"""


def agg5(spark, sf):
    return rounded(metrics.reliability(confidences(facts(spark, sf)), BY))


def agg6(spark, sf):
    return rounded(metrics.ece(confidences(facts(spark, sf)), BY))


def agg7(spark, sf):
    return rounded(metrics.ece_equal_mass(confidences(facts(spark, sf)), BY))


def agg8(spark, sf):
    return rounded(metrics.selective(confidences(facts(spark, sf)), BY))


def agg9(spark, sf):
    wide = metrics.report(facts(spark, sf), BY, temperature=1.5)
    return rounded(wide.select("task", "count", "accuracy", "ece", "brier", "temperature", F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + b["count"]).alias("binned"), F.get("curve", F.lit(5))["coverage"].alias("coverage_at_half"), F.get("curve", F.lit(5))["accuracy"].alias("accuracy_at_half")))


def agg10(spark, sf):
    return rounded(metrics.score_mae(facts(spark, sf), BY))


def agg11(spark, sf):
    return rounded(metrics.accuracy_at_coverage(facts(spark, sf), BY, 0.6))


def agg13(spark, sf):
    return rounded(metrics.predicted_classes(facts(spark, sf), BY, 3))


def agg14(spark, sf):
    events = load(spark, sf, "events").where(F.col("value").isNotNull())
    return rounded(metrics.nearest_rank(events, ["event_type"], "value", "event_id", [0.5, 0.95, 0.99], F.floor("value")))


def agg17(spark, sf):
    return metrics.disagreements(pairs(spark, sf).where(F.col("y").isNotNull()), ["family"])


def agg18(spark, sf):
    """How many families get each verdict."""
    rows = stats.differences(pairs(spark, sf).where(F.col("y").isNotNull()))
    got = stats.intervals(rows, "family", method="interpolated")
    return got.select(stats.verdict(F.col("brier_lo"), F.col("brier_hi"), F.col("acc_lo"), F.col("acc_hi")).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("families"))


def agg21(spark, sf):
    return load(spark, sf, "questions").groupBy("qtype").agg(F.count(F.lit(1)).alias("questions"))


def agg23(spark, sf):
    per = metrics.scores(facts(spark, sf), ["task", "config"])
    return rounded(per.groupBy("task").agg(F.count(F.lit(1)).alias("configs"), F.avg("accuracy").alias("mean_accuracy"), F.stddev("accuracy").alias("sd_accuracy"), F.avg("brier").alias("mean_brier"), F.stddev("brier").alias("sd_brier")))


def fit1(spark, sf):
    return rounded(fit.fit_temperature(fit.logits(facts(spark, sf), True), "task", (0.001, 20.0)), 4)


def fit2(spark, sf):
    return rounded(fit.diagnose(facts(spark, sf), "task"), 4)


def fit3(spark, sf):
    return rounded(fit.fit_temperature(fit.logits(facts(spark, sf), True, 0.005), "task", (0.05, 20.0)), 4)


def fit4(spark, sf):
    return rounded(fit.fit_temperature(fit.logits(facts(spark, sf), False), "task", (0.05, 20.0)), 4)


def fit5(spark, sf):
    return fit.folds(facts(spark, sf), "task").select("id", F.col("fold").cast("long").alias("fold"))


def fit6(spark, sf):
    return rounded(fit.cross_fit(facts(spark, sf), "task").groupBy("task", "fold").agg(F.count(F.lit(1)).alias("n"), F.max("temperature").alias("temperature")), 4)


def fit7(spark, sf):
    return rounded(fit.temperature_interval(facts(spark, sf), "task"), 4)


def fit8(spark, sf):
    return rounded(fit.calibration_line(confidences(facts(spark, sf)), "task"), 4)


def fit9(spark, sf):
    rows = stats.differences(pairs(spark, sf).where(F.col("y").isNotNull()))
    return rounded(stats.intervals(rows, "family"))


def fit10(spark, sf):
    rows = stats.differences(pairs(spark, sf).where(F.col("y").isNotNull()))
    return rounded(stats.intervals(rows, "family", method="interpolated"))


def fit11(spark, sf):
    rows = stats.differences(pairs(spark, sf).where(F.col("y").isNotNull()))
    return rounded(stats.pooled(rows, "version", "family"))


def fit12(spark, sf):
    return rounded(fit.ece_floor(confidences(facts(spark, sf)), BY))


def fit13(spark, sf):
    got = stats.compare(pairs(spark, sf), "family")
    return rounded(got.withColumn("reasons", F.concat_ws("; ", "reasons")))


def fit14(spark, sf):
    """The three-way rule over intervals that are given (four cases a task)."""
    d = stats.GatePolicy()
    rows = metrics.scores(facts(spark, sf), BY).select("task", (F.col("brier") / 20 - 0.01).alias("bl"), (F.col("brier") / 20).alias("bh"), (F.col("accuracy") / 10 - 0.07).alias("al"), (F.col("accuracy") / 10 - 0.03).alias("ah"))
    return rows.select("task", stats.verdict(F.col("bl"), F.col("bh"), F.col("al"), F.col("ah"), d).alias("verdict"))


def fit15(spark, sf):
    """Every logged head version judged on what it said in shadow, with its temperature; the newest promoted one of a family serves."""
    key = F.concat_ws("@", "family", F.col("version").cast("string"))
    every = pairs(spark, sf).withColumn("head", key)
    judged = stats.compare(every, "head")
    known = every.where(F.col("y").isNotNull()).select(F.col("head").alias("task"), F.col("student").alias("p"), "y")
    fitted = fit.head_temperature(fit.diagnose(known, "task")).select(F.col("task").alias("t__"), "temperature")
    named = every.groupBy("head").agg(F.first("family").alias("family"), F.first("version").alias("version")).withColumnRenamed("head", "h__")
    heads = judged.join(named, F.col("head") == F.col("h__")).join(fitted, F.col("head") == F.col("t__"), "left")
    heads = heads.select("family", "version", "promoted", "reasons", "n_eval", F.lit("shadow log").alias("source"), F.coalesce("temperature", F.lit(1.0)).alias("temperature"))
    heads = materialise(heads, "heads")
    serving = routing.one_head_per_family(routing.registry(heads)).select(F.col("family").alias("f__"), F.col("version").alias("v__"))
    marked = heads.join(serving, (F.col("family") == F.col("f__")) & (F.col("version") == F.col("v__")), "left")
    return rounded(marked.select("family", "version", "promoted", F.concat_ws("; ", "reasons").alias("reasons"), "n_eval", "source", "temperature", F.col("v__").isNotNull().alias("serves")), 4)


def fit16(spark, sf):
    """Temperature of the logged shadow heads, from outcomes only; 1 where it can't be trusted."""
    rows = pairs(spark, sf).where(F.col("y").isNotNull()).select(F.col("family").alias("task"), F.col("student").alias("p"), "y")
    return rounded(fit.head_temperature(fit.diagnose(rows, "task")).select("task", "temperature", "trustworthy"), 4)


def fit20(spark, sf):
    """Fit on train, apply to the other splits, report."""
    every = facts(spark, sf)
    fitted = fit.head_temperature(fit.diagnose(every.where(F.col("split") == "train"), "task", floor=0.005)).select(F.col("task").alias("t__"), "temperature")
    held = every.where(F.col("split") != "train").join(fitted, F.col("task") == F.col("t__")).withColumn("p", dist.sharpen(F.col("p"), F.col("temperature"), 0.005))
    return rounded(metrics.scores(held, BY).select("task", "n", "accuracy", "brier", "nll"), 4)


QUERIES = {
    "AGG1_accuracy": _scores("accuracy"),
    "AGG2_nll": _scores("nll"),
    "AGG3_brier": _scores("brier"),
    "AGG4_rps": _scores("rps"),
    "AGG5_reliability": agg5,
    "AGG6_ece": agg6,
    "AGG7_ece_equal_mass": agg7,
    "AGG8_selective": agg8,
    "AGG9_report": agg9,
    "AGG10_score_mae": agg10,
    "AGG11_accuracy_at_coverage": agg11,
    "AGG13_predicted_classes": agg13,
    "AGG14_percentiles": agg14,
    "AGG17_disagreements": agg17,
    "AGG18_verdict_counts": agg18,
    "AGG21_shape_counts": agg21,
    "AGG23_mean_sd": agg23,
    "FIT1_temperature": fit1,
    "FIT2_diagnose": fit2,
    "FIT3_fit_predictions": fit3,
    "FIT4_fit_clipped": fit4,
    "FIT5_folds": fit5,
    "FIT6_cross_fit": fit6,
    "FIT7_temperature_interval": fit7,
    "FIT8_calibration_line": fit8,
    "FIT9_paired_interval": fit9,
    "FIT10_paired_ci": fit10,
    "FIT11_pooled_ci": fit11,
    "FIT12_ece_floor": fit12,
    "FIT13_compare": fit13,
    "FIT14_verdict": fit14,
    "FIT15_promote": fit15,
    "FIT16_head_temperature": fit16,
    "FIT20_evaluate": fit20,
}

_P, _RPS = "list_sum(list_transform(range(1, n + 1), lambda k: pow(p[k] - CASE WHEN k - 1 = y THEN 1 ELSE 0 END, 2)))", "list_sum(list_transform(range(1, n + 1), lambda k: pow(list_sum(p[1:k]) - CASE WHEN k - 1 >= y THEN 1 ELSE 0 END, 2))) / (n - 1)"
_NLL = "-ln(least(greatest(p[y + 1], 1e-6), 1.0))"


def _agg(expr: str, name: str) -> str:
    return f"WITH {CONF} SELECT task, count(*) AS n, round(avg({expr}), 6) AS {name} FROM c GROUP BY task"


_BINS = "least(floor(conf / (1.0::DOUBLE / 10)), 9)::BIGINT"
_SHARP = "sh AS (SELECT * REPLACE (list_transform(fl, lambda x: x / list_sum(fl)) AS p) FROM (SELECT *, list_transform(list_transform(p, lambda w: greatest(w, 1e-6) / list_sum(list_transform(p, lambda u: greatest(u, 1e-6)))), lambda x: pow(x, 1 / {t})) AS fl FROM {source}))"
_GOLDEN = """, r AS (SELECT {family} AS task, {z} AS z, y FROM {source} WHERE y IS NOT NULL),
it(i, task, a, b) AS (SELECT DISTINCT 0, task, ln({lo}::DOUBLE), ln({hi}::DOUBLE) FROM r
  UNION ALL
  SELECT i + 1, task, CASE WHEN fc < fd THEN a ELSE c END, CASE WHEN fc < fd THEN d ELSE b END FROM (
    SELECT i, task, a, b, c, d, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / exp(c))))) + (list_max(z) - z[y + 1]) / exp(c)) AS fc,
           avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / exp(d))))) + (list_max(z) - z[y + 1]) / exp(d)) AS fd
    FROM (SELECT *, b - 0.6180339887498949 * (b - a) AS c, a + 0.6180339887498949 * (b - a) AS d FROM it) JOIN r USING (task) WHERE b - a > 1e-7 GROUP BY ALL)),
fitted AS (SELECT task, exp((arg_max(a, i) + arg_max(b, i)) / 2) AS t FROM it GROUP BY task)"""


def _floor_log(floor: str) -> str:
    return f"list_transform(list_transform(p, lambda w: greatest(w, {floor}) / list_sum(list_transform(p, lambda u: greatest(u, {floor})))), lambda x: ln(x))"


_CLIP_LOG = "list_transform(p, lambda w: ln(least(greatest(w, 1e-6), 1.0)))"


def _golden(z: str, lo: str, hi: str, source: str = "f", family: str = "task", ctes: str = FACTS) -> str:
    return "WITH RECURSIVE " + ctes + _GOLDEN.format(z=z, lo=lo, hi=hi, source=source, family=family)


_FIT1 = _golden(_floor_log("1e-6"), "0.001", "20")
_S, _T = "student", "teacher"
_BR = "list_sum(list_transform(range(1, len({d}) + 1), lambda k: pow({d}[k] - CASE WHEN k - 1 = y THEN 1 ELSE 0 END, 2)))"
_RIGHT = "CAST(list_position({d}, list_max({d})) - 1 = y AS INT)"
_MASS = f""", m AS (SELECT *, ntile(10) OVER (PARTITION BY task ORDER BY conf, id) AS chunk FROM c)"""

SQL = {
    "AGG1_accuracy": _agg("correct", "accuracy"),
    "AGG2_nll": _agg(_NLL, "nll"),
    "AGG3_brier": _agg(_P, "brier"),
    "AGG4_rps": _agg(_RPS, "rps"),
    "AGG5_reliability": f"""WITH {CONF}, b AS (SELECT task, {_BINS} AS bin, count(*) AS cnt, avg(conf) AS cf, avg(correct) AS ac FROM c GROUP BY ALL),
grid AS (SELECT task, unnest(range(0, 10)) AS bin FROM (SELECT DISTINCT task FROM b))
SELECT task, bin, round(bin / 10, 6) AS lo, round((bin + 1) / 10, 6) AS hi, coalesce(cnt, 0) AS count, round(coalesce(cf, 0), 6) AS confidence, round(coalesce(ac, 0), 6) AS accuracy FROM grid LEFT JOIN b USING (task, bin)""",
    "AGG6_ece": f"WITH {CONF} SELECT task, round(sum(g) / sum(n), 6) AS ece FROM (SELECT task, abs(sum(correct) - sum(conf)) AS g, count(*) AS n FROM c GROUP BY task, {_BINS}) GROUP BY task",
    "AGG7_ece_equal_mass": f"WITH {CONF}{_MASS} SELECT task, round(sum(g) / sum(n), 6) AS ece_mass FROM (SELECT task, abs(sum(correct) - sum(conf)) AS g, count(*) AS n FROM m GROUP BY task, chunk) GROUP BY task",
    "AGG8_selective": f"""WITH {CONF}, t AS (SELECT unnest(range(0, 11)) / 10 AS threshold)
SELECT task, round(threshold, 6) AS threshold, round(count(*) FILTER (WHERE conf >= threshold) / count(*), 6) AS coverage, round(avg(correct) FILTER (WHERE conf >= threshold), 6) AS accuracy FROM c, t GROUP BY task, threshold""",
    "AGG9_report": f"""WITH {FACTS}, {_SHARP.format(t="1.5", source="f")}, c AS (SELECT *, list_max(p) AS conf, CAST(list_position(p, list_max(p)) - 1 = y AS INT) AS correct FROM sh),
e AS (SELECT task, sum(g) / sum(n) AS ece FROM (SELECT task, abs(sum(correct) - sum(conf)) AS g, count(*) AS n FROM c GROUP BY task, {_BINS}) GROUP BY task)
SELECT task, count(*) AS count, round(avg(correct), 6) AS accuracy, round(any_value(ece), 6) AS ece, round(avg({_P}), 6) AS brier, 1.5::DOUBLE AS temperature, count(*) AS binned,
  round(count(*) FILTER (WHERE conf >= 0.5) / count(*), 6) AS coverage_at_half, round(avg(correct) FILTER (WHERE conf >= 0.5), 6) AS accuracy_at_half FROM c JOIN e USING (task) GROUP BY task""",
    "AGG10_score_mae": _agg("abs(list_sum(list_transform(range(1, n + 1), lambda i: i * p[i])) - y - 1)", "mae").replace("count(*) AS n, ", ""),
    "AGG11_accuracy_at_coverage": f"""WITH {CONF}, m AS (SELECT *, list_reverse_sort(p)[1] - list_reverse_sort(p)[2] AS margin FROM c),
r AS (SELECT task, correct, row_number() OVER (PARTITION BY task ORDER BY margin DESC, correct DESC, id) AS rn, count(*) OVER (PARTITION BY task) AS size FROM m)
SELECT task, count(*) AS kept, round(avg(correct), 6) AS accuracy FROM r WHERE rn <= greatest(1, round_even(size * 0.6, 0)) GROUP BY task""",
    "AGG13_predicted_classes": f"""WITH {FACTS}, n AS (SELECT task, options[list_position(p, list_max(p))] AS predicted, count(*) AS count FROM f GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY count DESC, predicted) AS rank FROM n) WHERE rank <= 3""",
    "AGG14_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE rn = least(n, floor(n * 0.5) + 1)) AS p50, max(value) FILTER (WHERE rn = least(n, floor(n * 0.95) + 1)) AS p95, max(value) FILTER (WHERE rn = least(n, floor(n * 0.99) + 1)) AS p99, count(*) AS n FROM r GROUP BY event_type""",
    "AGG17_disagreements": f"WITH {PAIRS} SELECT family, count(*) FILTER (WHERE {_RIGHT.format(d=_S)} > {_RIGHT.format(d=_T)}) AS student_only_right, count(*) FILTER (WHERE {_RIGHT.format(d=_S)} < {_RIGHT.format(d=_T)}) AS teacher_only_right FROM pr WHERE y IS NOT NULL GROUP BY family",
    "AGG21_shape_counts": "SELECT qtype, count(*) AS questions FROM questions GROUP BY qtype",
    "AGG23_mean_sd": f"""WITH {CONF}, g AS (SELECT task, config, avg(correct) AS a, avg({_P}) AS b FROM c GROUP BY task, config)
SELECT task, count(*) AS configs, round(avg(a), 6) AS mean_accuracy, round(stddev(a), 6) AS sd_accuracy, round(avg(b), 6) AS mean_brier, round(stddev(b), 6) AS sd_brier FROM g GROUP BY task""",
    "FIT1_temperature": _FIT1 + " SELECT task, round(t, 4) AS temperature FROM fitted",
    "FIT2_diagnose": _FIT1
    + f""", w AS (SELECT f.task, p, y, t, {_floor_log("1e-6")} AS z FROM f JOIN fitted USING (task))
SELECT task, round(any_value(t), 4) AS temperature, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[y + 1]), 4) AS nll_before, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x / t)))) - z[y + 1] / t), 4) AS nll_after,
  bool_and({_RIGHT.format(d="p")} = 1) AS separable, any_value(t <= 0.00105 OR t >= 19) AS at_bound, NOT (any_value(t <= 0.00105 OR t >= 19) OR bool_and({_RIGHT.format(d="p")} = 1)) AS trustworthy FROM w GROUP BY task""",
    "FIT3_fit_predictions": _golden(_floor_log("0.005"), "0.05", "20") + " SELECT task, round(t, 4) AS temperature FROM fitted",
    "FIT4_fit_clipped": _golden(_CLIP_LOG, "0.05", "20") + " SELECT task, round(t, 4) AS temperature FROM fitted",
    "FIT5_folds": f"WITH {FACTS}, u AS (SELECT *, {hash_unit_sql('0', 'id')} AS u FROM f) SELECT id, (row_number() OVER (PARTITION BY task, y ORDER BY u, id) - 1) % 5 AS fold FROM u",
    "FIT6_cross_fit": _golden(
        _CLIP_LOG,
        "0.05",
        "20",
        "o",
        "task || '|' || held",
        f"{FACTS}, u AS (SELECT *, {hash_unit_sql('0', 'id')} AS u FROM f), d AS (SELECT *, (row_number() OVER (PARTITION BY task, y ORDER BY u, id) - 1) % 5 AS fold FROM u), o AS (SELECT d.*, held FROM d, range(5) x(held) WHERE held <> fold)",
    )
    + " SELECT d.task, fold, count(*) AS n, round(any_value(t), 4) AS temperature FROM d JOIN fitted ON fitted.task = d.task || '|' || fold GROUP BY d.task, fold",
    "FIT12_ece_floor": f"""WITH {CONF}{_MASS}, w AS (SELECT m.*, x.d, ({hash_unit_sql("0", "id")} * 4294967296)::BIGINT * ((((x.d + 1) * 2654435761) % 2147483648) | 1) % 4294967296 AS u FROM m, range(200) x(d)),
g AS (SELECT task, d, chunk, abs(sum(CAST(u < conf * 4294967296 AS INT)) - sum(conf)) AS e, count(*) AS n FROM w GROUP BY task, d, chunk)
SELECT task, round(avg(e), 6) AS ece_floor FROM (SELECT task, d, sum(e) / sum(n) AS e FROM g GROUP BY task, d) GROUP BY task""",
    "FIT8_calibration_line": f"""WITH RECURSIVE {CONF}, r AS (SELECT task, ln(k / (1 - k)) AS x, correct::DOUBLE AS t FROM (SELECT task, correct, least(greatest(conf, 1e-4), 1 - 1e-4) AS k FROM c)),
it(i, task, a, b) AS (SELECT DISTINCT 0, task, 0.0::DOUBLE, 1.0::DOUBLE FROM r
  UNION ALL
  SELECT i + 1, task, a + sa * CASE WHEN q > 0 THEN ln(1 + q) / q ELSE 1 END, b + sb * CASE WHEN q > 0 THEN ln(1 + q) / q ELSE 1 END FROM (
    SELECT *, 9.264 * sqrt(sa * sa + sb * sb) AS q FROM (
      SELECT *, (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS sa, (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS sb FROM (
        SELECT i, task, a, b, sum(t - m) - a AS g1, sum((t - m) * x) - (b - 1) AS g2, sum(m * (1 - m)) + 1 AS h11, sum(m * (1 - m) * x) AS h12, sum(m * (1 - m) * x * x) + 1 AS h22
        FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS m FROM it JOIN r USING (task)) WHERE i < 60 GROUP BY i, task, a, b))))
SELECT task, round(arg_max(a, i), 4) AS intercept, round(arg_max(b, i), 4) AS slope FROM it GROUP BY task""",
    "FIT14_verdict": f"""WITH {CONF}, s AS (SELECT task, avg({_P}) / 20 - 0.01 AS bl, avg({_P}) / 20 AS bh, avg(correct) / 10 - 0.07 AS al, avg(correct) / 10 - 0.03 AS ah FROM c GROUP BY task)
SELECT task, CASE WHEN bh <= 0.02 AND al >= -0.02 THEN 'PASS' WHEN bl > 0.02 OR ah < -0.02 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM s""",
    "FIT16_head_temperature": _golden(_floor_log("1e-6").replace("p,", "student,"), "0.001", "20", "pr", "family", PAIRS)
    + f""" SELECT task, CASE WHEN ok THEN round(t, 4) ELSE 1.0 END AS temperature, ok AS trustworthy FROM (SELECT task, any_value(t) AS t,
  NOT (any_value(t <= 0.00105 OR t >= 19) OR bool_and({_RIGHT.format(d="student")} = 1)) AS ok FROM pr JOIN fitted ON task = family WHERE y IS NOT NULL GROUP BY task)""",
}
