"""Queries of the question model, the log and prompt rendering (PRJ, JON, WIN6, WIN9, FLT, GEN11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.functions import text
from lumenq.operators import traffic
from lumenq.plans import model
from lumenq.plans.base import QUESTIONS, family_questions
from lumenq.session import load


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question table as JSON on the wire, in declared order."""
    rows = load(spark, sf_dir, "questions")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    noul = F.array_compact(F.transform("criteria", lambda c: F.when(c["descr"].isNotNull(), F.concat(quoted(F.when(c["opt"] == "yes", "true").otherwise("false")), F.lit(":"), quoted(c["descr"])))))
    choice = F.transform("criteria", lambda c: F.concat(quoted(c["opt"]), F.lit(":"), F.coalesce(quoted(c["descr"]), F.lit("null"))))
    score = F.transform("criteria", lambda c: F.concat(quoted(c["opt"]), F.lit(":"), c["val"].cast("string")))
    listed = F.transform("criteria", lambda c: quoted(c["opt"]))
    described = F.exists("criteria", lambda c: c["descr"].isNotNull())
    criteria = (
        F.when((F.col("qtype") == "noul") & described, F.concat(F.lit("{"), F.array_join(noul, ","), F.lit("}")))
        .when(F.col("qtype") == "noul", F.lit("null"))
        .when(F.col("qtype") == "score", F.concat(F.lit("{"), F.array_join(score, ","), F.lit("}")))
        .when(described, F.concat(F.lit("{"), F.array_join(choice, ","), F.lit("}")))
        .otherwise(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")))
    )
    wire = F.concat(F.lit('{"type":"'), "qtype", F.lit('","instructions":"'), "instructions", F.lit('","criteria":'), criteria, F.lit("}"))
    return rows.select("family", wire.alias("text"))


def prj3(spark, sf):
    """Family keys computed from the wire shape."""
    return _wire(spark, sf).select("family", model.parsed(F.col("text"))["family"].alias("computed"))


def prj1(spark, sf):
    parsed = _wire(spark, sf).select("family", model.parsed(F.col("text")).alias("q"))
    return parsed.select("family", F.col("q.type").alias("qtype"), F.size("q.options").cast("long").alias("options"), F.col("q.error").isNull().alias("valid"))


def prj4(spark, sf):
    parsed = _wire(spark, sf).select("family", model.parsed(F.col("text")).alias("q"))
    return parsed.select("family", F.posexplode("q.options").alias("k", "option"))


def prj5(spark, sf):
    q = family_questions(spark, sf).withColumn("o", F.reverse(F.sequence(F.lit(0), F.size("options") - 1)))
    return q.select("family", F.posexplode(text.in_order(F.col("options"), F.col("o"))).alias("k", "option"))


def prj6(spark, sf):
    return family_questions(spark, sf).select("family", F.posexplode(text.option_lines(F.col("options"), F.col("descriptions"))).alias("k", "line"))


def prj8(spark, sf):
    rows = load(spark, sf, "examples").where(F.col("state").isNotNull())
    shown = rows.select("example_id", text.prefix(model.shown_state(F.col("state"))).alias("prefix"))
    return shown.select("example_id", F.md5("prefix").alias("rendered"), F.length("prefix").cast("long").alias("chars"))


def prj9(spark, sf):
    q = family_questions(spark, sf)
    return q.select("family", text.letter_branch(F.col("instructions"), text.option_lines(F.col("options"), F.col("descriptions"))).alias("branch"))


def prj10(spark, sf):
    q = family_questions(spark, sf)
    return q.select("family", text.sequence_branch(F.col("instructions"), text.option_lines(F.col("options"), F.col("descriptions"))).alias("branch"))


def prj11(spark, sf):
    return family_questions(spark, sf).select("family", F.explode(text.labels(F.col("options"))).alias("l")).select("family", "l.*")


def _examples(spark, sf):
    return traffic.examples(load(spark, sf, "traffic_log"))


def jon1(spark, sf):
    rows = _examples(spark, sf)
    return rows.select("request_id", "question", "type", F.size("options").cast("long").alias("options"), F.col("outcome").cast("long").alias("outcome"), "bad_outcome", "source", F.round(F.get("teacher", F.lit(0)), 6).alias("first"))


def jon1_family(spark, sf):
    """The same grouped by computed family: every family is one of the question table or another wording."""
    return _examples(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("asks"), F.count("outcome").alias("known"))


def prj12(spark, sf):
    return _examples(spark, sf).select("request_id", "question", F.posexplode("teacher").alias("k", "p")).select("request_id", "question", "k", F.round("p", 6).alias("p"))


def agg12(spark, sf):
    return traffic.families(_examples(spark, sf)).drop("family")


def win6(spark, sf):
    return traffic.latest_outcomes(load(spark, sf, "traffic_log")).select("oid", "name", "raw")


def _exported(spark, sf):
    """The examples table with the columns of ``traffic.examples``."""
    shadow = F.from_json("shadow", "head string, version int, probabilities array<double>")
    return load(spark, sf, "examples").select("example_id", "request_id", F.lower(text.strip(F.col("family"))).alias("family"), "question", "teacher", "outcome", "source", shadow.alias("shadow"))


def win9(spark, sf):
    rows = _exported(spark, sf).where(F.col("request_id").isNotNull())
    return traffic.split(rows, 0.3).select("example_id", "part")


def gen11(spark, sf):
    rows = traffic.targets(traffic.trainable(_exported(spark, sf)), 0.37)
    return rows.select("example_id", F.posexplode("target").alias("k", "t")).select("example_id", "k", F.round("t", 6).alias("t"))


def flt1(spark, sf):
    return traffic.trainable(_exported(spark, sf)).select("example_id", "source")


def flt2(spark, sf):
    rows = _exported(spark, sf)
    return traffic.shadow_rows(rows, "head:61aee44b46304ceb", 1).unionByName(traffic.shadow_rows(rows, "head:a7bb81da9945393f", 3)).select("example_id", F.size("student").cast("long").alias("options"))


def flt3(spark, sf):
    return _exported(spark, sf).where(F.col("family") == "61aee44b46304ceb").select("example_id")


def str9(spark, sf):
    log = load(spark, sf, "traffic_log")
    reports = log.where((F.col("kind") == "outcome") & F.col("id").isNotNull()).select("log_pos", "id", F.explode(F.from_json("outcomes", "map<string,string>")).alias("name", "raw"))
    recent = _examples(spark, sf).select(F.col("request_id").alias("rid"), "question", "type", "options")
    return traffic.valid_outcomes(reports, recent).groupBy("status").agg(F.count(F.lit(1)).alias("reports"))


def tok1(spark, sf):
    """Common beginning of each sample's words with those of the next id."""
    rows = load(spark, sf, "samples").where(F.col("state").isNotNull()).select("sample_id", text.words(F.col("state")).alias("w"))
    nxt = rows.select((F.col("sample_id") - 1).alias("before"), F.col("w").alias("v"))
    return rows.join(nxt, F.col("sample_id") == F.col("before")).select("sample_id", text.match_length(F.col("w"), F.col("v")).cast("long").alias("common"))


def _prompts(spark, sf):
    """Each example with its rendered prefix and its family's question."""
    ex = load(spark, sf, "examples").where(F.col("state").isNotNull()).select("example_id", F.lower(text.strip(F.col("family"))).alias("f__"), text.prefix(model.shown_state(F.col("state"))).alias("prefix"))
    return ex.join(F.broadcast(family_questions(spark, sf)), F.col("f__") == F.col("family")).withColumn("lines", text.option_lines(F.col("options"), F.col("descriptions")))


def tok2(spark, sf):
    """Tokens of the prefix that the prompts of the family's letter and sequence branch share."""
    branches = F.array(text.letter_branch(F.col("instructions"), F.col("lines")), text.sequence_branch(F.col("instructions"), F.col("lines")))
    rows = _prompts(spark, sf).select("example_id", text.words(F.col("prefix")).alias("w"), F.transform(branches, lambda b: text.words(F.concat("prefix", b))).alias("whole"))
    return rows.select("example_id", text.shared_prefix_length(F.col("w"), F.col("whole"), 1).cast("long").alias("shared"))


def tok3(spark, sf):
    """Each option's tokens, cut off the joint encoding behind the whole prompt."""
    rows = _prompts(spark, sf).withColumn("context", F.concat("prefix", text.sequence_branch(F.col("instructions"), F.col("lines"))))
    each = rows.select("example_id", "context", text.words(F.col("context")).alias("w"), F.posexplode("options").alias("k", "option"))
    rest = text.continuation(F.col("w"), text.words(F.concat("context", F.lit(" "), "option")))
    return each.select("example_id", "k", F.size("w").cast("long").alias("context_tokens"), F.array_join(rest, "").alias("rest"))


def usage(spark, sf):
    """AGG20: tokens of the prefix once and of each branch."""
    q = family_questions(spark, sf)
    branch = text.letter_branch(F.col("instructions"), text.option_lines(F.col("options"), F.col("descriptions")))
    branches = q.select(F.col("family").alias("f__"), F.size(text.words(branch)).alias("branch"))
    rows = load(spark, sf, "examples").where(F.col("state").isNotNull()).select("request_id", "state", F.lower(text.strip(F.col("family"))).alias("family")).where(F.col("request_id").isNotNull())
    joined = rows.join(branches, F.col("family") == F.col("f__"))
    return joined.groupBy("request_id").agg((F.max(F.size(text.words(text.prefix(model.shown_state(F.col("state")))))) + F.sum("branch")).alias("input_tokens"))


QUERIES = {
    "PRJ1_parse": prj1,
    "PRJ3_family_key": prj3,
    "PRJ4_declared_options": prj4,
    "PRJ5_options_in_order": prj5,
    "PRJ6_option_lines": prj6,
    "PRJ8_prefix": prj8,
    "PRJ9_letter_branch": prj9,
    "PRJ10_sequence_branch": prj10,
    "PRJ11_labels": prj11,
    "PRJ12_teacher": prj12,
    "JON1_examples": jon1,
    "JON1_by_family": jon1_family,
    "AGG12_families": agg12,
    "AGG20_usage": usage,
    "WIN6_latest": win6,
    "WIN9_split": win9,
    "GEN11_targets": gen11,
    "FLT1_trainable": flt1,
    "FLT2_shadow_rows": flt2,
    "FLT3_family": flt3,
    "STR9_outcome_validation": str9,
    "TOK1_match_length": tok1,
    "TOK2_shared_prefix": tok2,
    "TOK3_continuation": tok3,
}

_LINES = "list_transform(list_zip(options, descriptions), lambda s: CASE WHEN s[2] IS NULL OR s[2] = '' THEN s[1] ELSE s[1] || ': ' || s[2] END)"
_UNNEST = "CAST(unnest(range(len({v}))) AS INT) AS k, unnest({v})"
# A JSON object as text: keys in order, two blanks a level, no character above ASCII.
_LEVEL = "'{{' || array_to_string(list_transform(list_sort(json_keys({0})), lambda {1}: to_json({1}) || ':' || {2}), ',') || '}}'"
_VALUE = "json_extract({0}, '$.\"' || {1} || '\"')"
_INNER = _VALUE.format("state", "k")
_DEEPER = f"CASE WHEN json_type({_INNER}) = 'OBJECT' THEN {_LEVEL.format(_INNER, 'm', _VALUE.format(_INNER, 'm'))} ELSE {_INNER} END"
_SORTED = f"CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN json_pretty({_LEVEL.format('state', 'k', _DEEPER)}) END"
# Each level is indented by two blanks instead of four, the innermost first.
_NARROW = r"regexp_replace(regexp_replace(regexp_replace({0}, '\n {{12}}(\S)', chr(10) || '@@@@@@\1', 'g'), '\n {{8}}(\S)', chr(10) || '@@@@\1', 'g'), '\n {{4}}(\S)', chr(10) || '@@\1', 'g')"
_NARROW = r"regexp_replace(regexp_replace(regexp_replace(" + _NARROW + r", '\n@@@@@@', chr(10) || '      ', 'g'), '\n@@@@', chr(10) || '    ', 'g'), '\n@@', chr(10) || '  ', 'g')"
_ASCII = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) > 127 THEN chr(92) || 'u' || lpad(printf('%x', unicode(c)), 4, '0') ELSE c END), '')"
_BODY = f"coalesce({_ASCII.format(_NARROW.format(_SORTED))}, state)"
_PREFIX = f"'{text.PREFIX}' || {_BODY} || '{text.PREFIX_END}'"
_BRANCH = f"'{text.QUESTION}' || instructions || chr(10) || array_to_string(list_transform(range(1, len(options) + 1), lambda i: chr((64 + i)::INT) || ') ' || {_LINES}[i]), chr(10)) || '{text.QUESTION_END}'"
_SEQUENCE = f"'{text.QUESTION}' || instructions || '{text.SEQUENCE_LINE}' || array_to_string(list_transform({_LINES}, lambda l: '- ' || l), chr(10)) || '{text.QUESTION_END}'"
_PROMPTS = rf"""{QUESTIONS}, pr AS (SELECT example_id, {_PREFIX} AS prefix, {_BRANCH} AS letter, {_SEQUENCE} AS sequence, options FROM examples e JOIN q ON q.family = lower(regexp_replace(e.family, '^\s+|\s+$', '', 'g')) WHERE state IS NOT NULL)"""
_WORDS = r"regexp_extract_all({0}, '( ?\S+|\s)', 1)"
_EX = r"""a AS (SELECT id, log_pos, questions, answers, served_by FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY log_pos DESC) AS r FROM traffic_log WHERE kind = 'ask' AND id IS NOT NULL) WHERE r = 1),
qs AS (SELECT id AS request_id, log_pos, unnest(json_keys(questions)) AS question, questions, answers, served_by FROM a),
qd AS (SELECT *, json_extract(questions, '$."' || question || '"') AS d, json_extract(answers, '$."' || question || '"') AS ans FROM qs),
qo AS (SELECT *, d->>'type' AS type, CASE WHEN d->>'type' = 'noul' THEN ['yes', 'no'] WHEN json_type(d->'criteria') = 'ARRAY' THEN CAST(d->'criteria' AS VARCHAR[]) ELSE json_keys(d->'criteria') END AS options FROM qd),
ok AS (SELECT id AS oid, unnest(json_keys(outcomes)) AS name, outcomes, log_pos FROM traffic_log WHERE kind = 'outcome' AND id IS NOT NULL),
oc AS (SELECT oid, name, arg_max_null(json_extract_string(outcomes, '$."' || name || '"'), log_pos) AS raw FROM ok GROUP BY oid, name),
x AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN type = 'noul' THEN CASE WHEN raw IN ('true', 'yes') THEN 0 WHEN raw IN ('false', 'no') THEN 1 ELSE -1 END ELSE coalesce(list_position(options, raw), 0) - 1 END AS idx
  FROM qo LEFT JOIN oc ON request_id = oid AND question = name),
ex AS (SELECT *, CASE WHEN idx >= 0 THEN idx END AS outcome, coalesce(idx = -1, false) AS bad_outcome, coalesce(json_extract_string(served_by, '$."' || question || '"'), 'teacher') AS source,
  CASE WHEN type = 'noul' THEN [CAST(ans->>'noul' AS DOUBLE), 1 - CAST(ans->>'noul' AS DOUBLE)] ELSE list_transform(options, lambda o: CAST(json_extract(ans, '$.probabilities."' || o || '"') AS DOUBLE)) END AS teacher FROM x)"""
_EXPORTED = r"""e AS (SELECT example_id, request_id, lower(regexp_replace(family, '^\s+|\s+$', '', 'g')) AS family, teacher, outcome, source, shadow, (('0x' || substr(sha256(request_id), 1, 8))::UBIGINT / 4294967296.0) AS u FROM examples)"""

_FIRST = "arg_min({0}, {{'p': log_pos, 'q': question}})"

SQL = {
    "AGG12_families": f"""WITH {_EX} SELECT count(*) AS asks, count(outcome) AS outcomes, {_FIRST.format("question")} AS question, {_FIRST.format("type")} AS type, {_FIRST.format("d->>'instructions'")} AS instructions, min(log_pos) AS first_pos
FROM ex GROUP BY type, d->>'instructions', CASE WHEN json_type(d->'criteria') = 'NULL' THEN NULL ELSE json(d->'criteria')::VARCHAR END""",
    "PRJ1_parse": f"WITH {QUESTIONS} SELECT family, qtype, len(options) AS options, true AS valid FROM q",
    "PRJ3_family_key": "SELECT family, family AS computed FROM questions",
    "PRJ4_declared_options": f"WITH {QUESTIONS} SELECT family, {_UNNEST.format(v='options')} AS option FROM q",
    "PRJ5_options_in_order": f"WITH {QUESTIONS} SELECT family, {_UNNEST.format(v='list_reverse(options)')} AS option FROM q",
    "PRJ6_option_lines": f"WITH {QUESTIONS} SELECT family, {_UNNEST.format(v=_LINES)} AS line FROM q",
    "PRJ8_prefix": f"SELECT example_id, md5({_PREFIX}) AS rendered, length({_PREFIX}) AS chars FROM examples WHERE state IS NOT NULL",
    "JON1_by_family": f"WITH {_EX}, {QUESTIONS} SELECT family, count(*) AS asks, count(outcome) AS known FROM ex JOIN q ON ex.type = qtype AND ex.d->>'instructions' = instructions AND ex.options = q.options GROUP BY family",
    "STR9_outcome_validation": f"""WITH {_EX}, r AS (SELECT oid, name, json_extract_string(outcomes, '$."' || name || '"') AS raw FROM ok), ids AS (SELECT DISTINCT request_id FROM qo),
v AS (SELECT CASE WHEN ids.request_id IS NULL THEN 'accepted' WHEN question IS NULL THEN 'unknown question' WHEN raw IS NULL THEN 'accepted'
  WHEN CASE WHEN type = 'noul' THEN raw NOT IN ('true', 'yes', 'false', 'no') ELSE NOT list_contains(options, raw) END THEN 'unknown label' ELSE 'accepted' END AS status
  FROM r LEFT JOIN ids ON ids.request_id = oid LEFT JOIN qo ON qo.request_id = oid AND question = name)
SELECT status, count(*) AS reports FROM v GROUP BY status""",
    "PRJ9_letter_branch": f"WITH {QUESTIONS} SELECT family, {_BRANCH} AS branch FROM q",
    "PRJ10_sequence_branch": f"WITH {QUESTIONS} SELECT family, '{text.QUESTION}' || instructions || '{text.SEQUENCE_LINE}' || array_to_string(list_transform({_LINES}, lambda l: '- ' || l), chr(10)) || '{text.QUESTION_END}' AS branch FROM q",
    "PRJ11_labels": f"WITH {QUESTIONS} SELECT family, unnest(options) AS option, chr((64 + i)::INT) AS label, ' ' || chr((64 + i)::INT) AS rendered, CAST(64 + i AS INT) AS token_id FROM (SELECT family, unnest(options) AS options, unnest(range(1, len(options) + 1)) AS i FROM (SELECT family, list_transform(options, lambda o: [o]) AS options FROM q))",
    "PRJ12_teacher": f"WITH {_EX} SELECT request_id, question, k, round(p, 6) AS p FROM (SELECT request_id, question, {_UNNEST.format(v='teacher')} AS p FROM ex)",
    "JON1_examples": f"WITH {_EX} SELECT request_id, question, type, len(options) AS options, outcome::BIGINT AS outcome, bad_outcome, source, round(teacher[1], 6) AS first FROM ex",
    "AGG20_usage": f"WITH {QUESTIONS}, b AS (SELECT family, len({_WORDS.format(_BRANCH)}) AS branch FROM q), {_EXPORTED} SELECT e.request_id, (max(len({_WORDS.format(_PREFIX)})) + sum(branch))::BIGINT AS input_tokens FROM e JOIN examples x USING (example_id) JOIN b ON b.family = e.family WHERE state IS NOT NULL AND e.request_id IS NOT NULL GROUP BY e.request_id",
    "WIN6_latest": r"""WITH k AS (SELECT id AS oid, unnest(json_keys(outcomes)) AS name, outcomes, log_pos FROM traffic_log WHERE kind = 'outcome' AND id IS NOT NULL)
SELECT oid, name, arg_max_null(json_extract_string(outcomes, '$."' || name || '"'), log_pos) AS raw FROM k GROUP BY oid, name""",
    "WIN9_split": f"""WITH {_EXPORTED}, h AS (SELECT *, coalesce(outcome IS NOT NULL AND source = 'teacher' AND u < 0.3, false) AS held FROM e WHERE request_id IS NOT NULL)
SELECT example_id, CASE WHEN u < 0.15 THEN 'temperature' ELSE 'evaluation' END AS part FROM h WHERE held
UNION ALL SELECT example_id, 'train' FROM h WHERE (source = 'teacher' OR outcome IS NOT NULL) AND request_id NOT IN (SELECT request_id FROM h WHERE held)""",
    "GEN11_targets": f"""WITH {_EXPORTED}, t AS (SELECT example_id, CASE WHEN outcome IS NULL THEN teacher ELSE list_transform(range(1, len(teacher) + 1), lambda i: CASE WHEN source <> 'teacher' THEN CAST(i - 1 = outcome AS DOUBLE) ELSE 0.37 * CAST(i - 1 = outcome AS INT) + 0.63 * teacher[i] END) END AS target FROM e WHERE source = 'teacher' OR outcome IS NOT NULL)
SELECT example_id, k, round(t, 6) AS t FROM (SELECT example_id, {_UNNEST.format(v="target")} AS t FROM t)""",
    "FLT1_trainable": "SELECT example_id, source FROM examples WHERE source = 'teacher' OR outcome IS NOT NULL",
    "FLT2_shadow_rows": """SELECT example_id, json_array_length(shadow, '$.probabilities')::BIGINT AS options FROM examples WHERE outcome IS NOT NULL AND source = 'teacher'
AND (shadow->>'head', CAST(shadow->>'version' AS INT)) IN (('head:61aee44b46304ceb', 1), ('head:a7bb81da9945393f', 3))""",
    "FLT3_family": f"WITH {_EXPORTED} SELECT example_id FROM e WHERE family = '61aee44b46304ceb'",
    "TOK1_match_length": f"""WITH w AS (SELECT sample_id, {_WORDS.format("state")} AS w FROM samples WHERE state IS NOT NULL)
SELECT a.sample_id, (SELECT count(*) FROM range(1, least(len(a.w), len(b.w)) + 1) t(i) WHERE a.w[1:i] = b.w[1:i]) AS common FROM w a JOIN w b ON b.sample_id = a.sample_id + 1""",
    "TOK2_shared_prefix": f"""WITH {_PROMPTS}, w AS (SELECT example_id, {_WORDS.format("prefix")} AS w, unnest([{_WORDS.format("prefix || letter")}, {_WORDS.format("prefix || sequence")}]) AS v FROM pr)
SELECT example_id, min(coalesce(list_position(list_transform(range(1, len(w) + 1), lambda i: i <= len(v) AND w[i] = v[i]), false) - 1, len(w)))::BIGINT AS shared FROM w GROUP BY example_id""",
    "TOK3_continuation": f"""WITH {_PROMPTS}, o AS (SELECT example_id, prefix || sequence AS context, CAST(unnest(range(len(options))) AS INT) AS k, unnest(options) AS option FROM pr),
w AS (SELECT example_id, k, {_WORDS.format("context")} AS w, {_WORDS.format("context || ' ' || option")} AS v FROM o)
SELECT example_id, k, len(w) AS context_tokens, array_to_string(v[len(w) + 1:], '') AS rest FROM w WHERE v[1:len(w)] = w""",
}
