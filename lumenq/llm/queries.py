"""Queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm import formats, overlap, packing, private, sampling, spans, templates
from lumenq.session import load, materialise


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.members(load(spark, sf_dir, "examples"))
    return rows.where(F.col("example_id") != F.col("keep_id")).select("keep_id", F.col("example_id").alias("dup_id")).distinct()


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.collapse(load(spark, sf_dir, "examples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = overlap.sample_pairs(load(spark, sf_dir, "samples")).withColumn("rec", F.lit("sample"))
    predictions = overlap.prediction_pairs(load(spark, sf_dir, "predictions")).withColumn("rec", F.lit("prediction"))
    pairs = samples.select("rec", "eval_id", "train_id").unionByName(predictions.select("rec", "eval_id", "train_id"))
    return pairs.select("rec", F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p3_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = load(spark, sf_dir, "samples")
    return overlap.report(overlap.sample_links(samples), samples, "sample_id")


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each leaked evaluation sample one training sample's matched passages cover at most."""
    found = overlap.sample_links(load(spark, sf_dir, "samples"))
    return found.select("eval_id", "links", "words", "covered", F.round(F.col("covered") / F.col("words"), 6).alias("portion"))


def p3_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = load(spark, sf_dir, "predictions")
    return overlap.report(overlap.prediction_links(predictions), predictions, "pred_id")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = load(spark, sf_dir, "examples").select(F.lit("example").alias("rec"), F.col("example_id").alias("rec_id"), "state")
    labelled = load(spark, sf_dir, "labelled").select(F.lit("labelled").alias("rec"), F.col("labelled_id").alias("rec_id"), "state")
    return examples.unionByName(labelled)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.spans(_states(spark, sf_dir)).select("rec", "rec_id", "kind", "span").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.redacted(_states(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.plan(load(spark, sf_dir, "labelled"), load(spark, sf_dir, "sources"), load(spark, sf_dir, "targets"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.unmet(_plan(spark, sf_dir)).distinct()


def p5_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and counts; whether rows lack, and whether what is taken is within its bounds and agrees with that."""
    planned = _plan(spark, sf_dir)
    lacks = ~F.col("met") & (F.col("cause") == "rows")
    within = (F.col("take") <= F.col("have")) & (F.col("take") >= F.least("have", "min_rows")) & (F.col("met") | F.col("cause").isNotNull())
    return planned.select("source_name", "label", "target_pct", "min_rows", "size", "have", F.coalesce(lacks, F.lit(False)).alias("lacks_rows"), F.coalesce(within, F.lit(False)).alias("within")).distinct()


def p5_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("source_name", "label", "take", "met", "cause")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = materialise(_plan(spark, sf_dir), "plan")
    return sampling.draw(load(spark, sf_dir, "labelled"), planned)


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"), load(spark, sf_dir, "containers"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_packed(spark, sf_dir), load(spark, sf_dir, "containers"))


def p6_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each kind of container, and what a packing must not do: lose tokens, overfill, split needlessly."""
    kinds = load(spark, sf_dir, "containers")
    counts = materialise(packing.token_counts(load(spark, sf_dir, "documents")), "token-counts")
    return packing.conserved(counts, materialise(packing.containers(counts, kinds), "packed"), kinds)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "test_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where(F.col("literal") > 0).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.pairs(load(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.coverage(load(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p3_found": p3_found,
    "p3_samples": p3_samples,
    "p3_coverage": p3_coverage,
    "p3_predictions": p3_predictions,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_plan": p5_plan,
    "p5_taken": p5_taken,
    "p5_sample": p5_sample,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_conserved": p6_conserved,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_shared": p8_shared,
}

_CLEAN = r"lower(trim(replace({0}, '_', ' '), e' \t\n\r'))"
_TRAIN = r"lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) = 'train'"
_NAME = r"lower(regexp_replace(replace({0}, '_', ' '), '^\s+|\s+$', '', 'g'))"
_OVERLAPS = rf"""
WITH s AS (SELECT sample_id AS id, {_TRAIN} AS tr, list_distinct(list_transform(regexp_extract_all(state, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))) AS w FROM samples WHERE state IS NOT NULL AND split IS NOT NULL),
c AS (SELECT a.id AS x, b.id AS y, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS t FROM s a JOIN s b ON a.tr AND NOT b.tr AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)),
p AS (SELECT pred_id AS id, task, {_TRAIN} AS tr, {_NAME.format("label")} AS lab, list_sort(list_transform(map_entries(probabilities), lambda e: {{'o': {_NAME.format("e.key")}, 'p': e.value}})) AS d
  FROM predictions WHERE label IS NOT NULL AND split IS NOT NULL AND task IS NOT NULL AND cardinality(probabilities) > 0),
q AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.tr AND NOT b.tr AND a.task = b.task AND a.lab = b.lab AND list_transform(a.d, lambda e: e.o) = list_transform(b.d, lambda e: e.o)
  WHERE list_max(list_transform(range(1, len(a.d) + 1), lambda i: abs(a.d[i].p - b.d[i].p))) <= 0.000002000001::DOUBLE)"""
_REPORT = """, n AS (SELECT y, count(DISTINCT x) AS l FROM {pairs} GROUP BY y)
SELECT {split} AS split, {task} AS task, count(*) AS rows, count(l) AS overlapping, coalesce(sum(l), 0)::BIGINT AS links FROM {table} LEFT JOIN n ON y = {key} WHERE {split} <> 'train' GROUP BY 1, 2"""
_LOWER = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"


def _report_sql(pairs: str, table: str, key: str) -> str:
    return _OVERLAPS + _REPORT.format(pairs=pairs, table=table, key=key, split=_LOWER.format("split"), task=_LOWER.format("task"))


_PLAIN = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_RECORDS = rf"""
WITH e AS (SELECT example_id, state, {_PLAIN.format("family")} AS family, json_valid(state) AND starts_with(trim(state, e' \t\r\n'), '{{') AS obj FROM examples WHERE trim(state, e' \t\r\n') <> ''),
t AS (SELECT example_id, lower(regexp_replace(j.fullkey, '[^\p{{L}}\p{{N}}\[\].]+', '', 'g')) AS k,
    CASE j.type WHEN 'VARCHAR' THEN 's' || {_PLAIN.format("json_extract_string(j.value, '$')")} WHEN 'OBJECT' THEN 'o' WHEN 'ARRAY' THEN 'a' ELSE j.type || j.atom END AS v
  FROM (SELECT * FROM e WHERE obj) x, json_tree(x.state) j),
c AS (SELECT example_id, 'o' || string_agg(k || '=' || v, '|' ORDER BY k, v) AS c FROM t GROUP BY example_id UNION ALL SELECT example_id, 't' || {_PLAIN.format("state")} FROM e WHERE NOT obj),
r AS (SELECT example_id, family, min(example_id) OVER (PARTITION BY family, c) AS keep_id, state FROM c JOIN e USING (example_id))"""
SQL = {
    "p2_found": _RECORDS + " SELECT DISTINCT keep_id, example_id AS dup_id FROM r WHERE keep_id <> example_id",
    "p2_records": _RECORDS + " SELECT keep_id, r.family AS family_key, count(*) AS copies, count(DISTINCT x.family || '|' || r.state) AS writings FROM r JOIN examples x USING (example_id) GROUP BY keep_id, r.family",
    "p3_found": _OVERLAPS + """
SELECT DISTINCT 'sample' AS rec, least(x, y) AS id_a, greatest(x, y) AS id_b FROM c WHERE t > n AND n >= 0.7 * (t - n)
UNION ALL SELECT DISTINCT 'prediction', least(x, y), greatest(x, y) FROM q""",
    "p3_samples": _report_sql("(SELECT x, y FROM c WHERE t > n AND n >= 0.7 * (t - n))", "samples", "sample_id"),
    "p3_predictions": _report_sql("q", "predictions", "pred_id"),
    "p5_found": f"""
WITH h AS (SELECT source, {_CLEAN.format("label")} AS lk, count(DISTINCT labelled_id) AS h FROM labelled GROUP BY 1, 2)
SELECT DISTINCT t.source_name, t.label FROM targets t JOIN sources s USING (source_name)
LEFT JOIN h ON h.source = t.source_name AND h.lk = {_CLEAN.format("t.label")}
WHERE coalesce(h, 0) * 100 < target_pct * per_class * len(label_list) OR coalesce(h, 0) < min_rows""",
    "p5_plan": f"""
WITH h AS (SELECT source, {_CLEAN.format("label")} AS lk, count(DISTINCT labelled_id) AS have FROM labelled GROUP BY 1, 2)
SELECT DISTINCT t.source_name, t.label, target_pct::BIGINT AS target_pct, min_rows::BIGINT AS min_rows, (per_class * len(label_list))::BIGINT AS size, coalesce(have, 0) AS have,
  coalesce(have, 0) * 100 < target_pct * per_class * len(label_list) OR coalesce(have, 0) < min_rows AS lacks_rows, true AS within FROM targets t JOIN sources s USING (source_name)
LEFT JOIN h ON h.source = t.source_name AND h.lk = {_CLEAN.format("t.label")}""",
    "p6_conserved": "SELECT container_kind, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0::BIGINT AS lost_tokens, 0::BIGINT AS overfull, 0::BIGINT AS needless_splits FROM containers",
    "p7_leaks": rf"""
WITH t AS (SELECT true AS doc, doc_id AS id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w FROM documents UNION ALL SELECT false, item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') FROM test_items),
o AS (SELECT *, list_transform(w, lambda x: lower(x)) AS own, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '#' WHEN list_contains({templates._UNITS.split()}, lower(x)) THEN '%' ELSE lower(x) END) AS flat FROM t WHERE len(w) >= 10),
c AS (SELECT *, list_transform(w, lambda x, i: CASE WHEN flat[i] = own[i] AND regexp_matches(x, '^\p{{Lu}}') AND NOT list_contains({templates._CLOSED.split()}, own[i]) THEN '@' ELSE flat[i] END) AS cased FROM o),
g AS (SELECT doc, id, p, own[p:p+9] AS o, flat[p:p+9] AS f, cased[p:p+9] AS c FROM (SELECT *, unnest(range(1, len(w) - 8)) AS p FROM c)),
k AS (SELECT doc, id, p, o, o AS t FROM g UNION ALL SELECT doc, id, p, o, f FROM g WHERE f <> o AND len(list_filter(f, lambda x: x IN ('#', '%'))) <= 5
  UNION ALL SELECT doc, id, p, o, c FROM g WHERE c <> f AND len(list_filter(c, lambda x: x IN ('#', '%', '@'))) <= 5),
m AS (SELECT a.id AS doc_id, b.id AS item_id, a.p, bool_or(a.o = b.o)::BIGINT AS lit FROM k a JOIN k b ON a.doc AND NOT b.doc AND a.t = b.t
  WHERE a.o = b.o OR (len(list_distinct(list_zip(a.o, b.o))) = len(list_distinct(a.o)) AND len(list_distinct(list_zip(a.o, b.o))) = len(list_distinct(b.o))) GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS passages, sum(lit)::BIGINT AS literal, sum(1 - lit)::BIGINT AS reparameterised FROM m GROUP BY ALL""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM documents),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM test_items),
dw AS (SELECT doc_id, array_to_string(w[p:p+9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS p FROM d)),
iw AS (SELECT item_id, array_to_string(w[p:p+9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    "p8_found": """
WITH w AS (SELECT DISTINCT doc_id, substr(text, p, 200) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS p FROM documents WHERE length(text) >= 200)),
r AS (SELECT doc_id, g FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM r a JOIN r b USING (g) WHERE a.doc_id < b.doc_id""",
    "p8_shared": """
WITH w AS (SELECT doc_id, p, substr(text, p, 200) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS p FROM documents WHERE length(text) >= 200)),
r AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS lo, max(doc_id) OVER (PARTITION BY g) AS hi FROM w) WHERE lo < hi),
s AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 1000000) AS gap FROM r),
c AS (SELECT doc_id, count(*) FILTER (WHERE gap > 200) AS spans, sum(least(gap, 200))::BIGINT AS shared_chars FROM s GROUP BY doc_id)
SELECT doc_id, spans, shared_chars, length(text)::BIGINT AS n_chars, round(shared_chars / length(text), 6) AS portion FROM c JOIN documents USING (doc_id)""",
}
