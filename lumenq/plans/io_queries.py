"""Queries of sources, sinks, streams and entry points: tables written and read back (SRC, SNK, STR2, ENT, VEC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.functions import dist, text
from lumenq.operators import metrics, retrieval, routing, traffic
from lumenq.plans import decide
from lumenq.plans.base import FACTS, QUESTIONS, confidences, facts, family_questions
from lumenq.plans.metric_queries import rounded
from lumenq.plans.traffic_queries import _EX
from lumenq.session import load, materialise, scratch
from lumenq.sources import readers, sinks
from lumenq.streaming import stateful


def _samples(spark, sf):
    return load(spark, sf, "samples").select("sample_id", "task", "state", "label")


def src1(spark, sf):
    """CSV: two files in order, quotes and line breaks inside fields."""
    rows = _samples(spark, sf).where(F.col("state").isNotNull() & F.col("label").isNotNull())
    paths = [scratch(spark, "csv") for _ in range(2)]
    for k, path in enumerate(paths):
        rows.where(F.col("sample_id") % 2 == k).write.csv(path, header=True, escape='"', quoteAll=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = readers.read_csv(spark, paths, line_sep="\n")
    return back.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("file_no").cast("long").alias("file_no"), F.length("state").cast("long").alias("chars"))


def src3(spark, sf):
    """JSON lines, gzip."""
    path = scratch(spark, "gz")
    _samples(spark, sf).write.json(path, compression="gzip")
    return readers.read_jsonl(spark, path, "sample_id long, task string, state string, label string")


def src4(spark, sf):
    return readers.read_parquet(spark, f"{sf}/samples.parquet", ["sample_id", "task"])


def src7(spark, sf):
    return readers.read_any(spark, f"{sf}/samples.parquet", ["sample_id", "label"])


def _log_file(spark, sf) -> str:
    """The log as JSON lines, written by the sinks."""
    path = scratch(spark, "log")
    log = load(spark, sf, "traffic_log").where(F.col("id").isNotNull())
    asks = log.where(F.col("kind") == "ask").select("id", "ts", "caller", "model", "state", "questions", "answers", "served_by", "shadow")
    sinks.append_log(sinks.ask_lines(asks), path)
    sinks.append_log(sinks.outcome_lines(log.where((F.col("kind") == "outcome") & F.col("outcomes").isNotNull())), path)
    return path


def src9(spark, sf):
    rows = readers.read_log(spark, _log_file(spark, sf))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct("log_pos").alias("positions"))


def str1_stream(spark, sf):
    """The log as a stream: each trigger's lines are parsed and appended to a table, each line once."""
    out, marks = scratch(spark, "appended"), scratch(spark, "appended-marks")
    readers.stream_log(spark, _log_file(spark, sf)).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


def src10(spark, sf):
    """Prediction files of every task, halves pooled, aligned to the task's labels in order."""
    rows = facts(spark, sf).select("split", "task", F.map_from_arrays("options", "p").alias("probabilities"), "label", F.array_sort("options").alias("labels"))
    paths = [scratch(spark, "half") for _ in range(2)]
    for k, path in enumerate(paths):
        rows.where((F.col("split") == "train") == F.lit(k == 0)).drop("split").write.json(path)
    back = readers.read_predictions(spark, *paths)
    return rounded(back.groupBy("task", F.col("half").cast("long").alias("half")).agg(F.count(F.lit(1)).alias("rows"), F.avg(dist.brier(F.col("p"), F.col("y"))).alias("brier")))


def snk5(spark, sf):
    """SRC12: distributions written by task, configuration and tag, one of them read back."""
    path = scratch(spark, "dist")
    sinks.write_distributions(facts(spark, sf).select("id", "p", "y", "task", "config", F.lit("base").alias("tag")), path)
    one = spark.read.parquet(path).where((F.col("task") == "desk routes") & (F.col("config") == "plain"))
    return one.agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("y_sum"))


def snk6(spark, sf):
    rows = facts(spark, sf).select("id", sinks.wire_result(F.map_from_arrays("options", F.transform("p", lambda x: F.round(x, 2))), F.col("n")).alias("body"))
    return rows.select("id", F.get_json_object("body", "$.usage.input_tokens").cast("long").alias("input_tokens"), F.get_json_object("body", "$.usage.output_tokens").cast("long").alias("output_tokens"))


def win4(spark, sf):
    return metrics.equal_mass(confidences(facts(spark, sf)), ["task"]).select("id", (F.col("chunk") + 1).cast("long").alias("chunk"))


def jon5(spark, sf):
    """Student and teacher paired by id, never by place."""
    ex = load(spark, sf, "examples")
    student = ex.where(F.col("shadow").isNotNull()).select(F.col("example_id").alias("sid"), F.from_json("shadow", "probabilities array<double>")["probabilities"].alias("student"))
    joined = ex.select("example_id", "teacher").join(student, F.col("example_id") == F.col("sid"))
    return joined.select("example_id", (F.size("student") == F.size("teacher")).alias("aligned"))


def jon9(spark, sf, most: int = routing.RECENT):
    """Outcomes whose request is among the recent asks."""
    log = load(spark, sf, "traffic_log").where(F.col("id").isNotNull())
    recent = routing.recent(log.where(F.col("kind") == "ask"), "log_pos", most).select(F.col("id").alias("rid")).distinct()
    return log.where(F.col("kind") == "outcome").join(recent, F.col("id") == F.col("rid"), "left_semi").select("log_pos")


def vec7(spark, sf):
    """Mean pooling of four neighbouring parts of each vector, of which the last is masked."""
    parts = F.array(*(F.slice("embedding", 16 * k + 1, 16) for k in range(4)))
    rows = load(spark, sf, "embeddings").select("vec_id", retrieval.pooled(parts, F.array(*map(F.lit, (1, 1, 1, 0))), "mean").alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("v"))


def fit18(spark, sf):
    """A head trained on soft targets: each row once a class, weighted by its target."""
    rows = load(spark, sf, "embeddings").where(F.col("label").isNotNull()).withColumnRenamed("label", "true")
    soft = rows.withColumn("target", F.transform(dist.one_hot(F.lit(10), F.col("true")), lambda x: 0.9 * x + 0.01))
    weights, bias = retrieval.fit_probe(retrieval.soft_rows(soft), 10, weight="weight")
    got = retrieval.probe(rows, weights, bias)
    return rounded(got.groupBy(F.col("true").cast("long").alias("label")).agg(F.avg((dist.argmax(F.col("p")) == F.col("true")).cast("double")).alias("accuracy"), F.avg(F.array_max("p")).alias("confidence")), 3)


def vec9(spark, sf):
    """Head inference: the probe's distribution, sharpened by the head's temperature, as a typed answer."""
    rows = load(spark, sf, "embeddings").where(F.col("label").isNotNull())
    weights, bias = retrieval.fit_probe(rows, 10)
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("string"))
    got = retrieval.probe(rows, weights, bias).withColumn("p", dist.sharpen(F.col("p"), 1.5))
    return got.select("vec_id", dist.choice_answer(names, F.col("p"))["choice"].alias("choice"))


def vec6(spark, sf):
    """A reranker's yes and no logits per option, here the logarithms of p and of 1 - p."""
    rows = facts(spark, sf)
    yes, no = (F.transform("p", lambda x: F.ln(x)), F.transform("p", lambda x: F.ln(1 - x)))
    return rows.select("id", F.posexplode(retrieval.rerank(yes, no)).alias("k", "v")).select("id", "k", F.round("v", 6).alias("v"))


def vec10(spark, sf):
    """Exported teacher distributions as typed answers of their family's question."""
    ex = load(spark, sf, "examples").select("example_id", F.lower(text.strip(F.col("family"))).alias("family"), "teacher")
    q = family_questions(spark, sf).select(F.col("family").alias("f__"), "qtype", "options", "vals")
    rows = ex.join(q, F.col("family") == F.col("f__")).where(F.size("teacher") == F.size("options"))
    answer = decide.wire_answer(F.col("qtype"), F.col("options"), F.col("vals"), F.col("teacher"))
    got = rows.select("example_id", "qtype", answer.alias("a"))
    number = lambda name: F.round(F.get_json_object("a", f"$.{name}").cast("double"), 6).alias(name)
    return got.select("example_id", "qtype", F.get_json_object("a", "$.choice").alias("choice"), number("noul"), number("score"))


def fit21(spark, sf):
    rows = load(spark, sf, "embeddings").where(F.col("label").isNotNull())
    got = retrieval.head_approach(rows.where(F.col("vec_id") % 2 == 0), rows.where(F.col("vec_id") % 2 == 1), 10)
    return rounded(got.agg(F.count(F.lit(1)).alias("n"), F.avg((dist.argmax(F.col("p")) == F.col("label")).cast("double")).alias("accuracy")), 3)


def top4(spark, sf):
    """The five best options of a distribution, best first."""
    best = F.slice(F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("s"), i.alias("i")))), 1, 5)
    rows = facts(spark, sf).select("id", "options", F.posexplode(best).alias("k", "b"))
    return rows.select("id", "k", F.get("options", F.col("b.i")).alias("option"))


def ent1(spark, sf):
    """States and their family's question through the whole pipeline, with a deterministic scorer."""
    ex = load(spark, sf, "examples").where(F.col("state").isNotNull()).select(F.col("example_id").alias("id"), F.lower(text.strip(F.col("family"))).alias("family"), "state")
    questions = family_questions(spark, sf).withColumnRenamed("qtype", "type").drop("qname")
    got = decide.decide(ex, questions, decide.keyword_scorer, decide.Calibration(permutations=2, contextual=True, temperature=1.5))
    return rounded(got.select("id", "family", "choice", "confidence", "score", "input_tokens"), 5)


def str2(spark, sf):
    """The stream of asks and outcomes; of what it sends for an id, the last row counts."""
    log = load(spark, sf, "traffic_log")
    # A pattern, since a stream of files takes no single file as its path.
    stream = spark.readStream.schema(log.schema).parquet(f"{sf}/traffic_log.parque[t]").select("log_pos", "received_at", "kind", "id", "outcomes")
    out, marks = scratch(spark, "str2"), scratch(spark, "str2-marks")
    stateful.joined_outcomes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.schema("id string, ask_pos long, outcome_pos long, outcomes string").parquet(out)
    last = sent.groupBy("id").agg(F.max(F.struct("ask_pos", F.coalesce("outcome_pos", F.lit(-1)))).alias("m"))
    return last.select("id", "m.ask_pos", F.col("m.col2").alias("outcome_pos"))


def str2_hours(spark, sf):
    """Event-time hours of the events stream. Each trigger sends the hours it changed; of an hour, the last count holds.

    Hours of the last day are counted too, which the watermark never closes by itself.
    """
    rows = load(spark, sf, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    out, marks = scratch(spark, "hours"), scratch(spark, "hours-marks")
    send = lambda sent, k: sent.write.mode("overwrite").parquet(f"{out}/trigger={k}")
    stateful.hourly_volume(stream).writeStream.foreachBatch(send).option("checkpointLocation", marks).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.schema("window struct<start:timestamp,end:timestamp>, event_type string, n long, trigger long").parquet(out)
    last = sent.groupBy("window", "event_type").agg(F.max_by("n", "trigger").alias("n"))
    return last.groupBy("event_type").agg(F.sum("n").alias("closed"))


def ent8(spark, sf):
    """Evaluation harness: every configuration of every task, raw and cross-fitted, with what tells noise from miscalibration.

    Per cell: scores, noise floor of the ECE, calibration line, interval of the temperature, and the
    three-way verdict of the cross-fitted distributions against the raw ones on the same rows.
    """
    from lumenq.operators import fit, stats

    rows = facts(spark, sf).withColumn("cell", F.concat_ws("|", "task", "config"))
    crossed = materialise(fit.cross_fit(rows, "cell").select("id", "cell", "p", "y", "n", "scaled"), "crossed")
    named = lambda frame, *columns: frame.select(F.col("cell").alias("c__"), *columns)
    conf = confidences(rows)
    gate = stats.intervals(stats.differences(crossed.withColumn("student", F.col("scaled")).withColumn("teacher", F.col("p"))), "cell")
    parts = [
        named(metrics.scores(crossed.withColumn("p", F.col("scaled")), ["cell"]), F.col("brier").alias("brier_scaled")),
        named(metrics.ece_equal_mass(conf, ["cell"]), "ece_mass"),
        named(fit.ece_floor(conf, ["cell"]), "ece_floor"),
        named(fit.calibration_line(conf, "cell"), "intercept", "slope"),
        named(fit.temperature_interval(rows, "cell"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi")),
        named(gate, stats.verdict(*map(F.col, ("brier_lo", "brier_hi", "acc_lo", "acc_hi"))).alias("verdict")),
    ]
    out = metrics.scores(rows, ["cell"]).select("cell", "n", "accuracy", "brier")
    for part in parts:
        out = out.join(part, F.col("cell") == F.col("c__")).drop("c__")
    return rounded(out, 4)


def ent8_pooled(spark, sf):
    """Cross-fitted against raw distributions, pooled over the tasks of each configuration, with splits as runs."""
    from lumenq.operators import fit, stats

    rows = facts(spark, sf).withColumn("cell", F.concat_ws("|", "task", "config"))
    crossed = stats.differences(fit.cross_fit(rows, "cell").withColumn("student", F.col("scaled")).withColumn("teacher", F.col("p")))
    return rounded(stats.pooled(materialise(crossed.select("id", "config", "split", "task", "db"), "pooled"), "config", "task", seed="split"))


def prj18(spark, sf):
    """Answers as distributions, back from the wire."""
    asks = traffic.latest_asks(load(spark, sf, "traffic_log")).select("id", F.explode(F.from_json("answers", "map<string,string>")).alias("name", "answer"))
    p = F.get_json_object("answer", "$.noul").cast("double")
    probs = F.map_values(F.from_json(F.get_json_object("answer", "$.probabilities"), "map<string,double>"))
    got = asks.select("id", "name", F.when(p.isNotNull(), F.array(p, 1 - p)).otherwise(probs).alias("v"))
    return got.select("id", "name", F.size("v").cast("long").alias("options"), F.round(dist.total(F.col("v")), 3).alias("mass"))


def top7(spark, sf, most: int = routing.RECENT):
    rows = load(spark, sf, "traffic_log").where((F.col("kind") == "ask") & F.col("id").isNotNull())
    kept = routing.recent(rows.groupBy("id").agg(F.max("log_pos").alias("log_pos")), "log_pos", most)
    return kept.select("id", "log_pos")


QUERIES = {
    "SRC1_csv": src1, "SRC3_jsonl_gz": src3, "SRC4_parquet_columns": src4, "SRC7_dispatch": src7, "SRC9_log": src9, "STR1_stream_append": str1_stream, "SRC10_prediction_files": src10, "SRC12_distributions": snk5, "SNK6_wire": snk6,
    "WIN4_equal_mass": win4, "JON5_pairing": jon5, "JON9_recent_lookup": jon9, "VEC7_pooling": vec7, "VEC6_rerank": vec6, "VEC9_head": vec9, "VEC10_typed_answer": vec10, "FIT21_head_approach": fit21, "TOP4_best": top4, "FIT18_soft_head": fit18,
    "ENT1_decide": ent1, "ENT8_rescore": ent8, "ENT8_pooled_gate": ent8_pooled, "STR2_stream_join": str2, "STR2_stream_hours": str2_hours, "PRJ18_answer_distribution": prj18, "TOP7_recent_ids": top7,
}

SQL = {
    "SRC1_csv": r"SELECT sample_id, sample_id % 2 AS file_no, length(state) AS chars FROM samples WHERE state IS NOT NULL AND label IS NOT NULL",
    "SRC3_jsonl_gz": "SELECT sample_id, task, state, label FROM samples",
    "SRC4_parquet_columns": "SELECT sample_id, task FROM samples",
    "SRC7_dispatch": "SELECT sample_id, label FROM samples",
    "SRC9_log": "SELECT kind, count(*) AS rows, count(DISTINCT id) AS ids, count(*) AS positions FROM traffic_log WHERE id IS NOT NULL AND (kind = 'ask' OR outcomes IS NOT NULL) GROUP BY kind",
    "SRC10_prediction_files": f"WITH {FACTS} SELECT task, CASE WHEN split = 'train' THEN 0 ELSE 1 END::BIGINT AS half, count(*) AS rows, round(avg(list_sum(list_transform(range(1, n + 1), lambda k: pow(p[k] - CASE WHEN k - 1 = y THEN 1 ELSE 0 END, 2)))), 6) AS brier FROM f GROUP BY 1, 2",
    "STR1_stream_append": "SELECT kind, count(*) AS rows, count(DISTINCT id) AS ids FROM traffic_log WHERE id IS NOT NULL AND (kind = 'ask' OR outcomes IS NOT NULL) GROUP BY kind",
    "SRC12_distributions": f"WITH {FACTS} SELECT count(*) AS rows, sum(y)::BIGINT AS y_sum FROM f WHERE task = 'desk routes' AND config = 'plain'",
    "SNK6_wire": f"WITH {FACTS} SELECT id, n::BIGINT AS input_tokens, 0::BIGINT AS output_tokens FROM f",
    "WIN4_equal_mass": f"WITH {FACTS} SELECT id, ntile(10) OVER (PARTITION BY task ORDER BY list_max(p), id) AS chunk FROM f",
    "JON5_pairing": "SELECT example_id, json_array_length(shadow, '$.probabilities') = len(teacher) AS aligned FROM examples WHERE shadow IS NOT NULL",
    "JON9_recent_lookup": "SELECT log_pos FROM traffic_log WHERE kind = 'outcome' AND id IN (SELECT id FROM traffic_log WHERE kind = 'ask' AND id IS NOT NULL ORDER BY log_pos DESC LIMIT 100000)",
    "VEC7_pooling": "SELECT vec_id, CAST(unnest(range(16)) AS INT) AS k, round(unnest(list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE + embedding[16 + i]::DOUBLE + embedding[32 + i]::DOUBLE) / 3)), 6) AS v FROM embeddings",
    "VEC6_rerank": f"WITH {FACTS}, o AS (SELECT id, list_transform(p, lambda x: x / (1 - x)) AS o FROM f) SELECT id, CAST(unnest(range(len(o))) AS INT) AS k, round(unnest(list_transform(o, lambda x: x / list_sum(o))), 6) AS v FROM o",
    "VEC10_typed_answer": f"""WITH {QUESTIONS}, e AS (SELECT example_id, lower(regexp_replace(family, '^\\s+|\\s+$', '', 'g')) AS family, teacher AS t FROM examples)
SELECT example_id, qtype, CASE WHEN qtype = 'choice' THEN options[list_position(t, list_max(t))] END AS choice, CASE WHEN qtype = 'noul' THEN round(t[1], 6) END AS noul,
  CASE WHEN qtype = 'score' THEN round(list_sum(list_transform(list_zip(t, vals), lambda s: s[1] * s[2])), 6) END AS score FROM e JOIN q USING (family) WHERE len(t) = len(options)""",
    "TOP4_best": f"WITH {FACTS}, s AS (SELECT id, options, list_sort(list_transform(range(1, n + 1), lambda i: {{'s': -p[i], 'i': i}}))[1:5] AS b FROM f) SELECT id, CAST(unnest(range(len(b))) AS INT) AS k, unnest(list_transform(b, lambda x: options[x.i])) AS option FROM s",
    "STR2_stream_join": "SELECT id, max(log_pos) FILTER (WHERE kind = 'ask') AS ask_pos, coalesce(max(log_pos) FILTER (WHERE kind = 'outcome'), -1) AS outcome_pos FROM traffic_log WHERE id IS NOT NULL GROUP BY id HAVING count(*) FILTER (WHERE kind = 'ask') > 0",
    "STR2_stream_hours": "SELECT event_type, count(*) AS closed FROM events WHERE ts IS NOT NULL GROUP BY event_type",
    "PRJ18_answer_distribution": f"WITH {_EX} SELECT request_id AS id, question AS name, len(teacher) AS options, round(list_sum(teacher), 3) AS mass FROM ex",
    "TOP7_recent_ids": "SELECT id, max(log_pos) AS log_pos FROM traffic_log WHERE kind = 'ask' AND id IS NOT NULL GROUP BY id ORDER BY 2 DESC LIMIT 100000",
}
