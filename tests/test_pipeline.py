import json

import pytest
from pyspark.sql import functions as F

from lumenq.operators import routing, sampling, traffic, training
from lumenq.plans import decide, model
from lumenq.sources import readers, sinks

ROUTE = {"type": "choice", "instructions": "Which team?", "criteria": ["billing", "technical", "sales"]}
URGENT = {"type": "noul", "instructions": "Urgent?"}
SEVERITY = {"type": "score", "instructions": "Severity?", "criteria": {"low": 1, "high": 5}}
LOG = "log_pos long, kind string, id string, state string, questions string, answers string, served_by string, shadow string, outcomes string"


def test_family_key_and_validation():
    key = model.parse(ROUTE).family
    assert len(key) == 16 and key == model.parse(json.loads(json.dumps(ROUTE))).family
    assert key != model.parse({**ROUTE, "criteria": ["technical", "billing", "sales"]}).family != model.parse({**ROUTE, "instructions": "Which one?"}).family
    assert model.parse(SEVERITY).wire()["criteria"] == {"low": 1.0, "high": 5.0}
    assert model.parse({**ROUTE, "criteria": {"a": "x", "b": None, "c": ""}}).wire()["criteria"] == {"a": "x", "b": None, "c": None}
    for bad in (None, {}, {"type": "choice", "instructions": "?"}, {**ROUTE, "criteria": ["one"]}, {**ROUTE, "type": "other"}, {**URGENT, "criteria": {"maybe": "x"}}, {**SEVERITY, "criteria": {"low": 1}}, {**ROUTE, "criteria": ["a", "a"]}, {**ROUTE, "instructions": ""}):
        with pytest.raises(ValueError):
            model.parse(bad)
    assert model.state_body('{"b": 1, "a": [2]}') == json.dumps({"a": [2], "b": 1}, indent=2) and model.state_body("text") == "text"


def log(spark, outcomes, served="{}"):
    answers = {"route": {"choice": "sales", "probabilities": {"billing": 0.1, "technical": 0.2, "sales": 0.7}}, "urgent": {"noul": 0.8}, "severity": {"score": 2, "probabilities": {"low": 0.75, "high": 0.25}}}
    ask = ("ask", "r1", "text", json.dumps({"route": ROUTE, "urgent": URGENT, "severity": SEVERITY}), json.dumps(answers), served, None, None)
    rows = [(1, *ask), *((k + 2, "outcome", key, None, None, None, None, None, json.dumps(o)) for k, (key, o) in enumerate(outcomes))]
    return spark.createDataFrame(rows, LOG)


def outcomes_of(frame):
    return {r.question: r.outcome for r in traffic.examples(frame).collect()}


def test_examples(spark):
    assert outcomes_of(log(spark, [])) == {"route": None, "urgent": None, "severity": None}
    assert outcomes_of(log(spark, [("r1", {"route": "technical", "urgent": False, "severity": "high"})])) == {"route": 1, "urgent": 1, "severity": 1}
    assert outcomes_of(log(spark, [("r1", {"route": "technical"}), ("r1", {"route": "sales"})]))["route"] == 2
    assert outcomes_of(log(spark, [("r1", {"route": "technical"}), ("r1", {"route": None})]))["route"] is None
    assert outcomes_of(log(spark, [("other", {"route": "technical"}), ("r1", {"what": "x"})]))["route"] is None
    wrong = log(spark, [("r1", {"route": "nobody"})])
    row = traffic.examples(wrong).where("question = 'route'").first()
    assert row.outcome is None and row.bad_outcome and row.source == "teacher" and row.teacher == [0.1, 0.2, 0.7] and row.family == model.parse(ROUTE).family
    with pytest.raises(Exception, match="none of the options"):
        traffic.examples(wrong, invalid="error").collect()
    assert traffic.examples(log(spark, []).limit(0)).count() == 0


def test_split_and_targets(spark):
    rows = spark.createDataFrame([(f"id{k}", "teacher", [0.7, 0.3], 1) for k in range(200)] + [("u", "teacher", [0.7, 0.3], None)], "request_id string, source string, teacher array<double>, outcome int")
    parts = {r.request_id: r.part for r in traffic.split(rows, 0.3).collect()}
    held = [k for k, p in parts.items() if p != "train"]
    assert len(parts) == 201 and 30 <= len(held) <= 90 and parts["u"] == "train"
    assert [round(x, 6) for x in traffic.targets(rows.limit(1), 0.5).first().target] == [0.35, 0.65]
    head = spark.createDataFrame([("a", "head:x", [0.7, 0.3], 1), ("b", "head:x", [0.7, 0.3], None)], rows.schema)
    assert traffic.targets(head.where("outcome is not null"), 0.0).first().target == [0.0, 1.0]
    assert traffic.trainable(head).count() == 1
    with pytest.raises(Exception, match="outcome only"):
        traffic.targets(head, 0.0).collect()


def brute_admit(times, rpm):
    hits, out = [], []
    for t in times:
        hits = [h for h in hits if t - h < 60]
        out.append(len(hits) < rpm)
        if out[-1]:
            hits.append(t)
    return out


def test_rate_limit(spark):
    import random

    draw = random.Random(4)
    rows, key = [], 0
    for caller in ("a", "b", None):
        t = 3500.0
        for _ in range(300):
            t += draw.choice([0.5, 5, 30, 59.9, 60, 200, 4000])
            rows.append((caller, t, key))
            key += 1
    frame = spark.createDataFrame(rows, "caller string, ts double, key long")
    got = {r["key"]: r.admitted for r in routing.rate_limit(frame, "caller", "ts", "key", 3).collect()}
    for caller in ("a", "b", None):
        own = [(t, k) for c, t, k in rows if c == caller]
        assert [got[k] for _, k in own] == brute_admit([t for t, _ in own], 3)
    folded = spark.createDataFrame([([float(t) for t in (0, 1, 2, 61, 62)],)], "t array<double>").select(routing.admit(F.col("t"), 2).alias("v")).first().v
    assert folded == [True, True, False, True, True]


def test_route(spark):
    requests = spark.createDataFrame([(1, "f", [0.525, 0.475]), (2, "f", [0.9, 0.1]), (3, "g", None)], "id long, family string, head_p array<double>")
    heads = spark.createDataFrame([("f", "head:f")], "family string, head string")
    shadows = spark.createDataFrame([("f", "shadow:f"), ("g", "shadow:g")], "family string, head string")
    got = {r.id: (r.served_by, r.shadow) for r in routing.route(requests, heads, shadows, 0.2).collect()}
    assert got == {1: ("teacher", None), 2: ("head:f", None), 3: ("teacher", "shadow:g")}
    with pytest.raises(Exception, match="two heads"):
        routing.one_head_per_family(heads.union(heads)).collect()


def test_decide_properties(spark):
    states = spark.createDataFrame([(k, "f", f"state {k} about sales") for k in range(3)], "id long, family string, state string")
    questions = spark.createDataFrame([("f", "choice", "Which team?", ["billing", "technical", "sales"], [None] * 3, None)], "family string, type string, instructions string, options array<string>, descriptions array<string>, vals array<double>")
    biased = decide.decide(states, questions, decide.biased_scorer([5.0]), decide.Calibration(permutations=3)).first()
    assert biased.p == pytest.approx([1 / 3] * 3, abs=1e-9)
    blind = decide.decide(states, questions, decide.biased_scorer([4.0, 1.0]), decide.Calibration(contextual=True)).first()
    assert blind.p == pytest.approx([1 / 3] * 3, abs=1e-9)
    for t in (0.5, 1.0, 4.0):
        assert decide.decide(states, questions, decide.keyword_scorer, decide.Calibration(temperature=t)).first().choice == "sales"
    with pytest.raises(ValueError, match="not a calibration"):
        decide.Calibration(temperature=0)


def test_sampling(spark):
    rows = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(30)], "id long, label string")
    drawn = sampling.balanced(rows, "label", 4, "id", strict=True)
    assert sorted(r.label for r in drawn.collect()) == ["a"] * 4 + ["b"] * 4
    assert {r.id for r in drawn.collect()} == {r.id for r in sampling.balanced(rows.repartition(7), "label", 4, "id").collect()}
    with pytest.raises(ValueError, match="not enough"):
        sampling.balanced(rows, "label", 11, "id", strict=True)
    halves = [r.half for r in sampling.alternate(rows, "label", "id", 5).where("label = 'b'").orderBy("id").collect()]
    assert halves == ["train", "test"] * 5


def test_training_rows(spark):
    labels = [f"l{k}" for k in range(20)]
    samples = spark.createDataFrame([(k, "s", "text", labels[k % 20], 0.3) for k in range(400)], "id long, source string, state string, label string, soft double")
    listed = F.array(*map(F.lit, labels))
    choice = training.choice_rows(samples, listed, ["q"]).collect()
    assert all(r.target[r.options.index(r.label)] == 1 and sum(r.target) == 1 and len(set(r.options)) == len(r.options) and 3 <= len(r.options) <= 12 for r in choice)
    assert {r.options.index(r.label) for r in choice} >= set(range(8))
    yes = [r.target[0] for r in training.noul_rows(samples, listed, ["Is it {x}?"]).collect()]
    assert 0.4 < sum(yes) / 400 < 0.6
    scored = training.score_rows(samples, listed, ["q"], "directional", 1.0).collect()
    assert all(r.options in (labels, labels[::-1]) and max(r.target) == r.target[r.options.index(r.label)] for r in scored)
    built = training.build(samples, listed, ["q"], ["Is it {x}?"])
    nulls = [r for r in built.collect() if r.is_null]
    assert nulls and all(r.state == "N/A" and r.target == pytest.approx([1 / len(r.options)] * len(r.options)) for r in nulls)


def test_readers_and_sinks(spark, tmp_path):
    path = str(tmp_path / "log")
    assert readers.read_log(spark, path).count() == 0
    ask = sinks.new_ask("text", {"route": ROUTE}, {}, "m")
    sinks.append_log(sinks.ask_lines(spark.createDataFrame([ask], "id string, ts double, caller string, model string, state string, questions string, answers string")), path)
    report = spark.createDataFrame([(ask["id"], 1.0, '{"route": "sales"}')], "id string, ts double, outcomes string")
    sinks.append_log(sinks.outcome_lines(report), path)
    back = readers.read_log(spark, path)
    assert sorted(r.kind for r in back.collect()) == ["ask", "outcome"]
    with pytest.raises(Exception, match="names its outcomes"):
        sinks.outcome_lines(report.withColumn("outcomes", F.lit("{}"))).collect()
    (tmp_path / "data.json").write_text('{"test": [["hi", "greet"], ["pay", "bill"]], "train": []}')
    (tmp_path / "domains.json").write_text('{"small_talk": ["greet"], "money": ["bill"]}')
    rows = readers.read_domains(spark, str(tmp_path / "data.json"), str(tmp_path / "domains.json")).collect()
    assert sorted((r.text, r.domain) for r in rows) == [("hi", "small talk"), ("pay", "money")]
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines, ""quoted"""\n')
    assert readers.read_any(spark, str(tmp_path / "a.csv")).first().y == 'two\nlines, "quoted"'
    heads = spark.createDataFrame([(model.parse(ROUTE).family, json.dumps(ROUTE), 1, True), ("wrong", json.dumps(ROUTE), 1, False)], "family string, question string, version int, promoted boolean")
    sinks.save_heads(heads.limit(1), str(tmp_path / "good"))
    assert sinks.load_heads(spark, str(tmp_path / "good")).count() == 1
    sinks.save_heads(heads, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="doesn't fit"):
        sinks.load_heads(spark, str(tmp_path / "bad")).collect()
    assert sinks.markdown(spark.createDataFrame([("t", 0.5)], "task string, x double")).splitlines()[2] == "| t | 0.500 |"


def test_stream_equals_batch(spark, tmp_path):
    from lumenq.streaming import stateful

    rows = spark.createDataFrame([("a", float(t), k) for k, t in enumerate([0, 1, 2, 61, 62, 63, 200])] + [("b", 5.0, 100)], "caller string, ts double, key long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stateful.rate_limited(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["key"]: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["key"]: r.admitted for r in routing.rate_limit(rows, "caller", "ts", "key", 2).collect()}
