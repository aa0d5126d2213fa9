"""The whole ask: shown states, shortlists, label checks, usage; log order, mixtures, blocks of steps."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenq.functions import text
from lumenq.operators import routing, traffic, training
from lumenq.plans import decide, model
from lumenq.sources import readers, sinks

Q = "family string, type string, instructions string, options array<string>, descriptions array<string>, vals array<double>"
STATES = "id long, family string, state string"


def words_ranker(state, lines, task):
    return [float(sum(w in state.lower().split() for w in line.lower().split())) for line in lines]


def questions(spark, n=20):
    options = [f"topic {k}" for k in range(n)]
    return spark.createDataFrame([("long", "choice", "Which?", options, [None] * n, None), ("yes", "noul", "Is it?", ["yes", "no"], [None, None], None)], Q)


def test_long_choices_are_cut_to_their_shortlist(spark):
    states = spark.createDataFrame([(1, "long", "this is about 17 please"), (2, "yes", "yes")], STATES)
    calls = []
    got = {r.id: r for r in decide.decide(states, questions(spark), decide.keyword_scorer, decide.Calibration(contextual=True), ranker=words_ranker, above=12, keep=4).collect()}
    assert len(got[1].options) == len(got[1].p) == 20 and sum(p > 0 for p in got[1].p) == 4 and got[1].choice == "topic 17"
    assert len(got[2].p) == 2 and not calls
    whole = decide.decide(states, questions(spark), decide.keyword_scorer, ranker=words_ranker, above=30, keep=4).where("id = 1").first()
    assert sum(p > 0 for p in whole.p) == 20


def test_usage_counts_prefix_once_and_every_branch(spark):
    state = '{"b": 1, "a": "x y"}'
    got = decide.decide(spark.createDataFrame([(1, "yes", state)], STATES), questions(spark), decide.keyword_scorer, decide.Calibration(permutations=2)).first()
    shown = text.PREFIX + model.state_body(state) + text.PREFIX_END
    branches = [text.QUESTION + "Is it?\n" + "\n".join(f"{c}) {o}" for c, o in zip("AB", order, strict=True)) + text.QUESTION_END for order in (("yes", "no"), ("no", "yes"))]
    import re

    assert got.input_tokens == sum(len(re.findall(r" ?\S+|\s", t)) for t in (shown, *branches))


def test_models_must_encode_letters_alike(spark):
    own, other = (spark.createDataFrame(rows, "letter string, ids array<int>") for rows in ([("A", [1]), ("B", [2])], [("A", [1]), ("B", [3])]))
    states = spark.createDataFrame([(1, "yes", "x")], STATES)
    pooled = decide.Calibration(basecal=0.5)
    with pytest.raises(model.SeamError):
        decide.decide(states, questions(spark), decide.keyword_scorer, pooled, decide.keyword_scorer, letters=(own, other))
    with pytest.raises(ValueError):
        decide.decide(states, questions(spark), decide.keyword_scorer, pooled)
    even = decide.decide(states, questions(spark), decide.biased_scorer([2.0, 0.0]), pooled, decide.biased_scorer([0.0, 2.0]), letters=(own, own)).first()
    assert even.p == pytest.approx([0.5, 0.5])


def test_each_model_has_its_own_prior(spark):
    states = spark.createDataFrame([(1, "yes", "x")], STATES)
    got = decide.decide(states, questions(spark), decide.biased_scorer([3.0, 0.0]), decide.Calibration(contextual=True, basecal=0.5), decide.biased_scorer([0.0, 1.0])).first()
    assert got.p == pytest.approx([0.5, 0.5])


def test_verify(spark):
    rows = questions(spark).withColumn("prefix", F.lit("s"))
    same = decide.verify(rows, decide.keyword_scorer, decide.keyword_scorer, 1e-9).collect()
    assert all(r.equal and r.apart == 0 for r in same)
    off = decide.verify(rows, decide.biased_scorer([1.0]), decide.biased_scorer([0.0]), 0.01).collect()
    assert not any(r.equal for r in off)


def test_appends_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(4):
        rows = [(f"r{j}", float(k), json.dumps({"route": f"{k}"})) for j in range(50)]
        frame = spark.createDataFrame(rows, "id string, ts double, outcomes string")
        sinks.append_log(sinks.outcome_lines(frame.repartition(1 + k % 3)), path)
    back = readers.read_log(spark, path)
    positions = [r.log_pos for r in back.orderBy("log_pos").collect()]
    assert positions == list(range(200))
    assert [r.ts for r in back.orderBy("log_pos").collect()] == [float(k) for k in range(4) for _ in range(50)]
    assert {r.raw for r in traffic.latest_outcomes(back).collect()} == {"3"}


def test_families_come_in_the_order_of_the_log(spark):
    wire = lambda instructions: json.dumps({"type": "noul", "instructions": instructions})
    rows = [(7, "z", {"b": "First?"}), (8, "a", {"a": "First?"}), (9, "b", {"c": "Second?"})]
    frame = spark.createDataFrame(
        [(p, "ask", i, "s", json.dumps({n: json.loads(wire(q)) for n, q in asked.items()}), json.dumps({n: {"noul": 0.5} for n in asked}), "{}", "{}", None) for p, i, asked in rows],
        "log_pos long, kind string, id string, state string, questions string, answers string, served_by string, shadow string, outcomes string",
    )
    got = [(r.question, r.type, r.instructions, r.asks, r.first_pos) for r in traffic.families(traffic.examples(frame)).orderBy("first_pos").collect()]
    assert got == [("b", "noul", "First?", 2, 7), ("c", "noul", "Second?", 1, 9)]


def test_mixture_is_balanced(spark):
    rows = [(k, "c", f"t{k}", "a" if k < 900 else "b", None) for k in range(1000)] + [(2000 + k, "s", f"u{k}", ["1", "2", "3"][k % 3], None) for k in range(90)] + [(4000 + k, "p", f"v{k}", "x", k / 1000) for k in range(1000)]
    samples = spark.createDataFrame(rows, "id long, source string, state string, label string, soft double")
    sources = [
        {"name": "c", "shape": "choice", "labels": ["a", "b"], "per_class": 40, "wordings": ["?"], "about": ["{x}?"]},
        {"name": "s", "shape": "score", "labels": ["1", "2", "3"], "per_class": 20, "wordings": ["?"], "collapse": {"1": "low", "2": "low", "3": "high"}},
        {"name": "p", "shape": "soft_noul", "labels": [], "per_class": 10, "wordings": ["?"]},
    ]
    made = training.mixture(samples, sources, scale=0.5).where("not is_null").collect()
    of = lambda name: [r for r in made if r.source == name]
    label = {r[0]: r[3] for r in rows}
    assert sorted(label[r.id] for r in of("c")) == ["a"] * 20 + ["b"] * 20
    full, coarse = ([r for r in of("s") if len(r.options) == n] for n in (3, 2))
    assert len(full) == 30 and len(coarse) == 20
    tenths = [min(9, int(next(x[4] for x in rows if x[0] == r.id) * 10)) for r in of("p")]
    assert sorted(tenths) == sorted(list(range(10)) * 5)
    with pytest.raises(ValueError, match="shaped 'odd'"):
        training.mixture(samples, [{**sources[0], "shape": "odd"}])


def test_trailing_means_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(routing, "BLOCK_STEPS", 7)
    draw = random.Random(1)
    rows = [("k", k, draw.random()) for k in range(60)]
    got = {r.n: (r.trailing, r.step) for r in routing.trailing_mean(spark.createDataFrame(rows, "key string, n long, x double"), ["key"], "n", "x", 5).collect()}
    for k in range(60):
        own = [x for _, _, x in rows[max(0, k - 4) : k + 1]]
        assert got[k] == (pytest.approx(sum(own) / len(own)), k + 1)


def test_jobs_over_a_log(spark, tmp_path, capsys):
    from lumenq.__main__ import main

    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    question = {"type": "choice", "instructions": "Which?", "criteria": ["a", "b"]}
    shadow = {"q": json.dumps({"head": "h", "version": 2, "probabilities": [0.6, 0.4]})}
    asks = [(f"r{k}", float(k), "c", "m", f"s{k}", json.dumps({"q": question}), json.dumps({"q": {"choice": "a", "probabilities": {"a": 0.7, "b": 0.3}}}), "{}", json.dumps(shadow)) for k in range(40)]
    sinks.append_log(sinks.ask_lines(spark.createDataFrame(asks, "id string, ts double, caller string, model string, state string, questions string, answers string, served_by string, shadow string")), path)
    reports = [(f"r{k}", 100.0 + k, json.dumps({"q": "ab"[k % 2]})) for k in range(30)]
    sinks.append_log(sinks.outcome_lines(spark.createDataFrame(reports, "id string, ts double, outcomes string")), path)
    main(["train", "--log", path, "--holdout", "0.3", "--out", out])
    rows = spark.read.parquet(out).collect()
    parts = {r.part for r in rows}
    assert len(rows) == 40 and parts == {"train", "temperature", "evaluation"} and all(abs(sum(r.target) - 1) < 1e-9 for r in rows)
    main(["shadow", "--log", path, "--head", "h", "--version", "2", "--write", str(tmp_path / "pairs")])
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 30
    main(["families", "--log", path])
    assert "Which?" in capsys.readouterr().out
