import itertools
import random

import numpy as np

from lumenq.llm import overlap

SCHEMA = "sample_id long, task string, split string, state string, label string, words string, key string"


def brute(rows, least):
    words = {r[0]: set(overlap._WORD.findall(r[3].lower())) for r in rows if r[3] is not None and r[2] is not None}
    train = {r[0] for r in rows if r[2] is not None and r[2].strip().lower() == "train"}
    return {(e, t) for e, t in itertools.product(words.keys() - train, words.keys() & train) if words[e] | words[t] and len(words[e] & words[t]) / len(words[e] | words[t]) >= least}


def test_samples_against_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 5, 9, 30, 45]))] for _ in range(40)]
    rows = []
    for k in range(300):
        words = list(draw.choice(base))
        for _ in range(draw.randrange(1 + len(words) // 5 + 1)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        if draw.random() < 0.5:
            draw.shuffle(words)
        rows.append((k, "t", draw.choice(["train", " Train", "TEST", "validation ", None]), draw.choice([" ", ", "]).join(words).title(), None, "x", "y"))
    rows += [(900, "t", "train", "same text here", None, "x", "y"), (901, "t", "test", "Here! text SAME", None, "x", "y"), (902, "t", "test", None, None, "x", "y"), (903, "t", "test", "...", None, "x", "y"), (904, "t", "test", "long word " * 20_000, None, "x", "y")]
    samples = spark.createDataFrame(rows, SCHEMA)
    got = {(r.eval_id, r.train_id) for r in overlap.sample_pairs(samples).collect()}
    assert got == brute(rows, 0.7)
    assert (901, 900) in got
    links = {r.eval_id: (r.links, r.words, r.covered) for r in overlap.sample_links(samples).collect()}
    assert {e: n for e, (n, _, _) in links.items()} == {e: sum(x == e for x, _ in got) for e, _ in got}
    words = {r[0]: len(set(overlap._WORD.findall((r[3] or "").lower()))) for r in rows}
    assert all(w == words[e] and 0 < c <= w for e, (_, w, c) in links.items()) and links[901][2] >= 2


def test_hot_beginnings_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_ROWS", 7)
    monkeypatch.setattr(overlap, "SHARD_HELD", 5)
    rows = [(k, "t", "train" if k % 3 else "test", f"the same long house phrase of ten words and number {k % 50}", None, "x", "y") for k in range(200)]
    samples = spark.createDataFrame(rows, SCHEMA)
    assert {(r.eval_id, r.train_id) for r in overlap.sample_pairs(samples).collect()} == brute(rows, 0.7)


def test_passages_are_disjoint_and_enough():
    draw = np.random.default_rng(0)
    for n in range(1, 80):
        words, cost = np.sort(draw.integers(0, 1 << 54, n)), draw.exponential(size=n) + 0.01
        need = overlap.differences(n, 0.7) + 1
        spans = sorted(overlap.passages(words, cost, need))
        assert len(spans) == min(need, n)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans)) and all(b <= e - 1 and e - b <= overlap.LONGEST for b, e in spans)


def test_predictions(spark):
    schema = "pred_id long, task string, split string, config string, probabilities map<string,double>, label string, p string"
    p = {"A_b": 0.3, "c": 0.7}
    rows = [
        (1, "t", "train", "x", p, "c", "z"),
        (2, "t", "Test ", "x", {"c ": 0.700001, "a b": 0.299999}, " C", "z"),
        (3, "t", "test", "x", {"c": 0.70001, "a b": 0.29999}, "c", "z"),
        (4, "t", "test", "x", p, "a b", "z"),
        (5, "u", "test", "x", p, "c", "z"),
        (6, "t", "test", "x", p, None, "z"),
        (7, "t", "test", "x", None, "c", "z"),
        (8, "t", "test", "x", {}, "c", "z"),
        (9, "t", "test", "x", {"c": 0.700002, "a b": 0.300002}, "c", "z"),
        (10, "t", "test", "x", {"c": None, "a b": 0.3}, "c", "z"),
        (11, "t", "test", "x", {"c": 0.7}, "c", "z"),
        (12, "t", "train", "x", {"c": 1.0}, "c", "z"),
        (13, "t", "test", "x", {"c": 1.0}, "c", "z"),
    ]
    predictions = spark.createDataFrame(rows, schema)
    got = sorted((r.eval_id, r.train_id) for r in overlap.prediction_pairs(predictions).collect())
    assert got == [(2, 1), (9, 1), (13, 12)]


def test_predictions_against_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for k in range(1500):
        base = draw.randrange(40) * 0.013
        rows.append((k, "t", draw.choice(["train", "test"]), "x", {"a": 0.1 + draw.randrange(-20, 20) * 1e-7, "b": base + draw.randrange(-20, 20) * 1e-7, "c": 0.2}, "a", "z"))
    predictions = spark.createDataFrame(rows, "pred_id long, task string, split string, config string, probabilities map<string,double>, label string, p string")
    want = {(e[0], t[0]) for e in rows if e[2] == "test" for t in rows if t[2] == "train" if all(abs(e[4][o] - t[4][o]) <= 0.000002 * (1 + 1e-9) for o in "abc")}
    assert {(r.eval_id, r.train_id) for r in overlap.prediction_pairs(predictions).collect()} == want


def test_empty(spark):
    assert overlap.sample_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_few_unlike_records_are_looked_at(monkeypatch):
    # Records of one vocabulary: what is followed beyond a passage's first words must not grow with all pairs of records.
    draw = np.random.default_rng(1)
    n, size = 3000, 45
    records = np.stack([np.sort(draw.choice(1500, size, replace=False)) for _ in range(n)]).astype(np.uint32)
    texts = records.copy()
    texts[:, :4] += 10_000
    texts.sort(axis=1)
    at = np.arange(n + 1) * size
    followed = []
    held = overlap._Automaton._held
    monkeypatch.setattr(overlap._Automaton, "_held", staticmethod(lambda words, begin, each, *rest: followed.append(len(each)) or held(words, begin, each, *rest)))
    got = {(int(a), int(b)) for x, y, _ in overlap._Automaton(records.ravel(), at, 0.7).read(texts.ravel(), at) for a, b in zip(x, y, strict=True)}
    assert {(k, k) for k in range(n)} <= got
    assert sum(followed) < n * n / 100


def test_long_records_and_other_similarities(spark):
    draw = random.Random(3)
    long = [[f"w{k}x" for k in range(begin, begin + 2500)] for begin in (0, 300, 2000)]
    rows = [(k, "t", "train" if k % 2 else "test", " ".join(draw.sample(words, len(words) - k)), None, "x", "y") for k, words in enumerate(long * 4)]
    rows += [(100 + k, "t", "train" if k % 2 else "test", " ".join(draw.sample([f"v{j}" for j in range(14)], draw.randrange(1, 10))), None, "x", "y") for k in range(120)]
    samples = spark.createDataFrame(rows, SCHEMA)
    for least in (0.4, 0.7, 1.0):
        assert {(r.eval_id, r.train_id) for r in overlap.sample_pairs(samples, least).collect()} == brute(rows, least)
