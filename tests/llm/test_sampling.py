from lumenq.llm import sampling

LABELLED = "labelled_id long, source string, state string, label string, soft double, take int"


def tables(spark, rows, per_class=2, targets=(("s", "a b", 50, 1), ("s", "c", 50, 1))):
    return (
        spark.createDataFrame(rows, LABELLED),
        spark.createDataFrame([("s", "d", "choice", ["a b", "c"], per_class, "l")], "source_name string, dataset string, shape string, label_list array<string>, per_class int, license string"),
        spark.createDataFrame(list(targets), "source_name string, label string, target_pct int, min_rows int"),
    )


def repair(have, shares, floors, size, seed=0):
    return sampling.swap_repair([(k,) for k in range(len(have))], have, [dict(enumerate(shares))], [dict(enumerate(floors))], size, seed)


def test_swap_repair():
    assert repair([100, 100], [0.3, 0.7], [0, 0], 10) == [3, 7]
    assert repair([100, 2], [0.3, 0.7], [0, 0], 10) == [8, 2]
    assert repair([100, 100, 100], [0.5, 0.5, 0.0], [0, 0, 4], 20) == [8, 8, 4]
    assert repair([0, 0], [0.5, 0.5], [1, 1], 5) == [0, 0]
    assert repair([5], [1.0], [0], 3) == [3]
    assert repair([1000] * 3, [0.9, 0.05, 0.05], [0, 40, 40], 100) == [20, 40, 40]
    assert repair([], [], [], 5) == []
    for seed in range(50):
        take = repair([1000, 500, 40, 7], [0.4, 0.3, 0.2, 0.1], [5, 5, 5, 5], 200, seed)
        assert sum(take) == 200 and take[2] == 40 and take[3] == 7


def test_signatures_of_two_categories():
    """Label and language at once: both shares are met by exchanging counts of their combinations."""
    signatures = [(a, b) for a in "xyz" for b in ("de", "en")]
    for seed in range(20):
        take = sampling.swap_repair(signatures, [500, 40, 60, 300, 20, 30], [{"x": 0.5, "y": 0.3, "z": 0.2}, {"de": 0.6, "en": 0.4}], [{"z": 10}, {}], 200, seed)
        by = lambda d, c: sum(t for s, t in zip(signatures, take, strict=True) if s[d] == c)
        assert sum(take) == 200 and [by(0, c) for c in "xyz"] == [100, 60, 40] and by(1, "de") == 120


def test_met_compares_what_is_taken(spark):
    rows = [(k, "s", "x", "ab"[k % 2], None, 0) for k in range(2000)] + [(5000 + k, "s", "x", "c", None, 0) for k in range(1000)]
    labelled = spark.createDataFrame(rows, LABELLED)
    sources = spark.createDataFrame([("s", ["a", "b", "c", "d"], 25)], "source_name string, label_list array<string>, per_class int")
    targets = spark.createDataFrame([("s", "a", 90, 0), ("s", "b", 5, 40), ("s", "c", 5, 40)], "source_name string, label string, target_pct int, min_rows int")
    planned = sampling.plan(labelled, sources, targets)
    assert {r.label: (r["take"], r.met, r.cause) for r in planned.collect()} == {"a": (20, False, "floors"), "b": (40, False, "floors"), "c": (40, False, "floors")}
    assert sampling.unmet(planned).count() == 0


def test_plan_and_draw(spark):
    rows = [(k, "s", "x", "A_b ", None, 0) for k in range(20)] + [(100, "s", "x", "c", None, 0)] * 2 + [(200, "s", None, None, None, 0), (201, None, None, "c", None, 0), (202, "s", "x", "unknown", None, 0)]
    labelled, sources, targets = tables(spark, rows)
    planned = sampling.plan(labelled, sources, targets)
    got = {r.label: (r.have, r["take"], r.met, r.cause) for r in planned.collect()}
    assert got == {"a b": (20, 3, False, "others"), "c": (1, 1, False, "rows")}
    assert [r.label for r in sampling.unmet(planned).collect()] == ["c"]
    drawn = sampling.draw(labelled, planned).collect()
    assert len(drawn) == len({r.labelled_id for r in drawn}) == 4
    assert sorted(r.label_key for r in drawn) == ["a b"] * 3 + ["c"]


def test_cut_inside_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKETS", 2)
    labelled, sources, targets = tables(spark, [(k, "s", "x", "a b", None, 0) for k in range(200)], 20)
    assert sampling.draw(labelled, sampling.plan(labelled, sources, targets)).count() == 40


def test_empty(spark):
    labelled, sources, targets = tables(spark, [])
    planned = sampling.plan(labelled, sources, targets)
    assert {r["take"] for r in planned.collect()} == {0} and sampling.draw(labelled, planned).count() == 0
