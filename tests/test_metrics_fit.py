import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq.operators import fit, metrics, ranks, stats

SCHEMA = "id long, task string, options array<string>, p array<double>, y int, n int"


def facts(spark, rows, task="t"):
    return spark.createDataFrame([(k, task, [str(j) for j in range(len(p))], [float(x) for x in p], y, len(p)) for k, (p, y) in enumerate(rows)], SCHEMA)


OVER = [((0.95, 0.05), 0)] * 60 + [((0.95, 0.05), 1)] * 40
WELL = [((0.8, 0.2), 0)] * 80 + [((0.8, 0.2), 1)] * 20


def test_overconfident(spark):
    rows = facts(spark, OVER)
    got = metrics.report(rows, ["task"]).first()
    assert got["count"] == 100 and got.ece == pytest.approx(0.35) and got.accuracy == pytest.approx(0.6)
    fitted = fit.diagnose(rows, "task").first()
    assert fitted.temperature > 1 and fitted.trustworthy and fitted.nll_after < fitted.nll_before
    after = metrics.report(rows, ["task"], temperature=fitted.temperature).first()
    assert after.ece < 0.05 and after.accuracy == got.accuracy


def test_well_calibrated(spark):
    rows = facts(spark, WELL)
    assert metrics.report(rows, ["task"]).first().ece == pytest.approx(0)
    assert metrics.report(rows, ["task"], confidence="margin").first().ece == pytest.approx(0.2)
    assert fit.diagnose(rows, "task").first().temperature == pytest.approx(1, abs=0.05)


def test_untrustworthy_fits(spark):
    always = fit.diagnose(facts(spark, [((0.6, 0.4), 0)] * 50), "task", (0.05, 20.0)).first()
    assert always.at_bound and not always.trustworthy
    separable = fit.diagnose(facts(spark, [((0.7, 0.3), 0), ((0.2, 0.8), 1)]), "task").first()
    assert separable.separable and not separable.trustworthy
    zero = fit.diagnose(facts(spark, [((0.99, 0.01, 0), 0)] * 40 + [((0.99, 0.01, 0), 2)] * 4), "task", floor=0.005).first()
    assert not zero.at_bound and zero.temperature > 1


def _nll(z, y, t):
    v = z / t
    return (np.log(np.exp(v - v.max(1, keepdims=True)).sum(1)) + v.max(1) - v[np.arange(len(y)), y]).mean()


def test_temperature_is_the_minimum(spark):
    draw = np.random.default_rng(1)
    rows = [(p, int(draw.choice(4, p=p))) for p in draw.dirichlet([0.7] * 4, 300)]
    got = fit.fit_temperature(fit.logits(facts(spark, rows), True), "task", (0.05, 20.0)).first().temperature
    z, y = np.log([p for p, _ in rows]), np.array([k for _, k in rows])
    grid = got * np.exp(np.linspace(-0.01, 0.01, 2001))
    assert grid[np.argmin([_nll(z, y, t) for t in grid])] == pytest.approx(got, rel=2e-5) and got == pytest.approx(1, abs=0.2)


def test_temperature_interval_is_that_of_a_plain_bootstrap(spark):
    draw = np.random.default_rng(2)
    rows = [(p, int(draw.choice(3, p=p))) for p in draw.dirichlet([0.7] * 3, 400)]
    got = fit.temperature_interval(facts(spark, rows), "task", 200).first()
    z, y = np.log([p for p, _ in rows]), np.array([k for _, k in rows])
    grid = np.exp(np.linspace(np.log(0.5), np.log(2), 141))
    each = np.stack([np.log(np.exp(z / t).sum(1)) - z[np.arange(len(y)), y] / t for t in grid], 1)
    plain = [grid[np.argmin(each[draw.integers(0, len(y), len(y))].sum(0))] for _ in range(600)]
    assert got.lo == pytest.approx(np.percentile(plain, 2.5), abs=0.05) and got.hi == pytest.approx(np.percentile(plain, 97.5), abs=0.07)


def test_resampling_is_the_same_in_any_partitioning(spark):
    draw = np.random.default_rng(7)
    rows = facts(spark, [(p, int(draw.choice(3, p=p))) for p in draw.dirichlet([0.7] * 3, 200)])
    one, many = (fit.temperature_interval(x, "task", 40).first() for x in (rows.coalesce(1), rows.repartition(7)))
    assert one.lo == pytest.approx(many.lo, rel=1e-9) and one.hi == pytest.approx(many.hi, rel=1e-9)


def test_calibration_line(spark):
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.7] * 4, 3000)
    y = [int(draw.choice(4, p=x)) for x in p]
    sharp = p ** (1 / 0.4)
    sharp /= sharp.sum(1, keepdims=True)
    for table, low, high in ((p, 0.85, 1.15), (sharp, 0.0, 0.6)):
        rows = metrics.correctness(facts(spark, list(zip(table, y, strict=True))))
        got = fit.calibration_line(rows, "task").first()
        assert low < got.slope < high
        # The penalised loss is flat there, over all rows.
        c = np.clip(table.max(1), 1e-4, 1 - 1e-4)
        x, t = np.log(c / (1 - c)), (table.argmax(1) == y).astype(float)
        m = 1 / (1 + np.exp(-(got.intercept + got.slope * x)))
        assert (t - m).sum() - got.intercept == pytest.approx(0, abs=1e-3) and ((t - m) * x).sum() - (got.slope - 1) == pytest.approx(0, abs=1e-3)


def test_bins_and_curve(spark):
    rows = spark.createDataFrame([(0, "t", 0.05, 1.0), (1, "t", 0.95, 1.0), (2, "t", 0.96, 0.0), (3, "t", 1.0, 1.0)], "id long, task string, conf double, correct double")
    bins = {r.bin: r["count"] for r in metrics.reliability(rows, ["task"]).collect()}
    assert len(bins) == 10 and bins[0] == 1 and bins[9] == 3 and sum(bins.values()) == 4
    edges = spark.createDataFrame([(0.3,), (0.6,)], "c double").select(metrics.bin_of(F.col("c"), 10).alias("b"))
    assert [r.b for r in edges.collect()] == [int(0.3 / 0.1), int(0.6 / 0.1)]
    curve = {r.threshold: (r.coverage, r.accuracy) for r in metrics.selective(rows, ["task"], [0.0, 0.5, 1.1]).collect()}
    assert curve[0.0] == (1.0, 0.75) and curve[0.5] == (0.75, pytest.approx(2 / 3)) and curve[1.1] == (0.0, None)


def test_labels_are_checked(spark):
    with pytest.raises(Exception, match="isn't one of the options"):
        metrics.report(facts(spark, [((0.5, 0.5), 2)]), ["task"]).collect()


def test_spread_row_number(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice(["a", "a", "b", None]), draw.random()) for k in range(500)]
    frame = spark.createDataFrame(rows, "id long, g string, x double")
    got = {r.id: (r.rn, r.size) for r in ranks.spread_row_number(frame, ["g"], F.floor(F.col("x") * 16), [F.col("x"), F.col("id")], "rn", "size").collect()}
    for name in ("a", "b", None):
        own = sorted((x, k) for k, g, x in rows if g == name)
        assert [got[k] for _, k in own] == [(n + 1, len(own)) for n in range(len(own))]


def test_equal_mass_chunks_are_those_of_array_split(spark):
    rows = spark.createDataFrame([(k, "t", k / 100, 1.0) for k in range(23)], "id long, task string, conf double, correct double")
    got = {}
    for r in metrics.equal_mass(rows, ["task"]).collect():
        got.setdefault(r.chunk, []).append(r.id)
    assert [sorted(got[c]) for c in sorted(got)] == [list(x) for x in np.array_split(range(23), 10)]


PAIR = "id long, family string, student array<double>, teacher array<double>, y int"


def gate(spark, rows, **policy):
    frame = spark.createDataFrame([(k, "f", [float(x) for x in s], [float(x) for x in t], y) for k, (s, t, y) in enumerate(rows)], PAIR)
    return stats.compare(frame, "family", stats.GatePolicy(**{"resamples": 300, **policy})).first()


def test_gate(spark):
    better = gate(spark, [((0.9, 0.1), (0.6, 0.4), 0)] * 60)
    assert better.promoted and better.brier_hi < 0 and better.reasons == ["ok"]
    few = gate(spark, [((0.9, 0.1), (0.6, 0.4), 0)] * 10)
    assert not few.promoted and few.reasons[0].startswith("too few held out, 10 of 30")
    hedged = gate(spark, [((0.55, 0.45), (0.95, 0.05), 0)] * 40 + [((0.45, 0.55), (0.95, 0.05), 0)] * 10 + [((0.45, 0.55), (0.05, 0.95), 0)] * 10)
    assert not hedged.promoted and (hedged.teacher_only_right, hedged.student_only_right) == (10, 0)
    same = gate(spark, [((0.7, 0.3), (0.7, 0.3), k % 2) for k in range(60)])
    assert same.promoted
    none = gate(spark, [((0.7, 0.3), (0.7, 0.3), None)])
    assert not none.promoted and none.reasons == ["nothing was held out"]


def test_intervals_are_those_of_a_plain_bootstrap(spark):
    draw = np.random.default_rng(5)
    values = draw.normal(0.1, 1, (500, 2))
    rows = spark.createDataFrame([(k, "g", float(a), float(b)) for k, (a, b) in enumerate(values)] + [(k, None, 0.5, 0.0) for k in range(3)], "id long, g string, db double, da double")
    got = {r.g: r for r in stats.intervals(rows, "g", stats.GatePolicy(), "interpolated").collect()}
    plain = np.percentile(values[draw.integers(0, 500, (4000, 500))].mean(1), [2.5, 97.5], axis=0)
    r = got["g"]
    assert np.allclose([[r.brier_lo, r.acc_lo], [r.brier_hi, r.acc_hi]], plain, atol=0.012)
    assert (got[None].brier_lo, got[None].brier_hi, got[None].acc_lo) == (0.5, 0.5, 0.0)
    picked = stats.intervals(rows.where("g is not null"), "g").first()
    assert picked.brier_lo == pytest.approx(r.brier_lo, abs=0.003)


def test_pooled_over_tasks_and_runs(spark):
    draw = np.random.default_rng(6)
    rows = [(n, "c", s, t, float(draw.normal(0.1 * s + 0.02 * t, 0.3))) for n, (s, t) in enumerate((s, t) for s in range(3) for t in range(4) for _ in range(100))]
    frame = spark.createDataFrame(rows, "id long, config string, seed int, task int, db double")
    flat, deep = stats.pooled(frame, "config", "task").first(), stats.pooled(frame, "config", "task", seed="seed").first()
    means = np.array([[np.mean([r[4] for r in rows if r[2] == s and r[3] == t]) for t in range(4)] for s in range(3)])
    assert flat.point == pytest.approx(means.mean()) == pytest.approx(deep.point)
    # Runs differ by 0.1: drawing them widens the interval to nearly that of the run alone.
    assert flat.hi - flat.lo == pytest.approx(2 * 1.96 * 0.3 / np.sqrt(1200), abs=0.006) and deep.hi - deep.lo > 0.12


def test_verdict(spark):
    cases = [(-0.03, 0.01, -0.01, 0.05), (0.03, 0.08, -0.01, 0.05), (-0.01, 0.01, -0.10, -0.03), (-0.04, 0.06, -0.05, 0.05)]
    frame = spark.createDataFrame(cases, "a double, b double, c double, d double").coalesce(1)
    got = [r.v for r in frame.select(stats.verdict(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("v")).collect()]
    assert got == ["PASS", "FAIL", "FAIL", "INCONCLUSIVE"]
