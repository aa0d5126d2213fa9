import math

import pytest
from pyspark.sql import functions as F

from lumenq.functions import dist, text
from lumenq.operators import retrieval


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1).coalesce(1)


def value(one, column):
    return one.select(column.alias("v")).first()["v"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def ints(*xs):
    return F.array(*(F.lit(x) for x in xs))


def test_rotations_and_unpermute(one):
    assert value(one, dist.rotations(F.lit(3), 99)) == [[0, 1, 2], [1, 2, 0], [2, 0, 1]]
    assert value(one, dist.rotations(F.lit(3), 0)) == [[0, 1, 2]]
    assert value(one, dist.unpermute(arr(0.7, 0.2, 0.1), ints(2, 0, 1))) == [0.2, 0.1, 0.7]
    with pytest.raises(Exception, match="at least one"):
        value(one, dist.rotations(F.lit(0), 1))


def test_average(one):
    assert value(one, dist.average(F.array(arr(0.8, 0.2), arr(0.2, 0.8)))) == [0.5, 0.5]
    assert value(one, dist.average(F.array(arr(0, 0), arr(0, 0)))) == [0.5, 0.5]
    with pytest.raises(Exception, match="ragged"):
        value(one, dist.average(F.array(arr(1), arr(0.5, 0.5))))


def test_rotations_remove_position_bias(one):
    orderings = dist.rotations(F.lit(3), 3)
    got = value(one, dist.combine(F.array(*[arr(5, 0, 0)] * 3), orderings))
    assert got == pytest.approx([1 / 3] * 3, abs=1e-9)


def test_state_blind_scorer_is_uniform_after_debiasing(one):
    p = dist.softmax(arr(4, 1, 0))
    assert value(one, dist.debias(p, p)) == pytest.approx([1 / 3] * 3, abs=1e-9)
    with pytest.raises(Exception, match="null prior"):
        value(one, dist.debias(p, arr(0, 0, 0)))


def test_sharpen(one):
    p = arr(0.7, 0.3, 0.0)
    assert value(one, dist.sharpen(p, 1.0)) == [0.7, 0.3, 0.0]
    for t in (0.5, 3.0, 20.0):
        got = value(one, dist.sharpen(p, t, 0.005))
        raw = [max(x, 0.005) / 1.005 for x in (0.7, 0.3, 0.0)]
        powered = [x ** (1 / t) for x in raw]
        assert got == pytest.approx([x / sum(powered) for x in powered], abs=1e-12)
        assert max(range(3), key=got.__getitem__) == 0
    with pytest.raises(ValueError, match="positive"):
        dist.sharpen(p, 0)


def test_pool_and_floor(one):
    p, q = arr(0.9, 0.1), arr(0.5, 0.5)
    assert value(one, dist.pool(p, q, 0)) == [0.9, 0.1] and value(one, dist.pool(p, q, 1)) == [0.5, 0.5]
    assert value(one, dist.pool(p, q, 0.5)) == pytest.approx([0.75, 0.25])
    assert value(one, dist.floored(arr(1, 0), 0)) == [1.0, 0.0]


def test_confidence(one):
    p = arr(0.5, 0.3, 0.2)
    assert value(one, dist.confidence(p, "margin")) == pytest.approx(0.2)
    assert value(one, dist.confidence(p, "normalized_max")) == pytest.approx(0.25)
    assert value(one, dist.confidence(arr(1), "entropy")) == 1 and value(one, dist.confidence(arr(1), "margin")) == 1
    assert value(one, dist.confidence(arr(0.25, 0.25, 0.25, 0.25), "entropy")) == pytest.approx(0)


def test_ties_go_to_the_first(one):
    assert value(one, dist.argmax(arr(0.4, 0.4, 0.2))) == 0
    assert value(one, retrieval.shortlist(arr(0.5, 0.5, 0.5), 2)) == [0, 1]
    assert value(one, retrieval.shortlist(arr(0.1, 0.9, 0.5, 0.7), 2)) == [1, 3]
    with pytest.raises(ValueError, match="one entry"):
        retrieval.shortlist(arr(1), 0)


def test_targets_and_scores(one):
    assert value(one, dist.sord(F.lit(1), F.lit(3), 0)) == [0, 1, 0]
    w = [math.exp(-1), 1, math.exp(-1)]
    assert value(one, dist.sord(F.lit(1), F.lit(3), 1.0)) == pytest.approx([x / sum(w) for x in w])
    assert value(one, dist.rps(arr(1, 0, 0), F.lit(2))) == 1
    assert value(one, dist.brier(arr(0.9, 0.1), F.lit(0))) == pytest.approx(0.02)
    assert value(one, dist.unimodal_hinge(arr(0.1, 0.6, 0.2, 0.4), arr(0, 1, 0, 0))) == pytest.approx(0.2)


def test_null_in_null_out(one):
    nothing = F.lit(None).cast("array<double>")
    for column in (dist.softmax(nothing), dist.sharpen(nothing, 2.0), dist.confidence(nothing, "margin"), dist.normalise(nothing)):
        assert value(one, column) is None


def test_tokens(one):
    a = ints(1, 2, 3)
    assert value(one, text.shared_prefix_length(a, F.array(ints(1, 2, 3, 9), ints(1, 2, 3, 8, 7)))) == 3
    assert value(one, text.shared_prefix_length(a, F.array(ints(1, 2, 99, 9), ints(1, 2, 99, 8)))) == 2
    with pytest.raises(Exception, match="early"):
        value(one, text.shared_prefix_length(a, F.array(ints(1, 9), ints(1, 9))))
    assert value(one, text.match_length(a, a)) == 3 and value(one, text.match_length(a, F.array().cast("array<int>"))) == 0


def test_labels(one):
    options = F.array(F.lit("a"), F.lit("b"))
    assert [tuple(x) for x in value(one, text.labels(options))] == [("a", "A", " A", 65), ("b", "B", " B", 66)]
    for bad, message in ((F.array(F.lit("a"), F.lit("a")), "differ"), (F.array(*(F.lit(str(k)) for k in range(27))), "letters")):
        with pytest.raises(Exception, match=message):
            value(one, text.labels(bad))
    with pytest.raises(Exception, match="share a token"):
        value(one, text.labels(options, ints(7, 7)))
    with pytest.raises(Exception, match="permutation"):
        value(one, text.in_order(options, ints(0, 0)))
