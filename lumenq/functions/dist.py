"""Distribution algebra as Column expressions: one row in, one row out, nothing shuffled.

A distribution is an ARRAY<DOUBLE> aligned with the options of its question. Arguments are
Columns; ``temperature``, ``floor``, ``weight`` are numbers of the plan. Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mass below which a prior's probability isn't divided by.
TINY = 1e-12
#: Zero floor of fits and of their application; the two must be the same.
FLOOR = 1e-6
CONFIDENCES = ("margin", "max_prob", "entropy", "normalized_max")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def uniform(n: Column) -> Column:
    return F.array_repeat(F.lit(1.0) / n, n.cast("int"))


def normalise(p: Column) -> Column:
    """Shares of the total; uniform if there is no mass."""
    return let(p, lambda v: let(total(v), lambda t: F.when(t > 0, F.transform(v, lambda x: x / t)).otherwise(uniform(F.size(v)))))


def argmax(p: Column) -> Column:
    """0-based index of the largest value; the first one of equals."""
    return let(p, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    return let(logits, lambda z: let(F.array_max(z), lambda top: normalise(F.transform(z, lambda x: F.exp((x - top) / t)))))


def log_softmax(logits: Column, ids: Column | None = None) -> Column:
    """Log-softmax over all logits, or over those at the 0-based ``ids`` (negative ids are padding, left out)."""
    z = logits if ids is None else F.transform(F.filter(ids, lambda i: i >= 0), lambda i: F.get(logits, i))
    return let(z, lambda v: let(F.array_max(v), lambda top: let(F.ln(total(F.transform(v, lambda x: F.exp(x - top)))), lambda lse: F.transform(v, lambda x: x - top - lse))))


def rotations(n: Column, k: int | Column) -> Column:
    """The first ``k`` rotations of 0 .. n-1, at least one and at most ``n``."""
    many = F.greatest(F.lit(1), F.least(F.lit(k) if isinstance(k, int) else k, n))
    checked = F.when(n < 1, F.raise_error(F.lit("a question has at least one option")).cast("int")).otherwise(n)
    return F.transform(F.sequence(F.lit(0), many - 1), lambda r: F.transform(F.sequence(F.lit(0), checked - 1), lambda i: ((i + r) % n).cast("int")))


def permute(p: Column, ordering: Column) -> Column:
    return F.transform(ordering, lambda i: F.get(p, i))


def unpermute(p: Column, ordering: Column) -> Column:
    """Undo ``permute``; lengths must agree."""
    bad = F.raise_error(F.lit("a distribution and its ordering differ in length")).cast("array<double>")

    def undo(v: Column) -> Column:
        placed = F.transform(F.sequence(F.lit(0), F.size(ordering) - 1), lambda j: F.get(v, (F.array_position(ordering, j) - 1).cast("int")))
        return F.when(F.size(v) != F.size(ordering), bad).otherwise(placed)

    return let(p, undo)


def average(dists: Column) -> Column:
    """Mean of an array of distributions, renormalised; ragged or empty input is an error."""
    bad = F.raise_error(F.lit("distributions to average are ragged or none")).cast("array<double>")

    def mean(v: Column) -> Column:
        first = F.get(v, F.lit(0))
        ragged = (F.size(v) < 1) | F.exists(v, lambda d: F.size(d) != F.size(first))
        return F.when(ragged, bad).otherwise(F.aggregate(v, F.transform(first, lambda _: F.lit(0.0)), lambda acc, d: F.zip_with(acc, d, lambda x, y: x + y)))

    return normalise(let(dists, mean))


def combine(logits: Column, orderings: Column, temperature: float = 1.0) -> Column:
    """Softmax of each ordering's logits, back in the declared order, averaged."""
    return average(F.zip_with(logits, orderings, lambda z, o: unpermute(softmax(z, temperature), o)))


def debias(p: Column, prior: Column) -> Column:
    """Divide by a null prior and renormalise; a prior without mass is an error."""
    bad = F.raise_error(F.lit("a null prior has mass")).cast("array<double>")
    return let(prior, lambda q: F.when(total(q) <= 0, bad).otherwise(normalise(F.zip_with(p, q, lambda a, b: a / F.greatest(b, F.lit(TINY))))))


def pool(p: Column, q: Column, weight: float) -> Column:
    """Log-linear pool of two distributions; weights 0 and 1 give one of them unchanged."""
    if weight == 0:
        return p
    if weight == 1:
        return q
    log = lambda x: F.ln(F.greatest(x, F.lit(TINY)))
    return softmax(F.zip_with(p, q, lambda a, b: (1 - weight) * log(a) + weight * log(b)))


def floored(p: Column, floor: float = FLOOR) -> Column:
    return p if floor <= 0 else normalise(F.transform(p, lambda x: F.greatest(x, F.lit(floor))))


def sharpen(p: Column, temperature: float | Column, floor: float = FLOOR) -> Column:
    """Apply a temperature to a distribution; exactly the identity at 1."""
    if isinstance(temperature, Column):
        power = normalise(F.transform(floored(p, floor), lambda x: F.pow(x, 1 / temperature)))
        return F.when(temperature == 1, p).when(temperature <= 0, F.raise_error(F.lit("a temperature is positive")).cast("array<double>")).otherwise(power)
    if temperature <= 0:
        raise ValueError("a temperature is positive")
    if temperature == 1:
        return p
    return normalise(F.transform(floored(p, floor), lambda x: F.pow(x, F.lit(1 / temperature))))


def scale(p: Column, temperature: float | Column) -> Column:
    """The evaluation harness's temperature: clipped, not renormalised, also at 1."""
    return softmax(F.transform(p, lambda x: F.ln(F.least(F.greatest(x, F.lit(FLOOR)), F.lit(1.0)))), temperature)


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def confidence(p: Column, kind: str = "max_prob") -> Column:
    if kind == "max_prob":
        return F.array_max(p)
    if kind in ("entropy", "normalized_max"):
        return let(p, lambda v: _spread(v, kind))
    if kind == "margin":
        return let(F.array_sort(p, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), lambda s: F.when(F.size(s) > 1, s[0] - F.get(s, F.lit(1))).otherwise(s[0]))
    raise ValueError(f"no such confidence: {kind}")


def _spread(p: Column, kind: str) -> Column:
    n = F.size(p)
    if kind == "entropy":
        return F.when(n < 2, 1.0).otherwise(1 - entropy(p) / F.ln(n.cast("double")))
    return F.when(n < 2, 1.0).otherwise(F.greatest(F.lit(0.0), (n * F.array_max(p) - 1) / (n - 1)))


def expectation(p: Column, values: Column) -> Column:
    """Position on an ordered scale; one band alone is an error."""
    return F.when(F.size(values) < 2, F.raise_error(F.lit("a scale has two bands or more")).cast("double")).otherwise(dot(p, values))


def choice_answer(options: Column, p: Column, kind: str = "margin") -> Column:
    checked = F.when(F.size(options) != F.size(p), F.raise_error(F.lit("options and probabilities differ in length")).cast("int")).otherwise(argmax(p))
    return F.struct(F.get(options, checked).alias("choice"), F.map_from_arrays(options, p).alias("probabilities"), confidence(p, kind).alias("confidence"))


def noul_answer(p: Column) -> Column:
    return p[0]


def score_answer(options: Column, p: Column, values: Column, kind: str = "margin") -> Column:
    return F.struct(expectation(p, values).alias("score"), F.map_from_arrays(options, values).alias("legend"), F.map_from_arrays(options, p).alias("probabilities"), confidence(p, kind).alias("confidence"))


def expand(full: Column, kept: Column, p: Column) -> Column:
    """Probabilities over all options; those that were cut get exactly 0."""
    return let(p, lambda v: F.transform(full, lambda o: F.coalesce(F.get(v, (F.array_position(kept, o) - 1).cast("int")), F.lit(0.0))))


def one_hot(n: Column, y: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == y, 1.0).otherwise(0.0))


def cumulated(p: Column) -> Column:
    return let(p, lambda v: F.transform(F.sequence(F.lit(1), F.size(v)), lambda k: total(F.slice(v, F.lit(1), k))))


def brier(p: Column, y: Column) -> Column:
    """Sum over the options of squared errors."""
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), F.lit(2.0))))


def nll(p: Column, y: Column, floor: float = FLOOR) -> Column:
    """Minus the logarithm of the clipped probability of the true option."""
    return -F.ln(F.least(F.greatest(F.get(p, y), F.lit(floor)), F.lit(1.0)))


def nll_of_logits(z: Column, y: Column, temperature: float = 1.0) -> Column:
    return let(F.transform(z, lambda x: x / temperature), lambda v: let(F.array_max(v), lambda top: F.ln(total(F.transform(v, lambda x: F.exp(x - top)))) + top - F.get(v, y)))


def cross_entropy(target: Column, p: Column) -> Column:
    """Log score of a soft target; options without target mass don't count."""
    return -total(F.zip_with(target, p, lambda t, x: F.when(t > 0, t * F.ln(F.greatest(x, F.lit(TINY)))).otherwise(0.0)))


def rps(p: Column, y: Column) -> Column:
    """Ranked probability score of an ordered scale, over the number of steps."""
    apart = lambda c: F.transform(c, lambda x, i: F.pow(x - F.when(i >= y, 1.0).otherwise(0.0), F.lit(2.0)))
    return total(apart(cumulated(p))) / F.greatest(F.size(p) - 1, F.lit(1))


def unimodal_hinge(p: Column, target: Column) -> Column:
    """Summed size of the adjacent steps that slope away from the target's peak."""
    steps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: b - a)
    return let(argmax(target), lambda peak: total(F.transform(steps, lambda d, i: F.greatest(F.lit(0.0), F.when(i < peak, -d).otherwise(d)))))


def sord(y: Column, n: Column, alpha: float) -> Column:
    """Soft ordinal target: mass falls off exponentially with the distance; one-hot without ``alpha``."""
    if alpha <= 0:
        return one_hot(n, y)
    return normalise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.exp(-alpha * F.abs(i - y).cast("double"))))


def by_value(p: Column, values: Column) -> Column:
    """The distribution in the natural order of its scale."""
    return F.transform(F.array_sort(F.arrays_zip(values.alias("v"), F.sequence(F.lit(0), F.size(values) - 1).alias("i"))), lambda s: F.get(p, s["1"]))


def null_distribution(n: Column) -> Column:
    return uniform(n)
