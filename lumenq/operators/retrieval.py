"""Vector retrieval over closed option sets: ranking, shortlists, centroids, a linear probe."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.functions import dist
from lumenq.session import materialise

#: Options (vectors) up to which they travel with the plan; a question's options are at most 255, a catalogue may have more.
BROADCAST_OPTIONS = 4_096


def unit(v: Column) -> Column:
    return dist.let(F.transform(v, lambda x: x.cast("double")), lambda d: dist.let(F.sqrt(dist.dot(d, d)), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean of the vectors of each label, of length one. Means are taken place by place, map-side first."""
    parts = vectors.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("k", "x")).groupBy(label, "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gathered = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centroid"))
    return gathered.withColumn("centroid", unit(F.col("centroid")))


def rank(queries: DataFrame, options: DataFrame, key: str, vector: str = "embedding", broadcast_options: int = BROADCAST_OPTIONS) -> DataFrame:
    """``scores`` of every query over the options (``idx``, ``option``, ``centroid``), in option order.

    Options become one array column of the plan, so nothing is crossed or shuffled and the
    products of a batch are one matrix product; they are the labels of a question, and more than
    ``broadcast_options`` are an error. ``best`` ranks over any number.
    """
    listed = options.select("idx", "option", "centroid").orderBy("idx").limit(broadcast_options + 1).collect()
    if len(listed) > broadcast_options:
        raise ValueError(f"more than {broadcast_options} options; take the best of them by blocks")
    return _scored(queries, listed, vector, "scores")


def best(queries: DataFrame, options: DataFrame, k: int, vector: str = "embedding", broadcast_options: int = BROADCAST_OPTIONS) -> DataFrame:
    """``best`` of every query: its ``k`` options of the largest scores (``score``, ``idx``), best first, ties by place.

    Options are taken in blocks of ``broadcast_options`` by ``idx``; a query keeps ``k`` of what it had
    and a block's, so its row stays small whatever the number of options.
    """
    held = materialise(options.select("idx", "centroid"), "options")
    ends = held.agg(F.min("idx"), F.max("idx")).first()
    out = queries.withColumn("best", F.array().cast("array<struct<score:double,idx:bigint>>"))
    for begin in range(ends[0], ends[1] + 1, broadcast_options) if ends[0] is not None else ():
        listed = held.where((F.col("idx") >= begin) & (F.col("idx") < begin + broadcast_options)).orderBy("idx").collect()
        if listed:
            places = F.array(*(F.lit(int(r.idx)) for r in listed))
            found = F.transform("scores__", lambda s, i: F.struct(s.alias("score"), F.get(places, i).cast("bigint").alias("idx")))
            both = F.array_sort(F.transform(F.concat("best", found), lambda x: F.struct((-x["score"]).alias("m"), x["idx"].alias("i"))))
            top = F.transform(F.slice(both, 1, k), lambda x: F.struct((-x["m"]).alias("score"), x["i"].alias("idx")))
            out = _scored(out, listed, vector, "scores__").withColumn("best", top).drop("scores__")
    return out


def _scored(queries: DataFrame, listed: list, vector: str, name: str) -> DataFrame:
    table = np.array([r.centroid for r in listed], float)

    def product(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack([np.asarray(v, float) for v in vectors]) @ table.T))

    product.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return queries.withColumn(name, F.pandas_udf(product, "array<double>")(vector))


def shortlist(scores: Column, k: int) -> Column:
    """Places of the ``k`` best scores (ties: the earlier one), in their original order."""
    if k < 1:
        raise ValueError("a shortlist has one entry or more")
    best = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(best, F.lit(1), F.lit(k)), lambda x: x["i"]))


def narrow(type_: Column, options: Column, scores: Column, above: int, k: int) -> Column:
    """The options that are scored: a long choice is cut to its shortlist, any other question stays whole."""
    cut = (type_ == "choice") & (F.size(options) > above) & (F.size(options) > k)
    return F.when(cut, F.transform(shortlist(scores, k), lambda i: F.get(options, i))).otherwise(options)


def recall_at(rows: DataFrame, by: list[str], scores: str, place: str, k: int) -> DataFrame:
    hit = F.array_contains(shortlist(F.col(scores), k), F.col(place).cast("int"))
    return rows.groupBy(*by).agg(F.avg(hit.cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def fit_probe(vectors: DataFrame, classes: int, label: str = "label", vector: str = "embedding", scale: float = 20.0, l2: float = 1e-3, weight: str | None = None):
    """Multinomial logistic regression on unit vectors, fitted by distributed L-BFGS.

    The logits are ``scale`` times the product, and the penalty is ``l2`` on the unscaled
    weights; on scaled features that is a penalty of ``2 l2 / scale**2``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    frame = vectors.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double") * scale)).alias("features"), *([F.col(weight).alias("weight")] if weight else []))
    made = LogisticRegression(family="multinomial", regParam=2 * l2 / scale**2, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9, **({"weightCol": "weight"} if weight else {}))
    model = made.fit(frame)
    w = np.array(model.coefficientMatrix.toArray())[:classes] * scale
    return w, np.array(model.interceptVector.toArray())[:classes]


def probe(vectors: DataFrame, weights: np.ndarray, bias: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``p``: softmax of the probe's logits."""

    def score(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        z = np.stack([np.asarray(v, float) for v in batch]) @ weights.T + bias
        e = np.exp(z - z.max(1, keepdims=True))
        return pd.Series(list(e / e.sum(1, keepdims=True)))

    score.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return vectors.withColumn("p", F.pandas_udf(score, "array<double>")(vector))


def soft_rows(rows: DataFrame, target: str = "target") -> DataFrame:
    """Each row once per class with its target mass as ``weight``: soft labels for a weighted fit."""
    return rows.select("*", F.posexplode(target).alias("label", "weight")).where(F.col("weight") > 0)


def pooled(tokens: Column, mask: Column, mode: str) -> Column:
    """One vector from token vectors: the first, the last unmasked, or the mean of the unmasked ones."""
    n = dist.total(F.transform(mask, lambda m: m.cast("double")))
    if mode == "cls":
        return tokens[0]
    if mode == "last":
        return F.get(tokens, n.cast("int") - 1)
    if mode == "mean":
        kept = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m))
        return F.transform(F.aggregate(kept, F.transform(tokens[0], lambda _: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)), lambda x: x / n)
    raise ValueError(f"no such pooling: {mode}")


def rerank(yes: Column, no: Column) -> Column:
    """Distribution over options from a reranker's yes and no logits of each."""
    return dist.softmax(F.zip_with(yes, no, lambda a, b: a - b))


def head_approach(pool: DataFrame, held: DataFrame, classes: int, label: str = "label", vector: str = "embedding", floor: float = 0.005) -> DataFrame:
    """A probe trained on the pool, its temperature fitted there, applied to the held-out rows: ``p`` of each."""
    from lumenq.operators import fit

    weights, bias = fit_probe(pool, classes, label, vector)
    scored = probe(pool, weights, bias, vector).select(F.lit("head").alias("task"), "p", F.col(label).cast("int").alias("y"))
    fitted = fit.head_temperature(fit.diagnose(scored, "task", floor=floor)).select("temperature").first().temperature
    return probe(held, weights, bias, vector).withColumn("p", dist.sharpen(F.col("p"), fitted, floor))
