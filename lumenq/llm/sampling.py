"""Samples whose category shares match targets: swap repair on signature counts."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one category are spread over so many hash buckets; only the bucket of the cut is ranked.
BUCKETS = 4096


def clean_label(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(label, "_", " "), r"^\s+|\s+$", "")))


def swap_repair(signatures: list[tuple], have: list[int], target: list[dict], floor: list[dict], size: int, seed: int = 0) -> list[int]:
    """How many rows of each signature to take.

    A signature is the categories of a record, one for each dimension; ``have`` counts its records.
    ``target`` and ``floor`` give, for each dimension, the share and the least number of rows of
    each category. Starts from a random sample of ``size`` rows that satisfies the floors as far as
    there are rows, then exchanges rows of one signature for as many of another, each time the
    exchange that lowers the summed squared deviation from the targets most, until none lowers
    it. Only counts are exchanged, so the work depends on the number of signatures, not of rows.
    """
    n, draw = len(have), random.Random(seed)
    have_ = np.array(have, np.int64)
    size = min(size, int(have_.sum()))
    places = [{c: k for k, c in enumerate(dict.fromkeys([s[d] for s in signatures]))} for d in range(len(target))]
    # One column per category of a dimension.
    member = np.concatenate([np.array([[p[s[d]] == k for k in range(len(p))] for s in signatures], np.int64).reshape(n, len(p)) for d, p in enumerate(places)], axis=1)
    share = np.array([target[d].get(c, 0.0) for d, p in enumerate(places) for c in p])
    least = np.minimum([floor[d].get(c, 0) for d, p in enumerate(places) for c in p], have_ @ member)
    take = np.zeros(n, np.int64)
    for c in sorted(range(len(least)), key=lambda c: int(have_ @ member[:, c])):
        own = [k for k in range(n) if member[k, c]]
        draw.shuffle(own)
        for k in own:
            take[k] += max(0, min(have_[k] - take[k], least[c] - take @ member[:, c]))
    left = max(0, size - int(take.sum()))
    while left > 0:
        room = have_ - take
        spread = np.minimum(room, [int(left * r / room.sum() + draw.random()) for r in room])
        if not spread.any():
            spread[draw.choice(np.flatnonzero(room).tolist())] = 1
        for k in sorted(range(n), key=lambda _: draw.random()):
            step = min(int(spread[k]), left)
            take[k] += step
            left -= step
    want = share * max(size, int(take.sum()))
    apart_in = (member @ member.T) if n else np.zeros((0, 0), np.int64)
    # Categories in which two signatures differ, counted on both sides.
    differ = 2 * (len(target) - apart_in)
    while n:
        counts = take @ member
        gap = member @ (counts - want)
        spare = np.minimum(take, np.where(member > 0, counts - least, take.sum()).min(axis=1))
        # A category that both signatures have doesn't shrink in the exchange.
        keeps = np.array([[np.where((member[a] > 0) & (member[b] == 0), counts - least, take[a]).min() if a != b else 0 for b in range(n)] for a in range(n)]) if len(target) > 1 else np.repeat(spare[:, None], n, axis=1)
        most = np.minimum(np.minimum(take[:, None], keeps), (have_ - take)[None, :])
        pull = gap[:, None] - gap[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.clip(np.round(np.where(differ > 0, pull / np.maximum(differ, 1), 0)), 0, most).astype(np.int64)
        step = np.where((step == 0) & (pull > 0) & (most > 0), 1, step)
        change = -2.0 * step * pull + step.astype(float) ** 2 * differ
        a, b = np.unravel_index(int(change.argmin()), change.shape)
        if change[a, b] >= -1e-9:
            break
        take[a] -= step[a, b]
        take[b] += step[a, b]
    return take.tolist()


def _distinct(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("labelled_id").isNotNull()).groupBy("labelled_id").agg(F.first("source", True).alias("source"), clean_label(F.first("label", True)).alias("label_key"))


def plan(labelled: DataFrame, sources: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """One row per target: what is there, what is taken, and whether the target is met.

    ``labelled`` (``labelled_id``, ``source``, ``label``): a row delivered twice counts once;
    labels are compared trimmed, lower-cased and with ``_`` as a space; null and unknown labels
    belong to no target. ``sources`` gives ``per_class`` and the labels, so that a sample has
    ``per_class`` times the number of labels rows; ``targets`` gives ``target_pct`` and
    ``min_rows``. Columns: ``source_name``, ``label``, ``target_pct``, ``min_rows``, ``size``,
    ``have``, ``take``, ``met``, ``cause``. A target is ``met`` if the repaired sample holds its
    floor, and its share of the asked-for size to less than one row. Else ``cause`` says why:
    ``rows`` (fewer rows exist than its share or floor), ``floors`` (its own or another label's floor
    goes before the shares) or ``others`` (other labels lack rows). Counts are aggregated map-side;
    a source's few counts are repaired in a task of their own. No rows, or no targets, give
    ``take`` 0, or an empty plan.
    """
    have = _distinct(labelled).groupBy("source", "label_key").agg(F.count(F.lit(1)).alias("have"))
    size = sources.select(F.col("source_name").alias("sn"), (F.col("per_class") * F.size("label_list")).cast("long").alias("size"))
    wanted = targets.select("source_name", "label", "target_pct", "min_rows", clean_label(F.col("label")).alias("lk")).join(size, F.col("source_name") == F.col("sn"))
    counted = wanted.join(have, (F.col("source_name") == F.col("source")) & (F.col("lk") == F.col("label_key")), "left").select(
        "source_name", "label", F.col("lk").alias("label_key"), F.coalesce("target_pct", F.lit(0)).cast("long").alias("target_pct"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("min_rows"), "size", F.coalesce("have", F.lit(0)).cast("long").alias("have")
    )

    def repair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("label_key", kind="stable")
        total = max(1, int(group.target_pct.sum()))
        keys = group.label_key.tolist()
        shares, floors = dict(zip(keys, group.target_pct / total, strict=True)), dict(zip(keys, group.min_rows, strict=True))
        group["take"] = swap_repair([(k,) for k in keys], group.have.tolist(), [shares], [floors], int(group["size"].iloc[0]), seed)
        return group

    schema = "source_name string, label string, label_key string, target_pct long, min_rows long, size long, have long, take long"
    planned = counted.groupBy("source_name").applyInPandas(repair, schema)
    met = (F.col("take") >= F.col("min_rows")) & (F.abs(F.col("take") * 100 - F.col("target_pct") * F.col("size")) < 100)
    short = (F.col("have") * 100 < F.col("target_pct") * F.col("size")) | (F.col("have") < F.col("min_rows"))
    every = Window.partitionBy("source_name")
    floors = F.max((F.col("min_rows") * 100 > F.col("target_pct") * F.col("size")).cast("int")).over(every) == 1
    cause = F.when(short, "rows").when(met, None).when(floors, "floors").otherwise("others")
    return planned.withColumn("met", met & ~short).withColumn("cause", cause)


def draw(labelled: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """(``source``, ``label_key``, ``labelled_id``): the rows of the plan, drawn at random by hash.

    A category's rows are counted by hash bucket; whole buckets are taken while they fit and
    only the bucket in which the cut falls is ranked, so no task ever sorts a whole category.
    """
    rows = _distinct(labelled).withColumn("u", F.xxhash64(F.lit(seed), "labelled_id")).withColumn("bucket", F.pmod("u", F.lit(BUCKETS)))
    takes = planned.where(F.col("take") > 0).select(F.col("source_name").alias("source"), "label_key", "take")
    rows = rows.join(takes, ["source", "label_key"])
    counts = rows.groupBy("source", "label_key", "bucket", "take").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source", "label_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most BUCKETS rows a category.
    cuts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < F.col("take")).select("source", "label_key", "bucket", (F.col("take") - F.col("before")).alias("left"), "n")
    picked = rows.drop("take").join(cuts, ["source", "label_key", "bucket"])
    whole = picked.where(F.col("n") <= F.col("left"))
    rank = F.row_number().over(Window.partitionBy("source", "label_key", "bucket").orderBy("u", "labelled_id"))
    part = picked.where(F.col("n") > F.col("left")).withColumn("r", rank).where(F.col("r") <= F.col("left"))
    columns = ["source", "label_key", "labelled_id"]
    return whole.select(columns).unionByName(part.select(columns))


def unmet(planned: DataFrame) -> DataFrame:
    """The targets that the repaired sample couldn't meet because rows of the label are missing."""
    return planned.where(~F.col("met") & (F.col("cause") == "rows")).select("source_name", "label")
