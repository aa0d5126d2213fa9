"""Resampling weights that depend on (seed, row, resample) only, and sums under them in flat memory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks over which the rows of one group are spread at most.
SALTS = 16
#: Rows that are weighted at a time.
BLOCK = 1024


def _poisson_table() -> np.ndarray:
    """How often a row is drawn, by 16 random bits: quantiles of the Poisson distribution with mean 1."""
    share = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(share, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


_TABLE = _poisson_table()


def row_hash(seed: int, key: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), key)


def times(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row (by its 64-bit hash) is drawn in each resample; one mixed word serves four of them."""
    steps = (np.arange(-(-resamples // 4), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = hashes.view(np.uint64)[:, None] + steps
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return _TABLE[x.view(np.uint16).reshape(len(hashes), -1)[:, :resamples]]


def spread(rows: DataFrame, by: list[str], h: str) -> DataFrame:
    """Rows dealt out so that a group lies in at most SALTS tasks, and a task holds a group's rows side by side."""
    salted = rows.withColumn("salt__", F.pmod(h, F.lit(SALTS)))
    return salted.repartition(*by, "salt__").sortWithinPartitions(*by).drop("salt__")


def resampled(rows: DataFrame, by: list[str], values: list[str], resamples: int, h: str = "h") -> DataFrame:
    """``by`` and, for each of ``values``, the list ``mean_<value>`` of its means in all resamples.

    Each row counts Poisson(1) times in each resample, by its hash ``h``, so that a resample needs no
    order, no size of the group and no second pass; rows of equal hash are drawn together. A task
    holds one group's running sums, whatever the number of rows. A resample in which no row was
    drawn has no mean (null), as have all those of a group without rows.
    """
    kinds = dict(rows.dtypes)
    lists = ", ".join(f"s{k} array<double>" for k in range(len(values) + 1))
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        sums = np.zeros((len(values) + 1, resamples))

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*held, *sums)], columns=[*by, *(f"s{k}" for k in range(len(values) + 1))])

        for b in batches:
            for key, part in b.groupby(by, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != held:
                    if held is not None:
                        yield out()
                    held, sums = key, np.zeros_like(sums)
                numbers = np.vstack([np.ones(len(part)), *(part[v].to_numpy(float) for v in values)])
                hashes = part[h].to_numpy()
                for k in range(0, len(part), BLOCK):
                    sums += numbers[:, k : k + BLOCK] @ times(hashes[k : k + BLOCK], resamples).astype(float)
        if held is not None:
            yield out()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = [np.sum(np.stack(group[f"s{k}"].tolist()), axis=0) for k in range(len(values) + 1)]
        with np.errstate(invalid="ignore", divide="ignore"):
            means = [[None if math.isnan(x) else x for x in (s / total[0]).tolist()] for s in total[1:]]
        return pd.DataFrame([(*(group[c].iloc[0] for c in by), *means)], columns=[*by, *(f"mean_{v}" for v in values)])

    narrow = spread(rows.select(*by, h, *values), by, h)
    summed = narrow.mapInPandas(add, f"{keys}, {lists}")
    return summed.groupBy(*by).applyInPandas(merge, f"{keys}, " + ", ".join(f"mean_{v} array<double>" for v in values))


def quantile(means: Column, share: float, interpolated: bool) -> Column:
    """A quantile of a list: between its two neighbours in order, or the one below it."""
    ordered = F.array_sort(F.array_compact(means))
    place = F.lit(share) * (F.size(ordered) - 1)
    below = F.get(ordered, F.floor(place).cast("int"))
    if not interpolated:
        return below
    above = F.get(ordered, F.ceil(place).cast("int"))
    return below + (above - below) * (place - F.floor(place))
