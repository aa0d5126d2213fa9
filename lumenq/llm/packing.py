"""Packing texts into containers of fixed capacity: best two fit."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePath

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.functions.tokens import VOCABULARY, encoder
from lumenq.session import materialise, task_count

#: Items that are packed together, about; a task packs one such lot after the other.
LOT_ITEMS = 8_192


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every text that has a token; whole texts are encoded.

    The vocabulary file (a few MB) is read on the driver's machine and sent to the workers.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = PurePath(vocabulary).name

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": np.array([len(encode(t)) for t in b.text], np.int64)})

    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    return texts.mapInPandas(count, "doc_id long, n_tokens long")


class _Stock:
    """Unpacked items by size; the largest size up to a bound is found by union-find."""

    def __init__(self, capacity: int, sizes: np.ndarray) -> None:
        self.counts = np.bincount(sizes, minlength=capacity + 1)
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for k in range(len(sizes) - 1, -1, -1):
            self.items[sizes[k]].append(k)
        self.below = list(range(capacity + 1))
        for size in range(1, capacity + 1):
            if not self.items[size]:
                self.below[size] = size - 1

    def largest(self, bound: int) -> int:
        """The largest size in stock that is at most ``bound``, else 0."""
        below = self.below
        while below[bound] != bound:
            below[bound] = below[below[bound]]
            bound = below[bound]
        return bound

    def take(self, size: int) -> int:
        self.counts[size] -= 1
        item = self.items[size].pop()
        if not self.items[size]:
            self.below[size] = size - 1
        return item

    def put(self, size: int, item: int) -> None:
        # Only sizes below a former one may come back, so union-find is rebuilt around them.
        if not self.items[size]:
            self.below[size] = size
            for larger in range(size + 1, len(self.below)):
                if self.items[larger]:
                    break
                self.below[larger] = larger - 1
        self.items[size].append(item)
        self.counts[size] += 1

    def pair(self, bound: int) -> tuple[int, int]:
        """Two sizes in stock with the largest sum up to ``bound``; (0, 0) if there are none."""
        sizes = np.flatnonzero(self.counts[1:bound]) + 1
        if not len(sizes):
            return 0, 0
        mate = np.searchsorted(sizes, bound - sizes, "right") - 1
        # A size can be its own mate only if two are left.
        alone = (mate >= 0) & (sizes[mate] == sizes) & (self.counts[sizes] < 2)
        mate = mate - alone
        total = np.where(mate >= 0, sizes + sizes[mate], 0)
        best = int(total.argmax())
        return (int(sizes[best]), int(sizes[mate[best]])) if total[best] else (0, 0)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (1 to ``capacity`` tokens each).

    A container is filled greedily with the largest items that fit. If room is left, its
    smallest item gives way to the two unpacked items whose sizes add up closest to the room
    then free, provided they fill it better; this is repeated while it helps.
    """
    stock = _Stock(capacity, sizes)
    bins = np.full(len(sizes), -1, np.int64)
    current = 0
    while size := stock.largest(capacity):
        held: list[tuple[int, int]] = []
        room = capacity
        while size:
            held.append((size, stock.take(size)))
            room -= size
            size = stock.largest(room) if room else 0
        while room and len(held) < len(sizes):
            size, item = min(held)
            a, b = stock.pair(room + size)
            if a + b <= size:
                break
            held.remove((size, item))
            held += [(a, stock.take(a)), (b, stock.take(b))]
            stock.put(size, item)
            room += size - a - b
        for _, item in held:
            bins[item] = current
        current += 1
    return bins


def containers(counts: DataFrame, kinds: DataFrame, lot_items: int = LOT_ITEMS) -> DataFrame:
    """Every item in a container of each kind: ``container_kind``, ``container_id``, ``doc_id``, ``part``, ``n_tokens``.

    ``counts`` has ``doc_id`` and ``n_tokens`` (rows with null or no tokens take no room and
    have no container), ``kinds`` has ``container_kind`` and ``capacity_tokens`` (null or below
    1: left out). An item above the capacity is split into full parts, each a container of its
    own, and a rest that is packed like other items; no other item is split. Items are dealt
    into lots by a hash of their id and each lot is packed by itself, so that at most one
    container a lot is left badly filled whatever the number of items. Repeated ``doc_id`` are
    items of their own.
    """
    # A handful of kinds: they are parameters of the packing, not data that grows.
    sizes = [(r[0], int(r[1])) for r in kinds.select("container_kind", "capacity_tokens").where(F.col("capacity_tokens") >= 1).orderBy("container_kind").collect()]
    lots = max(1, -(-counts.count() // lot_items))

    def pack_lot(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("doc_id", kind="stable")
        ids, tokens, number = lot.doc_id.to_numpy(), lot.n_tokens.to_numpy(), int(lot.lot.iloc[0])
        out = []
        for kind, capacity in sizes:
            full, rest = tokens // capacity, tokens % capacity
            kept = np.flatnonzero(rest)
            bins = pack(rest[kept], capacity)
            used = int(bins.max()) + 1 if len(bins) else 0
            owner = np.repeat(np.arange(len(ids)), full)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
            frame = pd.DataFrame({"doc_id": np.concatenate([ids[kept], ids[owner]]), "part": np.concatenate([full[kept], part]), "n_tokens": np.concatenate([rest[kept], np.full(len(owner), capacity)]), "bin": np.concatenate([bins, used + np.arange(len(owner))])})
            frame["container_kind"] = kind
            frame["container_id"] = frame.bin + number * (1 << 32)
            out.append(frame)
        columns = ["container_kind", "container_id", "doc_id", "part", "n_tokens"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    items = counts.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(lots)).alias("lot"))
    spread = items.repartition(task_count(counts.sparkSession), "lot")
    return spread.groupBy("lot").applyInPandas(pack_lot, "container_kind string, container_id long, doc_id long, part long, n_tokens long")


def packed(documents: DataFrame, kinds: DataFrame, vocabulary: str = VOCABULARY, lot_items: int = LOT_ITEMS) -> DataFrame:
    """``containers`` of the texts of ``documents`` (``doc_id``, ``text``), sized in tokens of ``vocabulary``."""
    return containers(materialise(token_counts(documents, vocabulary), "token-counts"), kinds, lot_items)


def fill(assigned: DataFrame, kinds: DataFrame) -> DataFrame:
    """How well the containers of each kind are filled."""
    per_bin = assigned.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    per_kind = per_bin.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("items").alias("items"), F.max("used").alias("fullest"))
    return per_kind.join(kinds.select("container_kind", "capacity_tokens"), "container_kind").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def conserved(counts: DataFrame, assigned: DataFrame, kinds: DataFrame) -> DataFrame:
    """What must hold of a packing, per kind: its ``documents``, and zeros.

    ``lost_tokens``: tokens of documents that no container holds, or holds twice; ``overfull``
    containers; ``needless_splits``: documents in several parts that would have fitted into one.
    """
    capacity = kinds.where(F.col("capacity_tokens") >= 1).select(F.col("container_kind").alias("ck"), F.col("capacity_tokens").alias("room"))
    per_doc = assigned.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("parts"))
    wanted = counts.where(F.col("n_tokens") > 0).select(F.col("doc_id").alias("d__"), "n_tokens").join(F.broadcast(capacity))
    joined = wanted.join(per_doc, (F.col("d__") == F.col("doc_id")) & (F.col("ck") == F.col("container_kind")), "full")
    by_kind = joined.groupBy(F.coalesce("ck", "container_kind").alias("container_kind")).agg(
        F.count("d__").alias("documents"),
        F.sum(F.abs(F.coalesce("n_tokens", F.lit(0)) - F.coalesce("held", F.lit(0)))).alias("lost_tokens"),
        F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("room"))).alias("needless_splits"),
    )
    bins = assigned.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(capacity), F.col("container_kind") == F.col("ck"))
    over = bins.groupBy("ck").agg(F.count_if(F.col("used") > F.col("room")).alias("overfull"))
    return by_kind.join(over, F.col("container_kind") == F.col("ck"), "left").select("container_kind", "documents", "lost_tokens", F.coalesce("overfull", F.lit(0)).cast("long").alias("overfull"), "needless_splits")
