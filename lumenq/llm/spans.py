"""Long exact spans that several texts share: FM-index shards cut by content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.llm.fmindex import shared_segments
from lumenq.session import materialise, task_count

#: Characters of a run that is reported.
LEAST = 200
#: Characters that one shard's index holds, about.
SHARD_CHARS = 600_000
#: An anchor in more places than this may fill a shard alone: the text around it is trimmed to what is shared.
HOT_ROWS = 2_000
#: Characters that are hashed at a time.
BLOCK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """Content-defined anchors: of all grams of ``least // 2`` characters the one with the smallest hash in each window.

    Two texts with a run of ``least`` characters in common have an anchor of equal hash within
    the first ``least`` characters of the run, since both hold one whole window of grams there.
    """

    def __init__(self, least: int) -> None:
        self.gram = least // 2
        self.window = least - self.gram + 1
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, by in (("powers", _BASE), ("inverse", _INVERSE)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """A hash of every gram of the text."""
        n = len(codes) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(len(codes))
        sums = np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * self.powers[: len(codes)])
        below = np.concatenate([np.zeros(1, np.uint64), sums[: n - 1]])
        return _mix((sums[self.gram - 1 :] - below) * self.inverse[:n])

    def pick(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Positions chosen, of a block in which windows may begin where ``last`` is true."""
        n, w = len(hashes), self.window
        if n < w:
            return np.zeros(0, np.int64)
        bits = np.uint64(max(1, int(n).bit_length()))
        packed = ((hashes >> bits) << bits) | np.arange(n, dtype=np.uint64)
        padded = np.concatenate([packed, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        front = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: n - w + 1], front[w - 1 : n])[last[: n - w + 1]]
        chosen = np.unique((least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
        return self._thin(chosen, hashes)

    def _thin(self, chosen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Leave out equal grams that a neighbour within every window stands for (text that repeats itself)."""
        same = hashes[chosen]
        if not (same[1:] == same[:-1]).any():
            return chosen
        kept = [0]
        for k in range(1, len(chosen) - 1):
            p = kept[-1]
            if not (same[p] == same[k] == same[k + 1] and chosen[k + 1] - chosen[p] <= self.window):
                kept.append(k)
        return chosen[[*kept, len(chosen) - 1]] if len(chosen) > 1 else chosen


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(ids: np.ndarray, texts: list[str], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, id, position in its text of each code), of at most about BLOCK codes; longer texts are cut with an overlap."""
    parts: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for key, text in zip(ids, texts, strict=True):
        codes = _codes(text)
        for begin in range(0, max(1, len(codes) - least + 1), BLOCK):
            part = codes[begin : begin + BLOCK + least - 1]
            if size + len(part) > BLOCK and parts:
                yield _joined(parts)
                parts, size = [], 0
            parts.append((key, begin, part))
            size += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(p) for _, _, p in parts]
    return (np.concatenate([p for _, _, p in parts]), np.repeat([k for k, _, _ in parts], sizes), np.concatenate([np.arange(b, b + len(p)) for _, b, p in parts]))


def anchors(documents: DataFrame, least: int) -> DataFrame:
    """``doc_id``, ``pos`` and ``h`` of the anchors of every text of ``least`` characters or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Anchors(least)
        for b in batches:
            for codes, ids, at in _blocks(b.doc_id.to_numpy(), b.text.tolist(), least):
                n = len(codes) - least + 1
                if n <= 0:
                    continue
                # A window begins where all of its characters belong to one text.
                inside = (ids[:n] == ids[least - 1 :]) & (at[least - 1 :] - at[:n] == least - 1)
                hashes = make.grams(codes)
                chosen = make.pick(hashes, inside)
                yield pd.DataFrame({"doc_id": ids[chosen], "pos": at[chosen].astype("int32"), "h": hashes[chosen].view(np.int64)})

    return documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).mapInPandas(run, "doc_id long, pos int, h long")


def _key(text: Column) -> Column:
    return F.unhex(F.sha1(text))


_PIECES = "route long, doc_id long, n_chars int, begin int, piece string, hot boolean"


def pieces(documents: DataFrame, shared: DataFrame, least: int, shards: int) -> DataFrame:
    """The stretches of text around shared anchors: ``route`` is the anchor's shard, or the anchor itself where it is hot."""
    reach = least - least // 2

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["route", "doc_id", "n_chars", "begin", "piece", "hot"]
        for b in batches:
            out: list[tuple] = []
            for key, text, spots in zip(b.doc_id, b.text, b.spots, strict=True):
                places: dict[tuple[int, bool], list[int]] = {}
                for spot in spots:
                    hot = bool(spot["hot"])
                    places.setdefault((int(spot["h"]) if hot else int(spot["h"]) % shards, hot), []).append(int(spot["pos"]))
                for (route, hot), at in places.items():
                    at.sort()
                    first = 0
                    for k in range(1, len(at) + 1):
                        if k == len(at) or hot or at[k] - at[k - 1] > least:
                            begin, end = max(0, at[first] - reach), at[k - 1] + least
                            piece = text[begin:end]
                            if len(piece) >= least:
                                out.append((route, key, len(text), begin, piece, hot))
                            first = k
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    spots = shared.groupBy(F.col("doc_id").alias("d__")).agg(F.collect_list(F.struct("pos", "h", "hot")).alias("spots"))
    texts = documents.select("doc_id", "text").where(F.length("text") >= least)
    joined = texts.join(spots, F.col("doc_id") == F.col("d__")).select("doc_id", "text", "spots")
    return joined.mapInPandas(cut, _PIECES)


def _windows(distinct: DataFrame, least: int) -> DataFrame:
    """``pid``, ``at`` and a hash ``w`` of every window of the pieces, with the smallest and largest document of the piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Anchors(2 * least)
        for b in batches:
            hashes = [make.grams(_codes(t)).view(np.int64) for t in b.piece]
            n = [len(h) for h in hashes]
            yield pd.DataFrame({"pid": np.repeat(b.pid.to_numpy(), n), "at": np.concatenate([np.arange(k, dtype="int32") for k in n] or [np.zeros(0, "int32")]), "w": np.concatenate(hashes or [np.zeros(0, np.int64)]), "lo": np.repeat(b.lo.to_numpy(), n), "hi": np.repeat(b.hi.to_numpy(), n)})

    return distinct.select("pid", "piece", "lo", "hi").mapInPandas(run, "pid binary, at int, w long, lo long, hi long")


def _trimmed(hot: DataFrame, least: int, hot_rows: int) -> DataFrame:
    """Pieces around hot anchors without the text that no other document has.

    A phrase in a third of all documents gives as many pieces, each with other text beside it.
    Equal pieces are folded, windows of ``least`` characters are counted by hash (map-side), and
    only stretches of windows that occur again stay, so that what is left of the phrase's pieces
    is the phrase. Where an anchor's pieces still differ too much for one shard, each window
    that is shared is a piece of its own, of which the index holds one copy. Nothing that is
    shared is dropped, and no step gathers an anchor's pieces. Which of the pieces that stay
    share a run is left to the index.
    """
    keyed = materialise(hot.withColumn("pid", _key(F.col("piece"))), "hot-pieces")
    distinct = keyed.groupBy("pid").agg(F.first("piece").alias("piece"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    windows = _windows(distinct, least)
    again = windows.groupBy("w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select(F.col("w").alias("w__"))
    kept = windows.select("pid", "at", "w").join(again, F.col("w") == F.col("w__"))
    # At most least - least // 2 + 1 windows a piece.
    starts = kept.groupBy(F.col("pid").alias("p__")).agg(F.array_sort(F.collect_list("at")).alias("starts"))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pid, starts in zip(b.p__, b.starts, strict=True):
                starts = np.asarray(starts)
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    rows.append((pid, int(part[0]), int(part[-1])))
            yield pd.DataFrame(rows, columns=["p__", "first", "last"])

    stretches = starts.mapInPandas(runs, "p__ binary, first int, last int")
    part = lambda at, size: F.substring("piece", F.col(at) + 1, size)
    cut = keyed.join(stretches, F.col("pid") == F.col("p__")).select("route", "doc_id", "n_chars", "begin", "piece", "first", "last")
    cut = cut.withColumn("body", part("first", F.col("last") - F.col("first") + least)).withColumn("begin", F.col("begin") + F.col("first"))
    cut = materialise(cut.select("route", "doc_id", "n_chars", "begin", F.col("body").alias("piece")), "trimmed-pieces")
    full = cut.select("route", _key(F.col("piece")).alias("k")).distinct().groupBy(F.col("route").alias("r__")).count().where(F.col("count") > hot_rows).select("r__")
    crowded = cut.join(full, F.col("route") == F.col("r__"), "left_semi").withColumn("at", F.explode(F.sequence(F.lit(0), F.length("piece") - least)))
    single = crowded.withColumn("piece", F.substring("piece", F.col("at") + 1, F.lit(least))).withColumn("begin", F.col("begin") + F.col("at")).withColumn("route", F.xxhash64("piece")).drop("at")
    return cut.join(full, F.col("route") == F.col("r__"), "left_anti").unionByName(single)


def _search(least: int):
    def search(group: pd.DataFrame) -> pd.DataFrame:
        """Segments of the distinct pieces of one shard."""
        group = group.sort_values("pid")
        found = shared_segments(group.piece.tolist(), group.copies.to_numpy(), least)
        shard = int(group.shard.iloc[0])
        return pd.DataFrame({"pid": group.pid.to_numpy()[found[:, 0]], "class": (shard << 32) + found[:, 1], "first": found[:, 2].astype("int32"), "last": found[:, 3].astype("int32")})

    return search


def shared_pieces(documents: DataFrame, least: int = LEAST, shard_chars: int = SHARD_CHARS, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members: ``shard``, ``pid``, ``doc_id``, ``n_chars``, ``begin``; segments: ``shard``, ``pid``, ``class``, ``first``, ``last``).

    A member is a place of a piece in a document; a segment is windows in a row of a piece, of which
    those pieces of the shard that hold them too have a segment of the same class.
    """
    found = materialise(anchors(documents, least), "anchors")
    repeated = found.groupBy(F.col("h").alias("h__")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = found.join(repeated, F.col("h") == F.col("h__")).select("doc_id", "pos", "h", (F.col("n") > hot_rows).alias("hot"))
    shared = materialise(shared, "shared-anchors")
    counted = shared.agg(F.count(F.lit(1)), F.max("hot")).first()
    shards = max(1, -(-counted[0] * 3 * (least // 2) // shard_chars))
    cut = pieces(documents, shared, least, shards)
    if counted[1]:
        cut = materialise(cut, "cut")
        cut = cut.where("not hot").drop("hot").unionByName(_trimmed(cut.where("hot").drop("hot"), least, hot_rows))
    cut = cut.withColumn("shard", F.pmod("route", F.lit(shards)).cast("int")).withColumn("pid", _key(F.col("piece")))
    cut = materialise(cut.select("shard", "pid", "doc_id", "n_chars", "begin", "piece"), "pieces")
    members = cut.select("shard", "pid", "doc_id", "n_chars", "begin")
    distinct = cut.groupBy("shard", "pid").agg(F.first("piece").alias("piece"), F.count(F.lit(1)).alias("copies"))
    segments = distinct.repartition(task_count(documents.sparkSession), "shard").groupBy("shard").applyInPandas(_search(least), "pid binary, class long, first int, last int")
    return members, materialise(segments, "segments")


def _owners(members: DataFrame, segments: DataFrame) -> DataFrame:
    """``class`` and ``doc_id`` of the documents that hold the windows of a class."""
    shard = F.shiftright("class", 32).cast("int")
    held = segments.select("class", F.col("pid").alias("p__"), shard.alias("s__")).distinct()
    joined = members.join(held, (F.col("shard") == F.col("s__")) & (F.col("pid") == F.col("p__")))
    return joined.select("class", "doc_id").distinct()


def pairs(documents: DataFrame, least: int = LEAST, **kwargs) -> DataFrame:
    """(``doc_a``, ``doc_b``), ``doc_a`` < ``doc_b``: two documents with a run of ``least`` characters in common.

    ``documents`` has ``doc_id`` (unique, null rows are skipped) and ``text``; other columns are
    ignored. Null texts and texts shorter than ``least`` share nothing. Each pair comes once.
    Classes are expanded here only; of classes with the same documents one is.
    """
    owners = materialise(_owners(*shared_pieces(documents, least, **kwargs)), "owners")
    # The set of a class's documents, as its size and two sums of hashes (added up map-side).
    small = lambda seed: F.sum(F.shiftright(F.xxhash64(F.lit(seed), "doc_id"), 24).cast("decimal(38,0)"))
    sets = owners.groupBy("class").agg(F.count(F.lit(1)).alias("n"), small(1).alias("s1"), small(2).alias("s2")).where("n > 1")
    chosen = sets.groupBy("n", "s1", "s2").agg(F.min("class").alias("c__")).select("c__")
    kept = owners.join(chosen, F.col("class") == F.col("c__")).select("class", "doc_id")
    a, b = kept.select("class", F.col("doc_id").alias("doc_a")), kept.select("class", F.col("doc_id").alias("doc_b"))
    return a.join(b, "class").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def coverage(documents: DataFrame, least: int = LEAST, **kwargs) -> DataFrame:
    """For each document with a shared span: ``doc_id``, ``spans``, ``shared_chars``, ``n_chars``, ``portion``.

    A window of ``least`` characters is shared if another document holds it too; a document's own
    copies don't count. Spans that overlap or touch are merged. Documents that share nothing
    have no row. Input and edge cases as in ``pairs``; nothing is expanded into pairs here.
    """
    members, segments = shared_pieces(documents, least, **kwargs)
    several = _owners(members, segments).groupBy("class").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("class").alias("c__"))
    shared = segments.join(several, F.col("class") == F.col("c__")).select(F.shiftright("class", 32).cast("int").alias("s__"), F.col("pid").alias("p__"), "first", "last")
    placed = members.join(shared, (F.col("shard") == F.col("s__")) & (F.col("pid") == F.col("p__")))
    spans = placed.select("doc_id", "n_chars", (F.col("begin") + F.col("first")).alias("s"), (F.col("begin") + F.col("last") + least).alias("e"))
    ends = spans.groupBy("doc_id", "n_chars", "s").agg(F.max("e").alias("e"))
    merged = ends.groupBy("doc_id", "n_chars").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("all"))
    empty = F.struct(F.lit(0).alias("spans"), F.lit(0).alias("chars"), F.lit(-1).alias("end"))
    total = F.aggregate(
        "all",
        empty,
        lambda acc, x: F.struct(
            (acc["spans"] + F.when(x["s"] > acc["end"], 1).otherwise(0)).alias("spans"),
            (acc["chars"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("chars"),
            F.greatest(acc["end"], x["e"]).alias("end"),
        ),
    )
    counted = merged.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), total.alias("t"))
    return counted.select("doc_id", F.col("t.spans").cast("long").alias("spans"), F.col("t.chars").cast("long").alias("shared_chars"), "n_chars", F.round(F.col("t.chars") / F.col("n_chars"), 6).alias("portion"))
