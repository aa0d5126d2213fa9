"""Evaluation texts inside training texts: hash join of template windows with slot checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.session import materialise

#: Consecutive words that count as a passage.
WINDOW = 10
#: Bits of the set of template hashes of held-out items: a fixed size. What it lets through is joined by the hash.
SIEVE = 1 << 23

_WORD = re.compile(r"[^\W_]+")
_CLOSED = "the a an of was were is are and or it with on since as our its t can be we team which what who when where while did does each no"

# Units whose word stands for any other unit.
_UNITS = "percent km kg cm mm mb gb kb ms seconds second minutes minute hours hour days day weeks week months month years year usd eur gbp euros euro dollars dollar pounds pound miles mile metres metre units unit"

_NUMBER, _NAME, _UNIT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def word_hash(word: str) -> int:
    """64 bits of a word, the same in every process."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 32
    h = (h * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 32)


class Words:
    """Three hashes of each word, remembered for the words seen so far.

    The word itself; with numbers (words with a digit) and units as placeholders; and with
    names too (a capitalised word that is no closed-class word). The second doesn't depend on
    letter case, so a passage that recurs word for word always recurs in it.
    """

    def __init__(self, keep: int = 400_000) -> None:
        self.seen: dict[str, tuple[int, int, int]] = {}
        self.keep = keep
        self.closed = set(_CLOSED.split())
        self.units = set(_UNITS.split())

    def __call__(self, word: str) -> tuple[int, int, int]:
        triple = self.seen.get(word)
        if triple is None:
            low = word.lower()
            own = word_hash(low)
            flat = _NUMBER if any(c.isdigit() for c in word) else _UNIT if low in self.units else own
            name = flat == own and word[:1].isupper() and low not in self.closed
            triple = (own, flat, _NAME if name else flat)
            if len(self.seen) < self.keep:
                self.seen[word] = triple
        return triple


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(codes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Signed hash of the runs of ``window`` codes that begin ``at``."""
    n = len(codes) - window + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(window if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return _mix(out[at]).view(np.int64)


class Windows:
    """The windows of words of a batch of texts: ``row`` of the batch, ``pos`` in the text, template hashes."""

    def __init__(self, texts: pd.Series, words: Words, window: int) -> None:
        flat: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = _WORD.findall(text) if isinstance(text, str) else ()
            flat += found
            sizes[k] = len(found)
        codes = np.array(list(map(words, flat)), np.uint64).reshape(-1, 3)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n = max(0, len(flat) - window + 1)
        self.at = np.flatnonzero(owner[:n] == owner[window - 1 : window - 1 + n])
        self.row = owner[self.at]
        self.pos = self.at - starts[self.row]
        self.window = window
        self.own, *others = (np.ascontiguousarray(codes[:, k]) for k in range(3))
        #: (hashes under a template, windows that are looked up under it).
        self.templates = [(_rolling(self.own, self.at, window), np.arange(len(self.at)))]
        for coded in others:
            hashes = _rolling(coded, self.at, window)
            slots = np.concatenate([[0], np.cumsum(coded != self.own)])
            filled = slots[self.at + window] - slots[self.at]
            # A window that is mostly placeholders says nothing; one without new ones was looked up before.
            self.templates.append((hashes, np.flatnonzero((hashes != self.templates[-1][0]) & (window - filled >= window // 2))))

    def frame(self, ids: np.ndarray, key: str, picked: np.ndarray, template: np.ndarray) -> pd.DataFrame:
        """Rows of the windows ``picked``, under the given template hashes."""
        inside = self.at[picked][:, None] + np.arange(self.window)
        codes = self.own[inside].view(np.int64) if len(picked) else np.zeros((0, self.window), np.int64)
        return pd.DataFrame({key: ids[self.row[picked]], "pos": self.pos[picked].astype("int32"), "template": template[picked], "codes": list(codes)})


_SCHEMA = "{id} long, pos int, template long, codes array<long>"


def _windows(table: DataFrame, key: str, sieve: np.ndarray | None, window: int) -> DataFrame:
    """Windows of the whole texts under the three templates; only those that the ``sieve`` lets through where it is given."""
    packed = None if sieve is None else np.packbits(sieve)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        opened = None if packed is None else np.unpackbits(packed).astype(bool)
        for b in batches:
            found = Windows(b["text"], words, window)
            ids = b[key].to_numpy()
            for template, picked in found.templates:
                if opened is not None:
                    picked = picked[opened[template[picked] & (SIEVE - 1)]]
                if len(picked):
                    yield found.frame(ids, key, picked, template)

    source = table.where(F.col(key).isNotNull() & (F.length("text") >= 2 * window - 1)).select(key, "text")
    return source.mapInPandas(run, _SCHEMA.format(id=key))


def _sieve(held: DataFrame) -> np.ndarray:
    """Which of SIEVE slots the items' templates fill; at most SIEVE / 64 numbers come to the driver."""
    slot = F.col("template").bitwiseAND(F.lit(SIEVE - 1))
    words = held.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(template & 63 as int)))").alias("bits"))
    out = np.zeros(SIEVE // 64, np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Passages of ``items`` in ``documents``: ``doc_id``, ``item_id``, ``passages``, ``literal``, ``reparameterised``.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other
    columns are ignored. Both texts are cut into all windows of ``window`` words, and windows are
    joined by the hash of their template: the words themselves; numbers and units as typed
    placeholders; names too. Templates with placeholders count where half of the words are none.
    A place of the document is ``literal`` if all words of a joined window are equal, else
    ``reparameterised`` if the fillings correspond one to one; any other is dropped. Texts that
    are null or shorter than a window match nothing; repeated items and documents each get their
    rows. An empty table on either side gives an empty result.

    A sieve of fixed size over the items' hashes keeps most windows of the documents in the scan;
    those it lets through are joined by a shuffle, however many items there are.
    """
    held = materialise(_windows(items, "item_id", None, window), "item-windows")
    seen = _windows(documents, "doc_id", _sieve(held), window)
    pairs = seen.select("doc_id", F.col("pos").alias("at"), F.col("template").alias("t__"), F.col("codes").alias("d__")).join(held, F.col("t__") == F.col("template"))
    both = F.arrays_zip(F.col("d__"), F.col("codes"))
    kinds = F.size(F.array_distinct(both))
    literal = F.col("d__") == F.col("codes")
    consistent = (kinds == F.size(F.array_distinct("d__"))) & (kinds == F.size(F.array_distinct("codes")))
    checked = pairs.select("doc_id", "item_id", "at", literal.alias("lit"), consistent.alias("fit")).where(F.col("lit") | F.col("fit"))
    places = checked.groupBy("doc_id", "item_id", "at").agg(F.bool_or("lit").cast("long").alias("lit"))
    return places.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("passages"), F.sum("lit").alias("literal"), F.sum(1 - F.col("lit")).alias("reparameterised"))
