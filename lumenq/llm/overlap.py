"""Records of evaluation splits that recur, exactly or almost, in the training split."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.session import materialise, task_count

#: Similarity (common words over all words) from which two samples overlap.
SIMILARITY = 0.7
#: Largest difference of a probability between equal predictions.
TOLERANCE = 0.000002
#: Counters of the word-frequency sketch, a fixed size whatever the vocabulary.
SKETCH = 1 << 16
#: Passages of one automaton of predictions, about.
SHARD_PASSAGES = 250_000
#: Training and evaluation records of one task, about: they bound a task's memory.
SHARD_ROWS, SHARD_HELD = 150_000, 150_000
#: Share of the records from which a word doesn't begin a stretch if others can, and most words in one.
FREQUENT, LONGEST = 1 / 2, 6
#: Marks for the words of the texts that are read at once, marks for each word of one at least, and candidates that are looked at together.
READ, SPREAD, SLICE = 1 << 20, 48, 1 << 17

_WORD = re.compile(r"[^\W_]+")
_TRAIN = "train"

def clean(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


class _Codes(dict):
    """32 bits of a word. Two words may share them: that gives candidates more, never less."""

    def __missing__(self, word: str) -> int:
        code = crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < 400_000:
            self[word] = code
        return code


def word_sets(samples: DataFrame) -> DataFrame:
    """``words``: the distinct words of each ``state``, sorted, with spaces between; their ``codes`` and ``key``; no row without a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for b in batches:
            words = [sorted(set(_WORD.findall(t.lower()))) for t in b.state]
            kept = np.array([len(w) > 0 for w in words], bool)
            words = [w for w in words if w]
            yield pd.DataFrame({"id": b.id[kept], "train": b.train[kept], "words": [" ".join(w) for w in words], "codes": [np.array([codes[x] for x in w], np.uint32).tobytes() for w in words]})

    rows = samples.where(F.col("sample_id").isNotNull() & F.col("state").isNotNull() & F.col("split").isNotNull())
    found = rows.select(F.col("sample_id").alias("id"), (clean(F.col("split")) == _TRAIN).alias("train"), "state").mapInPandas(run, "id long, train boolean, words string, codes binary")
    return found.withColumn("key", F.unhex(F.md5("words")))


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all rows in a row, where each row's begin and the last one's end) of a column of codes."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) // 4 for x in parts]
    flat = []
    for x in parts:
        first, last = np.frombuffer(x.buffers()[1], np.int32)[[x.offset, x.offset + len(x)]] if len(x) else (0, 0)
        flat.append(np.frombuffer(x.buffers()[2], np.uint8)[first:last].view(np.uint32) if last > first else np.zeros(0, np.uint32))
    none = np.zeros(0, np.uint32)
    return np.concatenate([none, *flat]), np.concatenate([[0], np.cumsum(np.concatenate([none.astype(np.int64), *sizes]))]).astype(np.int64)


def _census(classes: DataFrame) -> tuple[np.ndarray, int, int]:
    """(records that hold a word of each of SKETCH hash buckets, an upper bound for the word's own; training and evaluation records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH + 2, np.int64)
        for b in batches:
            total[:SKETCH] += np.bincount(_flat(b.column("codes"))[0] % SKETCH, minlength=SKETCH)
            total[SKETCH] += pc.sum(b.column("in_train")).as_py() or 0
            total[SKETCH + 1] += pc.sum(b.column("in_eval")).as_py() or 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), pa.array(total[used])], ["slot", "n"])

    counted = classes.select("codes", "in_train", "in_eval").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH + 2, np.int64)
    out[counted.slot.to_numpy()] = counted.n.to_numpy()
    return out[:SKETCH], int(out[SKETCH]), int(out[SKETCH + 1])


def differences(n: int, similarity: float) -> int:
    """Most words in which a record of ``n`` words can differ from one of at least ``similarity``."""
    return max(n + m - 2 * int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)) for m in range(int(np.ceil(similarity * n - 1e-9)), int(n / similarity + 1e-9) + 1))


def passages(words: np.ndarray, cost: np.ndarray, need: int) -> list[tuple[int, int]]:
    """``need`` disjoint stretches of a record's words in code order, each as rare as can be.

    ``cost`` is the surprise (negative logarithm of the share of records) of each word. If two
    records differ in fewer words than there are stretches, one stretch is untouched: it stands
    word for word, side by side, in the other record as well. Stretches are cut at an equal
    share of the surprise. None begins with a frequent word if there are enough without.
    Such stretches bear no words in between; ``sample_overlaps`` cuts records otherwise.
    """
    n = len(words)
    if need >= n:
        return [(k, k + 1) for k in range(n)]
    surprise = cost.tolist()
    for least in (-np.log(FREQUENT), 0.0):
        low, high, best = 0.0, sum(surprise) / need + 1e-9, None
        for _ in range(9):
            mid = (low + high) / 2
            spans, held, begin = [], 0.0, -1
            for k, x in enumerate(surprise):
                if begin < 0:
                    if x < least:
                        continue
                    begin, held = k, 0.0
                held += x
                if held >= mid or k - begin == LONGEST - 1:
                    spans.append((begin, k + 1))
                    begin = -1
            if len(spans) >= need:
                low, best = mid, spans
            else:
                high = mid
        if best:
            break
    best = best or [(k, k + 1) for k in range(n)]
    sums = np.concatenate([[0.0], np.cumsum(cost)])
    best.sort(key=lambda s: sums[s[0]] - sums[s[1]])
    return best[:need]


def _common(n: int, m: int, similarity: float) -> int:
    """Words that records of ``n`` and ``m`` words have in common at least if they are that similar."""
    return int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))


def _partners(n: int, similarity: float) -> range:
    """Sizes up to its own of the records that one of ``n`` words can be that similar to."""
    return range(max(1, int(np.ceil(similarity * n - 1e-9))), n + 1)


def groups(n: int, similarity: float) -> int:
    """Passages of a record of ``n`` words, one more than it can have words that a similar record of its size or larger hasn't."""
    return n - _common(n, n, similarity) + 1


def reach(m: int, similarity: float) -> int:
    """Words, the rarest first, of a text of ``m`` words among which the first two of a passage are that it shares with a smaller record."""
    return min(m, max(min(n, 2 * groups(n, similarity)) + m - _common(n, m, similarity) for n in _partners(m, similarity)))


def _route(classes: DataFrame) -> tuple[DataFrame, int]:
    """(records by the cell in which they meet, codes with the rarest words first; number of cells).

    Evaluation and training records are dealt by key to parts of bounded size; each two parts are
    a cell, so each two records meet once, and no word, however frequent, makes a cell larger.
    """
    counts, trains, evals = _census(classes)
    rank = np.empty(SKETCH, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(SKETCH, dtype=np.uint64)
    parts_t, parts_e = max(1, -(-trains // SHARD_ROWS)), max(1, -(-evals // SHARD_HELD))
    # Enough cells for the session's cores.
    while parts_t * parts_e < classes.sparkSession.sparkContext.defaultParallelism:
        if trains * parts_e >= evals * parts_t:
            parts_t += 1
        else:
            parts_e += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1 << 15):
                b = batch.slice(begin, 1 << 15)
                flat, at = _flat(b.column("codes"))
                row = np.repeat(np.arange(len(b), dtype=np.uint64), np.diff(at))
                ordered = np.sort(row << np.uint64(48) | rank[flat % SKETCH] << np.uint64(32) | flat).astype(np.uint32)
                codes = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ordered)])
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("in_train"), b.column("in_eval"), codes], ["key", "in_train", "in_eval", "codes"])

    ordered = classes.select("key", "in_train", "in_eval", "codes").mapInArrow(run, "key binary, in_train boolean, in_eval boolean, codes binary")
    own = lambda parts: F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    among = lambda parts: F.sequence(F.lit(0), F.lit(parts - 1))
    as_train = F.transform(among(parts_e), lambda e: F.struct(F.lit(True).alias("train"), (own(parts_t) * parts_e + e).alias("cell")))
    as_eval = F.transform(among(parts_t), lambda t: F.struct(F.lit(False).alias("train"), (t * parts_e + own(parts_e)).alias("cell")))
    none = F.array().cast("array<struct<train:boolean,cell:int>>")
    met = F.concat(F.when(F.col("in_train"), as_train).otherwise(none), F.when(F.col("in_eval"), as_eval).otherwise(none))
    return ordered.select("key", "codes", F.explode(met).alias("m")).select("m.cell", "m.train", "key", "codes"), parts_t * parts_e


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) << np.uint64(32) | b) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _unfold(first: np.ndarray, each: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``each``, ``first`` and the ``each`` - 1 numbers after it), in slices."""
    ends = np.cumsum(each)
    k = 0
    while k < len(each):
        before = int(ends[k - 1]) if k else 0
        last = int(np.searchsorted(ends, before + SLICE, "right"))
        if last > k:
            part = each[k:last]
            yield np.repeat(np.arange(k, last), part), np.repeat(first[k:last] - (ends[k:last] - part - before), part) + np.arange(int(ends[last - 1]) - before)
        else:
            # One of more than a slice.
            last = k + 1
            for begin in range(0, int(each[k]), SLICE):
                at = np.arange(begin, min(begin + SLICE, int(each[k])))
                yield np.full(len(at), k), first[k] + at
        k = last


def _pairs(n: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, and each place with itself for passages of one word, about ``step`` at once."""
    rows = max(1, step // max(1, n))
    for begin in range(0, n, rows):
        i, j = np.triu_indices(min(rows, n - begin), begin, n)
        yield i + begin, j


class _Automaton:
    """Passages of records, found in texts (of their size or larger) that hold all words of one, others between them or not.

    A record's words are dealt to its passages from the rarest to the most frequent and back, so
    that each begins with rare ones. States are the first two words of passages; from there on
    what a text's other words lead to is followed passage by passage.
    """

    def __init__(self, flat: np.ndarray, at: np.ndarray, similarity: float) -> None:
        self.flat, self.at, self.similarity = flat, at, similarity
        self.sizes = sizes = np.diff(at)
        known = {int(n): groups(int(n), similarity) for n in np.unique(sizes)}
        g = np.array([known[int(n)] for n in sizes], np.int64)
        place = np.arange(len(flat)) - np.repeat(at[:-1], sizes)
        of = np.repeat(g, sizes)
        turn, k = place // of, place % of
        k = np.where(turn % 2 == 0, k, of - 1 - k)
        passage = np.repeat(np.concatenate([[0], np.cumsum(g)[:-1]]) if len(g) else g, sizes) + k
        # Words by passage, the rarest first.
        order = np.argsort(passage, kind="stable")
        self.words = flat[order]
        self.long = np.bincount(passage, minlength=int(g.sum()))
        self.begin = np.concatenate([[0], np.cumsum(self.long)])[:-1]
        self.owner = np.repeat(np.arange(len(sizes)), g)
        key = _pair_key(self._word(0), self._word(1))
        by = np.argsort(key)
        key, self.passage = key[by], by
        self.bits = max(10, min(26, int(4 * len(by)).bit_length()))
        self.states = np.searchsorted(key >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.used = np.diff(self.states) > 0
        # A passage of fewer words repeats its first one.
        self.next = (self._word(2).astype(np.uint64) << np.uint64(32) | self._word(3))[by]
        self.size_of = sizes[self.owner[by]]

    def _word(self, k: int) -> np.ndarray:
        return self.words[self.begin + np.where(self.long > k, k, 0)] if len(self.begin) else self.words[:0]

    def read(self, flat: np.ndarray, at: np.ndarray, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(record, text, words of the record's passages in it) of texts larger than the record by ``least`` words at least."""
        sizes = np.diff(at)
        order = np.argsort(sizes, kind="stable")
        begin = 0
        while begin < len(order) and len(self.passage):
            spread = max(1 << 12, 1 << int(SPREAD * sizes[order[begin]]).bit_length())
            texts = order[begin : begin + max(1, READ // spread)]
            begin += len(texts)
            n = sizes[texts]
            row = np.repeat(np.arange(len(texts)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            own = flat[np.repeat(at[texts], n) + place]
            marks = np.zeros((len(texts), spread), bool)
            marks[row, own % spread] = True
            marked = marks.ravel()
            known = {int(m): reach(int(m), self.similarity) for m in np.unique(n)}
            deep = np.array([known[int(m)] for m in n])
            inside = place < deep[row]
            if deep.max() > 256:
                # Of long texts only words that begin a passage of a record of fitting size.
                fits = (self.sizes >= self.similarity * n[0] - 1e-9) & (self.sizes + least <= n[-1])
                fits = fits[self.owner]
                begins = np.zeros(1 << 16, bool)
                for k in (0, 1):
                    begins[self._word(k)[fits] % (1 << 16)] = True
                inside &= begins[own % (1 << 16)]
                kept = np.cumsum(inside)
                place = kept - 1 - np.repeat(np.concatenate([[0], kept])[np.cumsum(n) - n], n)
                deep = np.bincount(row[inside], minlength=len(texts))
            table = np.zeros((len(texts), int(deep.max())), np.uint32)
            table[row[inside], place[inside]] = own[inside]
            found: list[np.ndarray] = []
            for i, j in _pairs(table.shape[1], max(1, 4 * SLICE // len(texts))):
                key = _pair_key(table[:, i], table[:, j])
                slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
                text, pair = np.divmod(np.flatnonzero(self.used[slot]), len(j))
                fits = j[pair] < deep[text]
                text, pair = text[fits], pair[fits]
                slot = slot[text, pair]
                first = self.states[slot].astype(np.int64)
                # States are told apart by a part of their key; all words of a passage are asked for in the end.
                for of, hit in _unfold(first, self.states[slot + 1] - first):
                    line, next_ = text[of] * spread, self.next[hit]
                    fits = np.flatnonzero(marked[line + ((next_ >> np.uint64(32)).astype(np.int64) & (spread - 1))])
                    fits = fits[marked[line[fits] + (next_[fits].astype(np.int64) & (spread - 1))]]
                    hit, b = hit[fits], text[of[fits]]
                    size = self.size_of[hit]
                    fits = (size + least <= n[b]) & (size >= self.similarity * n[b] - 1e-9)
                    hit, b = hit[fits], b[fits]
                    passage = self.passage[hit]
                    fits = self._held(self.words, self.begin[passage], self.long[passage], b, marks) == self.long[passage]
                    passage, b = passage[fits], b[fits]
                    found.append(passage << 32 | b)
            # A passage may be reached on two ways where states share a part of their key.
            once = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
            passage, b = once >> 32, once & 0xFFFFFFFF
            pairs, of = np.unique(self.owner[passage] << 32 | b, return_inverse=True)
            covered = np.bincount(of, self.long[passage], len(pairs)).astype(np.int64)
            a, b = pairs >> 32, pairs & 0xFFFFFFFF
            common = np.ceil(self.similarity * (self.sizes[a] + n[b]) / (1 + self.similarity) - 1e-9)
            fits = self._held(self.flat, self.at[a], self.sizes[a], b, marks) >= common
            yield a[fits], texts[b[fits]], covered[fits]

    @staticmethod
    def _held(words: np.ndarray, begin: np.ndarray, each: np.ndarray, text: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """How many of the ``each`` words from ``begin`` on are marked as the text's."""
        out = np.zeros(len(each), np.int64)
        for of, at in _unfold(begin.astype(np.int64), each.astype(np.int64)):
            out += np.bincount(of, marks[text[of], words[at] % marks.shape[1]], len(each)).astype(np.int64)
        return out


def _matches(held: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``held``, place in ``texts``) of passages found, by an automaton that scans all texts."""
    import ahocorasick

    numbers: dict[str, int] = {}
    of = np.array([numbers.setdefault(passage, len(numbers)) for passage in held])
    automaton = ahocorasick.Automaton()
    for passage, number in numbers.items():
        automaton.add_word(passage, number)
    automaton.make_automaton()
    owner = np.argsort(of, kind="stable")
    each = np.bincount(of)
    first = np.cumsum(each) - each
    hits = [(k, number) for k, body in enumerate(texts) for _, number in automaton.iter(body)]
    if hits:
        row, number = np.array(hits, np.int64).T
        for k, at in _unfold(first[number], each[number]):
            yield owner[at], row[k]


def _scan(similarity: float):
    def scan(cell: pa.Table) -> pa.Table:
        """Automata over the cell's records on either side read the other side's larger ones."""
        train = cell.column("train")
        held, texts = cell.filter(pc.invert(train)), cell.filter(train)
        (e, e_at), (t, t_at) = _flat(held.column("codes")), _flat(texts.column("codes"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        if len(held) and len(texts):
            out += list(_Automaton(e, e_at, similarity).read(t, t_at))
            out += [(a, b, covered) for b, a, covered in _Automaton(t, t_at, similarity).read(e, e_at, least=1)]
        a, b, covered = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"eval_key": held.column("key").take(pa.array(a)), "train_key": texts.column("key").take(pa.array(b)), "covered": pa.array(covered.astype(np.int64))})

    return scan


def sample_overlaps(samples: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(links between classes: ``eval_key``, ``train_key``, ``covered``, ``words``, ``similarity``; members: ``key``, ``id``, ``train``).

    A class is the samples with one set of words; a class with rows on both sides links to
    itself. ``samples`` has ``sample_id``, ``split`` and ``state``; other columns are ignored,
    rows with a null in one of the three, or without a word, overlap with nothing.

    Words are ordered from the rarest to the most frequent, which makes a record a sequence that
    doesn't depend on the order of its text. The smaller record of a pair is cut into one more
    passage than it can have words that the larger one hasn't, so that all words of at least one
    stand in the larger one, in their order: no link is lost. Automata over the passages of
    a part of the records read all larger records of the other side, passing over foreign words;
    matches are merged into ``covered``, the number of the evaluation record's ``words`` in matched
    passages. Pairs without enough words in common by 32 bits of each are passed over, the rest is
    checked on the words themselves.
    """
    sets = materialise(word_sets(samples), "word-sets")
    members = sets.select("key", "id", "train")
    classes = sets.groupBy("key").agg(F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_eval"), F.first("codes").alias("codes"))
    classes = materialise(classes, "word-classes")
    rows, cells = _route(classes)
    links = rows.repartitionById(cells, "cell").groupBy("cell").applyInArrow(_scan(similarity), "eval_key binary, train_key binary, covered long")
    links = materialise(links, "overlap-candidates")
    # The words of linked classes only, once each.
    linked = links.select(F.explode(F.array("eval_key", "train_key")).alias("key")).distinct()
    words = sets.select("key", "words").join(linked, "key", "leftsemi").groupBy("key").agg(F.first("words").alias("words"))
    words = materialise(words, "linked-words")
    a = words.select(F.col("key").alias("ka"), F.split("words", " ").alias("wa"))
    b = words.select(F.col("key").alias("kb"), F.split("words", " ").alias("wb"))
    both = links.join(a, F.col("eval_key") == F.col("ka")).join(b, F.col("train_key") == F.col("kb"))
    common = F.size(F.array_intersect("wa", "wb"))
    measured = both.withColumn("similarity", common / (F.size("wa") + F.size("wb") - common))
    return measured.where(F.col("similarity") >= similarity).select("eval_key", "train_key", "covered", F.size("wa").cast("long").alias("words"), "similarity"), members


def sample_pairs(samples: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(``eval_id``, ``train_id``, ``similarity``) of all samples that overlap, classes expanded."""
    return expanded(*sample_overlaps(samples, similarity)).select("eval_id", "train_id", "similarity")


def _padded(rows: list, width: int) -> np.ndarray:
    """Lists of numbers as a matrix, with zeros after their last ones."""
    sizes = np.array([len(x) for x in rows])
    out = np.zeros((len(rows), width))
    out[np.arange(width) < sizes[:, None]] = np.concatenate(rows)
    return out


def prediction_overlaps(predictions: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(links between classes: ``eval_key``, ``train_key``; members: ``key``, ``id``, ``train``) of equal predictions.

    ``predictions`` has ``pred_id``, ``task``, ``split``, ``probabilities`` and ``label``.
    Labels and options are compared trimmed, lower-cased and with ``_`` as a space; options must
    be the same, and no probability may differ by more than ``tolerance``. Null labels, splits
    and tasks, null and empty distributions, and distributions with a null probability or with
    two options that are written alike match nothing. A class is the rows that agree in everything.

    A distribution is written as a passage: task, label, options and the cells of two
    probabilities. Cells are a little over twice the tolerance wide; a training row near a border
    is written on both sides. Automata over sharded evaluation passages scan the training rows',
    and what they match is checked number by number.
    """

    def name(x: Column) -> Column:
        return F.lower(F.regexp_replace(F.replace(x, F.lit("_"), F.lit(" ")), r"^\s+|\s+$", ""))

    entries = F.transform(F.map_entries("probabilities"), lambda e: F.struct(name(e["key"]).alias("o"), e["value"].alias("p")))
    rows = predictions.where(F.col("pred_id").isNotNull() & F.col("label").isNotNull() & F.col("split").isNotNull() & F.col("task").isNotNull()).select(
        F.col("pred_id").alias("id"), "task", (clean(F.col("split")) == _TRAIN).alias("train"), name(F.col("label")).alias("lab"), F.array_sort(entries).alias("d")
    )
    rows = rows.where((F.size("d") > 0) & ~F.exists("d", lambda e: e["p"].isNull())).select("id", "train", F.to_json(F.struct("task", "lab", F.col("d.o").alias("o"))).alias("of"), F.col("d.o").alias("options"), F.col("d.p").alias("p"))
    rows = rows.where(F.size(F.array_distinct("options")) == F.size("options")).drop("options")
    rows = materialise(rows.select("id", "train", F.unhex(F.md5("of")).alias("of"), "p", F.unhex(F.md5(F.concat_ws("|", "of", F.transform("p", lambda x: x.cast("string"))))).alias("key")), "distributions")
    members = rows.select("key", "id", "train")
    classes = rows.groupBy("key").agg(F.first("of").alias("of"), F.first("p").alias("p"), F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_eval"))
    # Wider than what lies within the slack on both sides of a number, so that it falls into two cells at most.
    width, slack = 2.02 * tolerance, tolerance * 1.0001

    def cells(p: Column) -> Column:
        return F.array_distinct(F.array(F.floor((p - slack) / width), F.floor((p + slack) / width)))

    one, two = F.col("p")[0], F.coalesce(F.try_element_at(F.col("p"), F.lit(2)), F.lit(0.0))
    lines = {False: F.array(F.struct(F.floor(one / width).alias("x"), F.floor(two / width).alias("y"))), True: F.flatten(F.transform(cells(one), lambda x: F.transform(cells(two), lambda y: F.struct(x.alias("x"), y.alias("y")))))}
    # Copies are folded into classes, so that no passage is that of many rows.
    count = max(12, -(-members.count() // SHARD_PASSAGES) * 4)

    def written(side: DataFrame, train: bool) -> DataFrame:
        line = side.select("key", "of", "p", F.explode(lines[train]).alias("c"))
        body = F.concat(F.hex("of"), F.lit(" "), F.col("c.x").cast("string"), F.lit(" "), F.col("c.y").cast("string"), F.lit("."))
        return line.select(F.lit(train).alias("train"), "key", "p", body.alias("body")).withColumn("shard", F.pmod(F.xxhash64("body"), F.lit(count)).cast("int"))

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        held, texts = group[~group.train], group[group.train]
        out = [np.zeros((2, 0), np.int64)]
        if len(held) and len(texts):
            width_ = max(held.p.map(len).max(), texts.p.map(len).max())
            pe, pt = (_padded(x.p.tolist(), width_) for x in (held, texts))
            for a, b in _matches(held.body.tolist(), texts.body.tolist()):
                near = np.abs(pe[a] - pt[b]).max(axis=1) <= tolerance * (1 + 1e-9)
                out.append(np.stack([a[near], b[near]]))
        a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"eval_key": held["key"].to_numpy()[a], "train_key": texts["key"].to_numpy()[b]})

    rows = written(classes.where("in_eval"), False).unionByName(written(classes.where("in_train"), True))
    links = rows.repartition(task_count(predictions.sparkSession), "shard").groupBy("shard").applyInPandas(scan, "eval_key binary, train_key binary").distinct()
    return links, members


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """(``eval_id``, ``train_id``) of all rows of linked classes."""
    evals = members.where(~F.col("train")).select(F.col("key").alias("ke"), F.col("id").alias("eval_id"))
    trains = members.where("train").select(F.col("key").alias("kt"), F.col("id").alias("train_id"))
    return links.join(evals, F.col("eval_key") == F.col("ke")).join(trains, F.col("train_key") == F.col("kt")).drop("ke", "kt")


def prediction_pairs(predictions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(``eval_id``, ``train_id``) of all predictions that overlap, classes expanded."""
    return expanded(*prediction_overlaps(predictions, tolerance)).select("eval_id", "train_id")


def _counted(links: DataFrame, members: DataFrame, *most: Column) -> DataFrame:
    """One row per evaluation row that overlaps; links are added up class by class, no class is expanded into pairs."""
    trains = members.where("train").groupBy(F.col("key").alias("kt")).agg(F.count(F.lit(1)).alias("n"))
    per_class = links.join(trains, F.col("train_key") == F.col("kt")).groupBy("eval_key").agg(F.sum("n").alias("links"), *most)
    evals = members.where(~F.col("train")).select("key", F.col("id").alias("eval_id"))
    return evals.join(per_class, F.col("key") == F.col("eval_key")).drop("eval_key")


def sample_links(samples: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``eval_id``, its class ``key``, its ``links``, its ``words``, and how many of these one partner's passages ``covered`` at most."""
    links, members = sample_overlaps(samples, similarity)
    return _counted(links, members, F.max("words").alias("words"), F.max("covered").alias("covered"))


def prediction_links(predictions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``eval_id`` of every evaluation prediction that recurs, its class ``key`` and its ``links``."""
    return _counted(*prediction_overlaps(predictions, tolerance))


def report(links: DataFrame, rows: DataFrame, id_column: str) -> DataFrame:
    """Per split and task: rows, rows that overlap with the training split, and links."""
    of = rows.select(F.col(id_column).alias("i__"), clean(F.col("split")).alias("split"), clean(F.col("task")).alias("task")).where(F.col("split") != _TRAIN)
    joined = of.join(links.select("eval_id", F.col("links").alias("l")), F.col("i__") == F.col("eval_id"), "left")
    return joined.groupBy("split", "task").agg(F.count(F.lit(1)).alias("rows"), F.count("l").alias("overlapping"), F.coalesce(F.sum("l"), F.lit(0)).alias("links"))
