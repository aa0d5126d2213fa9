"""A compressed FM-index over a collection of strings, against which many texts are streamed at once."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, depth: int, keep: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(order of the suffixes by their first ``depth`` symbols or more, ranks by the first ``reach``, reach).

    Prefix doubling; only suffixes that are still tied are sorted again in each round. ``reach``
    is the last of its lengths that isn't above ``keep``.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(4):
        key = (key << np.uint64(16)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank[order] = first
    reach = 4
    kept, kept_reach = rank.copy(), reach
    tied = np.flatnonzero(~fresh | np.concatenate([~fresh[1:], [False]])) if n else np.zeros(0, np.int64)
    while reach < depth and len(tied):
        at = order[tied]
        key2 = rank[at] * np.int64(n + 2) + rank[np.minimum(at + reach, n)] + 1
        by = np.argsort(key2, kind="stable")
        at, ordered = at[by], key2[by]
        order[tied] = at
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        tied = tied[~fresh | np.concatenate([~fresh[1:], [False]])]
        reach *= 2
        if reach <= keep:
            kept, kept_reach = rank.copy(), reach
    return order, kept, kept_reach


class FMIndex:
    """Backward search over a wavelet matrix of the Burrows-Wheeler transform.

    ``symbols`` are small integers; 0 separates strings and is never searched. Bits are packed
    into 64-bit words with a running count a word; the suffix array is not kept. Patterns may
    have up to ``least`` + 1 symbols. ``extend`` prepends one symbol to each of many patterns;
    ``shorten`` drops the last symbol of patterns of ``least`` symbols. For the latter the ranges
    of repeated stretches of ``least`` - 1 symbols are kept, a small part of the rows.
    """

    def __init__(self, symbols: np.ndarray, least: int) -> None:
        if least < 5:
            raise ValueError("a run has five symbols at least")
        self.n = n = len(symbols)
        order, rank, reach = suffix_array(symbols, least + 1, least - 1)
        # Neighbours agree in least - 1 symbols if they do in the first and in the last ``reach`` of them.
        other = np.minimum(order + least - 1 - reach, n)
        same = (rank[order[1:]] == rank[order[:-1]]) & (rank[other[1:]] == rank[other[:-1]])
        begins = np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(np.int8)) == 1)
        ends = np.flatnonzero(np.diff(np.concatenate([same, [False]]).astype(np.int8)) == -1) + 2 if n else begins
        self.wide = begins, ends
        bwt = symbols[order - 1]
        del order, rank, other, same
        sigma = int(symbols.max()) + 1 if n else 1
        counts = np.bincount(symbols, minlength=sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        current = bwt.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(128 - n % 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of ``symbol`` followed by the patterns with the ranges ``lo`` to ``hi``."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        shift = self.before[symbol] - self.start[symbol]
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns of ``least`` symbols without their last one."""
        begins, ends = self.wide
        if not len(begins):
            return lo, hi
        k = np.maximum(np.searchsorted(begins, lo, "right") - 1, 0)
        inside = (begins[k] <= lo) & (lo < ends[k])
        return np.where(inside, begins[k], lo), np.where(inside, ends[k], hi)


def shared_segments(texts: list[str], copies: np.ndarray, least: int, stride: int = 400, leap: int = 128) -> np.ndarray:
    """Where texts hold windows of ``least`` characters that occur more than once: rows (text, class, first, last).

    The texts, each of which stands for ``copies`` equal ones, are streamed against the index of
    all of them, which gives every window's matching statistic cut off at ``least``, and the range
    of suffixes of those that reach it. ``first`` and ``last`` are starts of windows in a row
    whose occurrences are the same, place by place; ``class`` is the row of the index at which the
    range of the last one begins. So texts share a window if and only if they have a segment of
    one class, and a passage of m texts gives m rows, not m (m - 1).

    A stretch of windows is searched from its left: a window goes backwards from its end until
    nothing but itself matches, which rules out every window up to there. Where one is found whole,
    the window ``leap`` further on is tried; if it is whole too, all windows back to the first one
    follow by one step each (the last symbol dropped, one prepended), else the stretch is halved.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 1
    del flat
    bases = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # The separator must be symbol 0 even if a text holds NUL characters itself.
    symbols[bases + sizes] = 0
    index = FMIndex(symbols, least)
    enough = np.where(np.asarray(copies) > 1, 1, 2)
    stretches = [(q, a, min(a + stride, sizes[q] - least + 1) - 1, False) for q in np.flatnonzero(sizes >= least) for a in range(0, sizes[q] - least + 1, stride)]
    found: list[np.ndarray] = []
    none = np.zeros((0, 4), np.int64)
    if not stretches:
        return none

    def begin(new: list[np.ndarray]) -> list[np.ndarray]:
        """Searches of new stretches (text, first window, last window, whether from the right)."""
        q, a, b, right = new
        i = np.where(right, b, a)
        return [q, a, b, right, i, i + least, np.zeros(len(q), np.int64), np.full(len(q), index.n, np.int64), np.zeros(len(q), bool)]

    run = begin([np.array(x) for x in zip(*stretches, strict=True)])
    while len(run[0]):
        q, a, b, right, i, p, lo, hi, sliding = run
        at = np.flatnonzero(sliding)
        if len(at):
            lo[at], hi[at] = index.shorten(lo[at], hi[at])
            i[at] -= 1
        p = np.where(sliding, i, p - 1)
        lo, hi = index.extend(symbols[bases[q] + p], lo, hi)
        alive = hi - lo >= enough[q]
        whole = alive & (p == i)
        if whole.any():
            found.append(np.stack([q[whole], i[whole], lo[whole], hi[whole]]))
        new: list[list[np.ndarray]] = []

        def push(which: np.ndarray, first: np.ndarray, last: np.ndarray, from_right: bool) -> None:
            some = first <= last
            if some.any():
                new.append([which[some], first[some], last[some], np.full(int(some.sum()), from_right)])

        hit = whole & ~right
        if hit.any():
            middle = np.minimum(i[hit] + leap, b[hit])
            push(q[hit], i[hit] + 1, middle, True)
            push(q[hit], middle + 1, b[hit], False)
        missed = ~alive & right
        if missed.any():
            last = i[missed] - 1
            middle = (a[missed] + last) // 2
            push(q[missed], a[missed], middle, True)
            push(q[missed], np.maximum(middle + 1, a[missed]), last, False)
        jump = ~alive & ~right
        i = np.where(jump, p + 1, i)
        p = np.where(jump, i + least, p)
        lo, hi = np.where(jump, 0, lo), np.where(jump, index.n, hi)
        sliding = sliding | (whole & right)
        stay = ~hit & ~missed & (i <= b) & ~(whole & right & (i == a))
        run = [x[stay] for x in (q, a, b, right, i, p, lo, hi, sliding)]
        if new:
            fresh = begin([np.concatenate(x) for x in zip(*new, strict=True)])
            run = [np.concatenate(x) for x in zip(run, fresh, strict=True)]
    if not found:
        return none
    q, i, lo, hi = np.concatenate(found, axis=1)
    order = np.lexsort((i, q))
    q, i, lo, hi = q[order], i[order], lo[order], hi[order]
    # Neighbouring windows have the same occurrences if each has as many as both together.
    next_to = np.flatnonzero((q[1:] == q[:-1]) & (i[1:] == i[:-1] + 1))
    lo2, hi2 = index.extend(symbols[bases[q[next_to]] + i[next_to]], lo[next_to + 1], hi[next_to + 1])
    both = hi2 - lo2
    alike = np.zeros(len(q), bool)
    alike[next_to[(both == hi[next_to] - lo[next_to]) & (both == hi[next_to + 1] - lo[next_to + 1])]] = True
    ends = np.flatnonzero(~alike)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.stack([q[ends], lo[ends], i[starts], i[ends]], axis=1)
