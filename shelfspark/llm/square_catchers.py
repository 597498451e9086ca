"""Maximal repetitions (runs) of a sequence that arrives bit by bit, by catchers over dyadic blocks.

A square is a stretch of 2q words whose halves are alike, q being its period; a run is a longest stretch with a period,
that is, squares of one period that overlap, merged.

*Catchers.*  Blocks of m = 1, 2, 4, ... words stand at multiples of m.  Of every square with a period from 2m to 4m - 1 a
whole block of m words lies in the first half, and comes again q words on.  So once a block is complete its catcher
waits over the words that arrive from 2m to 4m after its start: the last m words so far, their suffix, are compared with
it.  A suffix of m words has two such blocks, whatever the text.  (Periods 1 to 3 would need blocks of one word; if runs
are at least ten words long, blocks of four do.)

*Suffix comparisons.*  A suffix that is caught says that a block and its copy are alike; how far both go on being alike,
back and forth, gives the stretch with that period.  One that is alike up to the last word so far stays open, and each
further stretch of words advances it until a word differs; then it is a run if it is long enough, or nothing.  A suffix
caught inside a run whose period divides its own belongs to that run and is not compared again.  A stretch that several
periods have is reported with the smallest.

Windows and ranges are compared by hashes (windows mixed modulo 2^64, ranges as polynomials modulo 2^61 - 1), which never
miss an equality, and every run is compared word by word before it is reported, so the results are exact.
All steps are array operations over the words of a stretch, a constant number of them for each of the log n levels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from shelfspark.llm.text_arrays import BASE, PRIME, U64, _multiply, mix

NONE = np.empty(0, np.int64)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= PRIME, x - U64(PRIME), x)


@dataclass
class _Level:
    """Blocks of m words: hashes of all complete blocks, and of the last windows, from which the next level is made."""

    m: int
    shifts: tuple[int, ...]
    blocks: np.ndarray = field(default_factory=lambda: np.empty(0, U64))
    tail: np.ndarray = field(default_factory=lambda: np.empty(0, U64))


class Catchers:
    """``append`` takes words (as numbers) in stretches of any size; ``runs`` gives what there is so far.

    least: words of the shortest run; longest: no run is longer than this, which spares the levels beyond.
    """

    def __init__(self, least: int = 12, longest: int | None = None):
        self.least, self.longest, self.n = least, longest, 0
        self.words = NONE
        self.sums, self.powers = np.zeros(1, U64), np.ones(1, U64)
        self.levels: list[_Level] = []
        self.closed = np.empty((0, 3), np.int64)  # start, end, period
        self.open = np.empty((0, 2), np.int64)  # start, period

    def _extend(self, words: np.ndarray) -> np.ndarray:
        """Takes the words in; returns their values for the hashes."""
        n, new = self.n, self.n + len(words)
        while len(self.powers) <= new:
            k = len(self.powers)
            self.powers = np.concatenate([self.powers, _multiply(self.powers, np.full(k, pow(BASE, k, PRIME), U64))])
        values = mix(words.astype(U64) + U64(1))
        terms = _multiply(_reduced(values), self.powers[n:new])
        low, high = np.cumsum(terms & U64((1 << 31) - 1)), np.cumsum(terms >> U64(31))
        high = ((high & U64((1 << 30) - 1)) << U64(31)) + (high >> U64(30))
        self.sums = np.concatenate([self.sums, _reduced(_reduced(_reduced(low) + _reduced(high)) + self.sums[-1])])
        self.words, self.n = np.concatenate([self.words, words]), new
        return values

    def _alike(self, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the words from a to b and those q further on are the same."""
        s, p = self.sums, U64(PRIME)
        here, there = _reduced(s[b] + p - s[a]), _reduced(s[b + q] + p - s[a + q])
        return _multiply(here, self.powers[q]) == there

    def _reach(self, at: np.ndarray, q: np.ndarray, forth: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) are the same as those q further on."""
        low, high = np.zeros(len(at), np.int64), self.n - at - q if forth else at.copy()
        while (left := np.flatnonzero(low < high)).size:
            middle = (low[left] + high[left] + 1) >> 1
            x = at[left]
            ok = self._alike(x, x + middle, q[left]) if forth else self._alike(x - middle, x, q[left])
            low[left] = np.where(ok, middle, low[left])
            high[left] = np.where(ok, high[left], middle - 1)
        return low

    def _exact(self, start: int, end: int, q: int) -> list[tuple[int, int, int]]:
        """The stretches from start to end that have period q word by word: one, unless hashes were equal by chance."""
        w = self.words
        same = np.concatenate([[False], w[start : end - q] == w[start + q : end], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2) + start
        return [(a, b + q, q) for a, b in turns.tolist() if b + q - a >= max(self.least, 2 * q)]

    def _close(self, found: np.ndarray) -> None:
        long = found[found[:, 1] - found[:, 0] >= np.maximum(self.least, 2 * found[:, 2])]
        if len(long):
            found = np.unique(np.concatenate([self.closed, np.array([r for x in np.unique(long, axis=0).tolist() for r in self._exact(*x)], np.int64).reshape(-1, 3)]), axis=0)
            first = np.ones(len(found), bool)  # in the order of start, end, period: the smallest period of a stretch
            first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
            self.closed = found[first]

    def _advance(self, before: int) -> None:
        """Open comparisons go on over the words since ``before``."""
        start, q = self.open.T
        end = before + self._reach(np.full(len(start), before) - q, q, True)
        self._settle(start, end, q, new=False)

    def _settle(self, start: np.ndarray, end: np.ndarray, q: np.ndarray, new: bool = True) -> None:
        still = end == self.n
        own = np.stack([start[still], q[still]], 1)
        self.open = np.unique(np.concatenate([self.open, own]), axis=0) if new else own
        self._close(np.stack([start, end, q], 1)[~still])

    def _known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of stretches so far in order, and of those that start no later the one that ends last: end and period."""
        live = np.column_stack([self.open[:, 0], np.full(len(self.open), self.n), self.open[:, 1]])
        all_ = np.concatenate([self.closed, live])
        all_ = all_[np.lexsort((all_[:, 2], all_[:, 0]))]
        if not len(all_):
            return NONE, NONE, NONE
        rank = np.maximum.accumulate(all_[:, 1] * (len(all_) + 1) + np.arange(len(all_), 0, -1))
        best = len(all_) - rank % (len(all_) + 1)
        return all_[:, 0], all_[best, 1], all_[best, 2]

    def _catch(self, level: _Level, windows: np.ndarray, first: int) -> None:
        """windows: hashes of the suffixes of m words that start at ``first`` and after."""
        m, found = level.m, []
        j = np.arange(first, first + len(windows))
        c = j // m
        for shift in level.shifts:
            skip = max(0, shift * m - first)
            hit = np.flatnonzero(windows[skip:] == level.blocks[c[skip:] - shift]) + skip
            block = (c[hit] - shift) * m
            found.append(np.stack([block, j[hit] - block], 1)[j[hit] > block])
        b, q = np.concatenate(found).T
        starts, ends, periods = self._known()
        if len(b) and len(starts):
            k = np.searchsorted(starts, b, side="right") - 1
            inside = (k >= 0) & (ends[k] >= b + q + m) & (q % periods[k] == 0)
            b, q = b[~inside], q[~inside]
        if len(b):
            order = np.lexsort((b, q))
            b, q = b[order], q[order]
            chained = np.zeros(len(b), bool)  # neighbouring blocks caught with one period: one stretch, reached from its first
            chained[1:] = (q[1:] == q[:-1]) & (b[1:] - b[:-1] == m)
            heads = np.flatnonzero(~chained)
            lasts = np.append(heads[1:], len(b)) - 1
            forth = self._reach(b[heads], q[heads], True)
            if (b[heads] + forth < b[lasts] + m).any():  # hashes of windows were equal by chance
                heads, forth = np.arange(len(b)), self._reach(b, q, True)
            b, q = b[heads], q[heads]
            self._settle(b - self._reach(b, q, False), b + q + forth, q)

    def append(self, words: np.ndarray) -> None:
        before, windows = self.n, self._extend(np.asarray(words, np.int64))
        if len(self.open):
            self._advance(before)
        m, k = 1, 0
        while m <= self.n and (self.longest is None or 4 * m <= max(self.longest, 16)):
            if k == len(self.levels):
                few = self.least < 10
                self.levels.append(_Level(m, (1, 2, 3) if m == 1 and few else () if m == 1 else (0, 2, 3) if m == 4 and not few else (2, 3)))
            level, first = self.levels[k], max(0, before - m + 1)  # of the new windows
            aligned = -(-first // m) * m
            level.blocks = np.concatenate([level.blocks, windows[aligned - first :: m]])
            if level.shifts and len(windows):
                self._catch(level, windows, first)
            whole = np.concatenate([level.tail, windows])  # from max(0, before - 2m + 1) on
            level.tail = whole[max(0, len(whole) - (min(m, max(0, self.n - m + 1)))) :]
            windows = mix(whole[:-m] * U64(0xD6E8FEB86659FD93) + whole[m:]) if len(whole) > m else np.empty(0, U64)
            m, k = 2 * m, k + 1

    def runs(self) -> np.ndarray:
        """start, end and period of all runs so far, by start and period; those that reach the last word included."""
        held = self.closed
        self._close(np.column_stack([self.open[:, 0], np.full(len(self.open), self.n), self.open[:, 1]]).astype(np.int64))
        out, self.closed = self.closed, held
        return out[np.lexsort((out[:, 2], out[:, 0]))]
