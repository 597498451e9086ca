"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The scans of induced sorting go by blocks of places, each as long as nothing is induced into itself: all suffixes that a
block induces are placed by one sort of their symbols, at every level of the recursion.  A block has some hundred places
among small buckets and many more among large ones.
"""

from __future__ import annotations

import numpy as np

#: Places from which on taking them together pays.
FEW = 32
#: Positions that are looked at together where the whole text would take much memory.
PIECE = 1 << 18


def _index_type(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S); a sentinel stands behind the end."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])  # where the symbol changes behind
    grows = s[differs] < s[differs + 1]
    small = np.repeat(grows, np.diff(differs, prepend=-1))
    return np.concatenate([small, np.zeros(n - len(small), bool)])


def _place(sa: np.ndarray, new: np.ndarray, symbol: np.ndarray, filled: np.ndarray, forward: bool) -> None:
    """Puts suffixes into the buckets of their symbols, at the front or at the back, keeping their order."""
    # 16 bits are sorted by radix
    order = np.argsort(symbol.astype(np.uint16) if len(filled) <= 1 << 16 else symbol, kind="stable")
    new, symbol = new[order], symbol[order]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    each = np.diff(np.append(first, len(new)))
    within = np.arange(len(new)) - np.repeat(first, each)
    sa[filled[symbol] + within if forward else filled[symbol] - 1 - within] = new
    filled[symbol[first]] += each.astype(filled.dtype) if forward else -each.astype(filled.dtype)


def _scan(sa: np.ndarray, into: np.ndarray, free: np.ndarray, forward: bool) -> None:
    """One scan of induced sorting. into: the bucket that each suffix induces its predecessor into,
    -1 for none (an empty place, -1, reads the last entry); free: where each bucket is filled next.

    A block of places is taken at once as far as nothing that it induces lands within it.  Where that stops after a few
    places (runs of one symbol), the next ones are taken one by one.
    """
    n, step = len(sa), 1 if forward else -1
    views = memoryview(sa), memoryview(into), memoryview(free)
    at, width = (0 if forward else n - 1), 1024
    while 0 <= at < n:
        block = sa[at : at + width] if forward else sa[max(0, at + 1 - width) : at + 1][::-1]
        bucket = into[block]
        own = np.flatnonzero(bucket >= 0)
        bucket = bucket[own]
        ahead = np.minimum.accumulate(free[bucket] - at if forward else at + 1 - free[bucket])
        taken = int(np.count_nonzero(ahead > own))
        done = len(block) if taken == len(own) else int(own[taken])
        if taken:
            done = min(done, int(ahead[taken - 1]))
            _place(sa, block[own[:taken]] - 1, bucket[:taken], free, forward)
        at += step * done
        width = min(2 * width, PIECE) if done == len(block) else max(64, min(width, 2 * done))
        if done < FEW:
            at = _scan_by_steps(*views, at, min(n, at + 16 * FEW) if forward else max(-1, at - 16 * FEW), step)


def _scan_by_steps(sa: memoryview, into: memoryview, free: memoryview, at: int, stop: int, step: int) -> int:
    for i in range(at, stop, step):
        j = sa[i]
        c = into[j]
        if c >= 0:
            place = free[c]
            free[c] = place + step
            sa[place if step > 0 else place - 1] = j - 1
    return stop


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes in order, given the leftmost S suffixes in an order that holds within each bucket."""
    n = len(s)
    kind = _index_type(n)
    ends = np.cumsum(np.bincount(s, minlength=symbols)).astype(kind)
    number = np.bincount(s[seeds], minlength=symbols)
    sa = np.full(n, -1, kind)
    sa[np.arange(len(seeds)) + np.repeat(ends - np.cumsum(number), number)] = seeds[np.argsort(s[seeds], kind="stable")]
    before, into = s[:-1].astype(kind), np.full(n + 1, -1, kind)
    free = np.concatenate([np.zeros(1, kind), ends[:-1]])
    sa[free[s[n - 1]]] = n - 1  # what the sentinel induces
    free[s[n - 1]] += 1
    into[1:n] = np.where(small[:-1], -1, before)
    _scan(sa, into, free, True)
    into[1:n] = np.where(small[:-1], before, -1)
    _scan(sa, into, ends, False)
    return sa


def _order_of_names(names: np.ndarray, top: int) -> np.ndarray:
    """The suffixes of the reduced string in order, all names below ``top`` standing in it.

    No comparison goes beyond a name that stands once, so behind such a name others of the kind are left out of the
    recursive call; they have their places by their names.
    """
    n = len(names)
    count = np.bincount(names, minlength=top)
    alone = count[names] == 1
    keep = np.ones(n, bool)
    keep[1:] = ~(alone[1:] & alone[:-1])
    kept = np.flatnonzero(keep).astype(_index_type(n))
    if len(kept) == n:
        return suffix_array(names, top)
    present = np.zeros(top, bool)
    present[names[kept]] = True
    dense = (np.cumsum(present) - 1).astype(names.dtype)
    ordered = kept[suffix_array(dense[names[kept]], int(dense[-1]) + 1)]
    order = np.empty(n, kept.dtype)
    once = np.flatnonzero(alone)
    order[(np.cumsum(count) - count)[names[once]]] = once
    order[np.repeat(count > 1, count)] = ordered[~alone[ordered]]
    return order


def suffix_array(s: np.ndarray, symbols: int = 256) -> np.ndarray:
    """Start positions of all suffixes of ``s`` in order; symbols are below ``symbols``."""
    n = len(s)
    if symbols <= 1 << 16:
        s = s.astype(np.uint16)  # 16 bits are sorted by radix
    if n < 2:
        return np.arange(n)
    small = _types(s)
    left = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(_index_type(n))  # leftmost S suffixes
    if not len(left):
        return _induce(s, small, left, symbols)
    order = _induce(s, small, left, symbols)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = order[is_left[order]]
    # name the leftmost-smaller substrings: each reaches to the next one's first symbol
    number = np.zeros(n, _index_type(n))
    number[left] = np.arange(len(left))
    length = np.diff(np.append(left, n)).astype(left.dtype)
    a, b = order[:-1], order[1:]
    size = length[number[a]]
    equal = size == length[number[b]]
    ends = (a + size >= n) | (b + size >= n)  # the last one ends with the sentinel
    equal &= ~ends
    active, k = np.flatnonzero(equal), 0
    while len(active):
        x, y = a[active] + k, b[active] + k
        same = s[x] == s[y]
        equal[active[~same]] = False
        active = active[same & (k < size[active])]
        k += 1
    name = np.concatenate([[0], np.cumsum(~equal)])
    reduced = np.empty(len(left), _index_type(n))
    reduced[number[order]] = name
    top = int(name[-1]) + 1
    del is_left, number, length, a, b, size, equal, ends, name  # before the recursion
    if top < len(left):
        order = left[_order_of_names(reduced, top)]
    return _induce(s, small, order, symbols)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position of ``s`` (16-bit symbols), the length (``most`` at most) of the common prefix of the suffix there
    and the one before it in the suffix array: the common prefixes permuted to text order.

    A length is carried on: where the symbols in front of both suffixes agree, it is one less than that of the position
    before.  Only the others are compared, four symbols at a time; all their lengths together are n log n at most.
    """
    n = len(s)
    before = np.full(n, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    carried = np.zeros(n, bool)
    for i in range(1, n, PIECE):
        x = before[i : i + PIECE]
        carried[i : i + PIECE] = (x > 0) & (s[i - 1 : i - 1 + len(x)] == s[x - 1])
    own = np.flatnonzero(~carried)
    # a length that is cut off here still reaches ``most`` at the last position that carries it on
    reach = most + int(np.diff(np.append(own, n)).max(initial=0))
    padded = np.concatenate([s.astype(np.uint16), np.zeros(4, np.uint16)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(2,))  # four symbols from each place on
    length = np.zeros(len(own), sa.dtype)
    for i in range(0, len(own), PIECE):
        here, other = own[i : i + PIECE], before[own[i : i + PIECE]].astype(np.int64)
        active, k = np.flatnonzero(other >= 0), 0
        while len(active) and k < reach:
            x, y = here[active] + k, other[active] + k
            inside = np.maximum(x, y) < n
            active, x, y = active[inside], x[inside], y[inside]
            differing = words[x] ^ words[y]
            low = (differing & (~differing + np.uint64(1))).astype(np.float64)
            run = np.where(differing == 0, 4, np.log2(np.maximum(low, 1)).astype(np.int64) >> 4)
            run = np.minimum(run, n - np.maximum(x, y))
            length[i + active] += run.astype(sa.dtype)
            active, k = active[run == 4], k + 4
    del before, carried
    whole = np.repeat((length + own).astype(sa.dtype), np.diff(np.append(own, n)))
    whole -= np.arange(n, dtype=sa.dtype)
    return np.minimum(whole, most, out=whole)
