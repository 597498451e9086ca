r"""Hashes of words and of byte ranges for many texts at once, in numpy on Arrow's own buffers.

A range is hashed as a polynomial in its bytes modulo the prime 2^61 - 1, at a fixed base, and mixed.  Two different
ranges of n bytes agree for n bases at most of all 2^61, so texts that were not made against this base are taken as
equal with a probability of n / 2^61 for each comparison, whatever pattern they have.  Equal ranges have equal hashes
wherever they stand.

``window_hashes`` is a cheaper kind, modulo 2^64, for windows of one width.  Strings that collide in it are easily
made (it is no evidence of equality); it serves to choose places that equal strings choose alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfspark.llm.storage import release

U64 = np.uint64
#: Bytes of text that are worked on at a time; a longer text is taken whole where its words are needed together.
PIECE_BYTES = 2 << 20
PRIME, BASE = (1 << 61) - 1, 0x15F4A7C39E3779B9
#: Bytes that are hashed at a time; a longer range is hashed by blake2b.
CHUNK = 1 << 18
WINDOW_BASE = 0x9E3779B97F4A7C15 | 1
_ORDERS = np.arange(1, 257, dtype=U64)
_FOLDED = _ORDERS.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _ORDERS[ord("a") : ord("z") + 1]
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_window_powers: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _multiply(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME, of numbers below it, in halves of 31 and 30 bits."""
    half, low = U64(31), U64((1 << 31) - 1)
    x0, x1, y0, y1 = x & low, x >> half, y & low, y >> half
    middle = x1 * y0 + x0 * y1
    total = (x1 * y1 << U64(1)) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << half) + x0 * y0
    total = (total & U64(PRIME)) + (total >> U64(61))
    return np.where(total >= PRIME, total - U64(PRIME), total)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of BASE below CHUNK, as their low 31 and high 30 bits, and of its inverse."""
    made = []
    for base in (BASE, pow(BASE, -1, PRIME)):
        powers, k = np.ones(CHUNK, U64), 1
        while k < CHUNK:
            powers[k : 2 * k] = _multiply(powers[:k], np.full(k, pow(base, k, PRIME), U64))
            k *= 2
        made.append(powers)
    return (made[0] & U64((1 << 31) - 1)).astype(np.uint32), (made[0] >> U64(31)).astype(np.uint32), made[1]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """Hashes of the byte ranges from starts to ends, both in increasing order; folded: A-Z count as a-z."""
    low, high, inverse = _powers()
    order = _FOLDED if folded else _ORDERS
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        values = order[data[base : int(ends[j - 1])]]
        if len(values) > CHUNK:  # one range
            out[i] = int.from_bytes(hashlib.blake2b((values - U64(1)).astype(np.uint8).tobytes(), digest_size=8).digest(), "little")
        else:
            a, b = starts[i:j] - base, ends[i:j] - base
            sums = np.zeros(len(values) + 1, U64)
            np.cumsum(values * high[: len(values)], out=sums[1:])
            upper = sums[b] - sums[a]  # below 2^58, times 2^31
            np.cumsum(values * low[: len(values)], out=sums[1:])
            total = sums[b] - sums[a] + ((upper & U64((1 << 30) - 1)) << U64(31)) + (upper >> U64(30))
            total = (total & U64(PRIME)) + (total >> U64(61))
            out[i:j] = mix(_multiply(np.where(total >= PRIME, total - U64(PRIME), total), inverse[a]))
        i = j
    return out


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` bytes from each place on, the same for equal bytes."""
    n = len(data)
    if len(_window_powers[0]) < n:
        for k, base in enumerate((WINDOW_BASE, pow(WINDOW_BASE, -1, 2**64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _window_powers[k] = np.multiply.accumulate(steps)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_VALUES[data] * _window_powers[0][:n], out=sums[1:])
    return mix((sums[width:] - sums[: n + 1 - width]) * _window_powers[1][: n + 1 - width])


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` bytes of text: the rows, their bytes, and the offsets of texts in them. A null text is empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop
        release()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of the words ``[^\x20\x09-\x0D]+`` and the offsets of texts in them."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    joined = cuts[inside[cuts + 1] & inside[cuts]]  # a word at the end of one text and at the start of the next
    begins[joined], ends[joined - 1] = True, True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word shingle, A-Z folded; a text with fewer words has its whole sequence as one."""
    starts, ends, bounds = words(data, offsets)
    h = range_hashes(data, starts, ends, folded=True)
    n = np.diff(bounds)
    made, text = [], []
    for size in range(1, width + 1):
        own = np.flatnonzero(n == size) if size < width else np.flatnonzero(n >= width)
        count = n[own] - size + 1
        first = np.repeat(bounds[own] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        total = np.full(len(first), size, U64)
        for k in range(size):
            total = mix(total * U64(0xD6E8FEB86659FD93) + h[first + k])
        made.append(total)
        text.append(np.repeat(own, count))
    return np.concatenate(text), np.concatenate(made)


def distinct(text: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) sorted by both, and the offsets of the n texts in them."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    text, values = text[new], values[new]
    return text, values, np.searchsorted(text, np.arange(n + 1))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    places = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    places += np.arange(len(places))
    return places


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the n nodes reaches by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
