"""Bitmaps of hashes that are broadcast: made slice by slice of the hashes' range, as large as what they hold asks for."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bits of a bitmap, as a power of two: 8 MB at first, for the broadcast and on the driver; from then on it has BITS_EACH
#: bits for each hash in it, up to 128 MB.  A full one has false hits only.
FILTER_POWER, MOST_POWER, BITS_EACH = 26, 30, 3


def size_for(n: int, slices: int = 1, each: int = BITS_EACH) -> int:
    """Bits of a slice's bitmap for n hashes, a power of two."""
    return min(max((1 << FILTER_POWER) // slices, 1 << (each * n - 1).bit_length()), (1 << MOST_POWER) // slices)


def bitmap(hashes: np.ndarray, slices: int, each: int = BITS_EACH) -> bytes:
    """The bitmap of one slice, of the 32 bits of its hashes behind those that name the slice."""
    bits = np.zeros(size_for(len(hashes), slices, each), bool)
    bits[(hashes >> np.uint32(32 - (len(bits).bit_length() - 1))).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def joined(maps: list[bytes | None]) -> bytes:
    """All slices' bitmaps one after the other (None: empty), the smaller ones stretched to the size of the largest."""
    size = max([(1 << FILTER_POWER) // len(maps) // 8, *(len(x) for x in maps if x)])
    stretched = lambda x: np.packbits(np.repeat(np.unpackbits(np.frombuffer(x, np.uint8)), size // len(x))).tobytes()
    return b"".join(bytes(size) if x is None else x if len(x) == size else stretched(x) for x in maps)


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> U64(64 - ((8 * len(bits)).bit_length() - 1))).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
