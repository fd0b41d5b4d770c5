"""Words of many texts as arrays: 64-bit hashes and byte positions, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once; a longer text is a part of its own.
PART_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype="u8")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
#: Bytes between words.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
_powers = np.ones(64, "u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _STEP), dtype="u8") * np.uint64(0xF1357AEA2E62A9C5)
    return _powers


_powers_to(4096)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that isn't used any more back to the system: workers live on to the next stage, with other needs."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@dataclass
class Words:
    """Words of the rows first to last of a batch. of: row of each word; bounds: first word of each row."""

    first: int
    last: int
    hashes: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of runs of whole rows, about PART_BYTES each, and where the rows begin in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], "i8", n + 1, column.offset * 8) if n else np.zeros(1, "i8")
    data = np.frombuffer(column.buffers()[2], "u1") if column.buffers()[2] is not None else np.zeros(0, "u1")
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART_BYTES, "right")) - 1)
        last = min(last, n)
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    release()


def words(column: pa.Array, lower: bool) -> Iterator[Words]:
    """Runs of bytes other than space and \\t to \\r, in parts of whole rows; positions are bytes in the row's text."""
    first = 0
    for raw, edges in parts(column):
        yield _part(raw, edges, first, lower)
        first += len(edges) - 1


def _part(raw: np.ndarray, edges: np.ndarray, first: int, lower: bool) -> Words:
    last = first + len(edges) - 1
    inside = ~WHITE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at_edge = edges[:-1][edges[:-1] < len(raw)]
    begins[at_edge] = inside[at_edge]
    starts = np.flatnonzero(begins)
    of = np.searchsorted(edges, starts, "right") - 1
    bounds = np.searchsorted(starts, edges)
    if not len(starts):
        none = np.zeros(0, "i8")
        return Words(first, last, np.zeros(0, "u8"), none, none, none, bounds)
    kept = np.flatnonzero(inside)
    firsts = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(firsts, len(kept)))
    place = np.arange(len(kept)) - np.repeat(firsts, lengths)
    letters = raw[kept]
    if lower:
        letters = _LOWER[letters]
    sums = np.add.reduceat(_LETTER[letters] * _powers_to(int(lengths.max()) + 1)[place], firsts)
    hashes = mix(sums + lengths.astype("u8"))
    own = edges[of]
    return Words(first, last, hashes, of, starts - own, starts - own + lengths, bounds)


def shingles(part: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of size words, and their rows; of a row with fewer words, its whole sequence."""
    h, n = part.hashes, len(part.hashes)
    counts = np.diff(part.bounds)
    sums = np.zeros(max(0, n - size + 1), "u8")
    for k in range(size):
        sums += mix(h[k : k + len(sums)] + np.uint64(k + 1)) * (_STEP << np.uint64(1) | np.uint64(1)) ** np.uint64(k + 1)
    ok = part.of[: len(sums)] == part.of[size - 1 : size - 1 + len(sums)] if len(sums) else np.zeros(0, bool)
    found, rows = mix(sums[ok]), part.of[: len(sums)][ok]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.array([np.add.reduce(mix(h[part.bounds[r] : part.bounds[r + 1]] + np.arange(1, counts[r] + 1, dtype="u8"))) for r in short], "u8")
        found = np.concatenate([found, mix(own ^ np.uint64(0x5851F42D4C957F2D))])
        rows = np.concatenate([rows, short])
    return found, rows


def distinct(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in order, and the bounds of the rows."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(n_rows + 1))
