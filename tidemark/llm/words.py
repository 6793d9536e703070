"""Words, word hashes and shingles of whole Arrow string columns, computed in numpy.

A word is a maximal run of ASCII letters and digits and of bytes outside ASCII,
in lower case. Texts are handled in blocks of bounded size; one text longer
than a block is a block of its own, so no text is ever cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers = np.cumprod(np.full(64, _BASE, np.uint64))
#: Bytes whose terms are made at a time, and powers 0 and up of the base's inverse: words share their terms' powers and are then divided by that of their place.
_SPAN = 1 << 15
_inverse_powers = np.cumprod(np.append(np.uint64(1), np.full(_SPAN, pow(int(_BASE), -1, 1 << 64), np.uint64)))
_VALUES = np.where(_IS_WORD, np.arange(1, 257), 0).astype(np.uint64)


def _power_table(n: int) -> np.ndarray:
    """The first n powers of an odd base, modulo 2 ** 64."""
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _BASE, np.uint64))
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside the executor and under one limit with it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string array with at most ``limit`` bytes each, or one text; null is empty. Yields (first row, slice); freed memory is given back after the last."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        done = ends[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield row, texts.slice(row, to - row)
        row = to
    give_back()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray] | tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of all words, and the bounds of each text's words among them (one more than texts).

    With ``prefixes`` also, for each length n in bytes, (indices of words longer than n, hashes of their first n bytes).
    """
    data, offsets = raw_bytes(pc.utf8_lower(texts))
    is_word = _IS_WORD[data]
    begins = np.empty_like(is_word)
    if len(begins):
        begins[0] = is_word[0]
        np.logical_not(is_word[:-1], out=begins[1:])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins &= is_word
    at = np.flatnonzero(begins)
    bounds = np.searchsorted(at, offsets)
    if not len(at):
        return (np.zeros(0, np.uint64), bounds, [(np.zeros(0, np.int64), np.zeros(0, np.uint64)) for _ in prefixes]) if prefixes else (np.zeros(0, np.uint64), bounds)
    lasts = np.empty_like(is_word)
    lasts[-1] = is_word[-1]
    np.logical_not(is_word[1:], out=lasts[:-1])
    lasts[offsets[1:][offsets[1:] > 0] - 1] = True
    lasts &= is_word
    past = np.flatnonzero(lasts) + 1
    lengths = past - at
    hashes = np.empty(len(at), np.uint64)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(past, at[lo] + _SPAN, "right")))
        own = _VALUES[data[at[lo] : past[hi - 1]]]
        own *= _power_table(len(own))[: len(own)]
        first = at[lo:hi] - at[lo]
        hashes[lo:hi] = np.add.reduceat(own, first) * _inverse_powers[first]
        lo = hi
    hashes = mix64(hashes + lengths.astype(np.uint64))
    if not prefixes:
        return hashes, bounds
    found, total, longer = [], np.zeros(len(at), np.uint64), np.arange(len(at))
    for k in range(max(prefixes)):
        kept_on = lengths[longer] > k + 1
        longer, total = longer[kept_on], total[kept_on] + _power_table(k + 1)[k] * _VALUES[data[at[longer[kept_on]] + k]]
        if k + 1 in prefixes:
            found.append((longer, mix64(total ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1))))
    return hashes, bounds, found


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, and their bounds; a text of fewer words, but some, has one shingle of all."""
    n = len(hashes)
    counts = np.diff(bounds)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # words from here to the end of the text
    total = hashes * _STEPS[0]
    for k in range(1, min(size, n)):
        total[: n - k] += np.where(left[: n - k] > k, hashes[k:] * _STEPS[k], np.uint64(0))
    is_one = left >= size
    short = (counts > 0) & (counts < size)
    is_one[bounds[:-1][short]] = True
    made = np.where(short, 1, np.maximum(counts - size + 1, 0))
    return mix64(total[is_one]), np.concatenate([[0], np.cumsum(made)])
