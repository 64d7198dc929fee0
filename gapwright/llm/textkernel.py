"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of bytes outside a separator class, hashed straight from the UTF-8
buffer without making Python strings. The hash of a word is a polynomial in an odd base over
random byte codes, mod 2**64, normalised by its start through the inverse base, then mixed:
equal words have equal hashes in every batch, worker and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes hashed at once; bounds the work arrays whatever the length of a text
SEGMENT = 1 << 20
_RNG = np.random.default_rng(20240229)
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII white space, control characters and punctuation; bytes of multi-byte characters are word bytes
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SEGMENT + 8), _powers(_INVERSE, SEGMENT + 8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _sum_segment(codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, polynomial sum (from the word's own start) and length of the words of a segment."""
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_CODES[codes] * _UP[: len(codes)], out=total[1:])
    return start, (total[end] - total[start]) * _DOWN[start], (end - start).astype(np.uint64)


def word_hashes(raw: np.ndarray, off: np.ndarray, separator: np.ndarray = ASCII_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and n + 1 offsets of each text's words.

    A word longer than SEGMENT bytes is summed over its segments: one word, one hash, at any length.
    """
    n = len(off) - 1
    # a separator after each text keeps words of neighbours apart
    at = off + np.arange(n + 1)
    padded = np.full(int(at[-1]), 0x20, np.uint8)
    keep = np.ones(len(padded), bool)
    keep[at[1:] - 1] = False
    padded[keep] = LOWER[raw] if lower else raw
    word = ~separator[padded]
    word[at[1:] - 1] = False
    starts, sums, sizes, i, inside = [], [], [], 0, False
    while i < len(padded):
        j = min(i + SEGMENT, len(padded))
        cut = j < len(padded) and word[j - 1] and word[j]
        if cut:
            gap = np.flatnonzero(~word[i:j])
            if len(gap):
                j, cut = i + int(gap[-1]) + 1, False
        start, total, size = _sum_segment(padded[i:j], word[i:j])
        if inside:
            # the first word here goes on from the last one of the segments before
            place = np.uint64(pow(_BASE, int(sizes[-1][-1]), 2**64))
            sums[-1][-1:] += total[:1] * place
            sizes[-1][-1:] += size[:1]
            start, total, size = start[1:], total[1:], size[1:]
        if len(start):
            starts.append(start + i)
            sums.append(total)
            sizes.append(size)
        i, inside = j, cut
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    return mix(np.concatenate(sums) + np.concatenate(sizes)), np.searchsorted(np.concatenate(starts), at)


def shingles(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, and their n + 1 offsets.

    A text of fewer words has its whole sequence as its one shingle, one without words has none.
    """
    count = np.diff(off)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_off = np.concatenate([[0], np.cumsum(size)])
    total = int(out_off[-1])
    text = np.repeat(np.arange(len(count)), size)
    first = off[:-1][text] + (np.arange(total) - out_off[:-1][text])
    length = np.minimum(count, k)[text]
    acc = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            there = j < length
            nxt = words[np.minimum(first + j, max(len(words) - 1, 0))] if len(words) else np.zeros(total, np.uint64)
            acc = np.where(there, acc * np.uint64(0x9FB21C651E98DF25) + nxt, acc)
    return mix(acc), out_off
