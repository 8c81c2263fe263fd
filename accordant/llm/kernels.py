"""Vectorised text kernels that run inside Spark tasks.

Texts stay in their Arrow buffers: words are found and hashed with NumPy over the UTF-8 bytes of a few
megabytes of documents at a time, so no Python string is made for a word.  Every byte of a character
outside ASCII is 0x80 or more, so ASCII-only word rules hold byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds, unless a single document is longer.
SLICE_BYTES = 1 << 20

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

#: White space of the contracts: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Word bytes where words are runs of anything but white space.
BLANK_WORDS = ~SPACES
#: Word bytes where words are runs of letters, digits and non-ASCII characters.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_CODES_LOWER = _BYTE_CODES[LOWER]


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 64)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a run of documents: their 64-bit hashes, document numbers and byte spans."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, and the total at the end


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(raw)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_CODES_LOWER[raw] * _power("up", _ROOT, n), out=sums[1:])
    h = (sums[end] - sums[start]) * _power("down", _INVERSE, n + 1)[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words (runs of bytes that the table marks), lower-cased in A-Z, of the documents at the offsets.

    Long inputs are hashed piece by piece, cut where a word starts, so the working arrays stay small.
    """
    is_word = table[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = True
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    edge[-1] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = is_word[cuts[:-1]] if len(raw) else np.zeros(0, bool)
    start, end = cuts[:-1][keep], cuts[1:][keep]
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES, "right")))
        low, high = start[at], end[to - 1]
        hashes[at:to] = _hashed(raw[low:high], start[at:to] - low, end[at:to] - low)
        at = to
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(hashes, doc, start, end, first)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about SLICE_BYTES each; a longer document is alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, min(to, n)
        at = to


_TERMS = mix(np.arange(1, 65, dtype=np.uint64) * _ROOT) | np.uint64(1)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their documents; a document of fewer words is one shingle."""
    n = len(w.hash)
    size = np.diff(w.first)
    total = np.zeros(n, np.uint64)
    left = np.repeat(w.first[1:], size) - np.arange(n) if n else np.zeros(0, np.int64)  # words up to the document's end
    for j in range(k):
        m = max(0, n - j)
        total[:m] += np.where(left[:m] > j, w.hash[j:], 0).astype(np.uint64) * _TERMS[j]
    whole = np.minimum(np.repeat(size, size), k)
    keep = left >= whole
    return mix(total[keep] ^ (whole[keep].astype(np.uint64) << np.uint64(56))), w.doc[keep]


def binary_column(chunks: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value a row out of one array of items; ends: how many items belong to the rows up to each."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * chunks.dtype.itemsize
    data = pa.py_buffer(np.ascontiguousarray(chunks).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), data]).cast(pa.binary())
