"""Vectorised word and shingle arithmetic over Arrow string columns.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR.
Everything works on whole texts: a record batch is only cut between rows, into
slices of about ``SLICE_BYTES``, so memory follows the longest text at worst.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SHINGLE_WORDS = 5
LONG_SPAN = 4_096

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

_SEED = np.random.default_rng(20240229)
_BYTE_CODES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_WORD_CODES = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (an invertible finaliser)."""
    h = values.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(base: int, count: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < count:
        steps = np.full(max(count, 1), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if count <= 16 * SLICE_BYTES:
            _powers[str(base)] = known
    return known[:count]


class Texts(NamedTuple):
    """Concatenated UTF-8 bytes; text i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lowered(self) -> Texts:
        return Texts(TO_LOWER[self.data], self.bounds)

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


class Words(NamedTuple):
    """Byte positions of all words; text i owns words[bounds[i]:bounds[i + 1]]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def pack(column: pa.Array) -> Texts:
    """A string column as bytes and bounds; NULL becomes an empty text."""
    filled = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = filled.buffers()
    bounds = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if data is None or not len(bounds):
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    whole = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return Texts(whole, bounds - bounds[0])


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Row slices of about ``limit`` bytes of text, at least one row each."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        whole = pack(batch.column(at)).bounds
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(whole, whole[row] + limit, "right")) - 1)
            part = batch.slice(row, stop - row)
            yield part, pack(part.column(at))
            row = stop


def find_words(texts: Texts, spaces: np.ndarray = SPACES) -> Words:
    inside = ~spaces[texts.data]
    firsts = texts.bounds[:-1][texts.bounds[:-1] < len(inside)]
    lasts = texts.bounds[1:][texts.bounds[1:] > 0] - 1
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.bounds).astype(np.int64))


class Spans:
    """Hashes of byte spans of one array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.back = _power(_BASE_INVERSE, len(data) + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number each."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


_LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time.

    Every eight bytes are mixed into the hash of those before, so spans do not
    cancel out as terms of a sum can; unlike spans of up to eight bytes and one
    length never share a hash.  Spans over ``LONG_SPAN`` bytes are digested one
    by one.
    """
    lanes = _lanes(data)
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64(_BASE))
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    rows = np.flatnonzero(sizes <= LONG_SPAN)
    at, left = starts[rows], sizes[rows]
    while True:
        open_ = left > 0
        if not open_.all():
            rows, at, left = rows[open_], at[open_], left[open_]
        if not len(rows):
            return out
        own = lanes[at] & _LANE_MASKS[np.minimum(left, 8)]
        out[rows] = mix(mix(out[rows] ^ own) + np.uint64(_BASE))
        at, left = at + 8, left - 8


def same_spans(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray,
    known: int = 0,
) -> np.ndarray:
    """Whether each span of ``data`` holds the same bytes as its span of ``other``;
    of spans of up to ``known`` bytes only the lengths are compared."""
    mine, theirs = _lanes(data), _lanes(other)
    out = ends - starts == to - from_
    rows = np.flatnonzero(out & (ends - starts > known))
    at, there, left = starts[rows], from_[rows], (ends - starts)[rows]
    while len(rows):
        mask = _LANE_MASKS[np.clip(left, 0, 8)]
        alike = (mine[at] & mask) == (theirs[there] & mask)
        out[rows[~alike]] = False
        more = alike & (left > 8)
        rows, at, there, left = rows[more], at[more] + 8, there[more] + 8, left[more] - 8
    return out


def windows(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows inside one text, and their first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text_end = np.repeat(words.bounds[1:], np.diff(words.bounds))
    first = np.flatnonzero(np.arange(n) + size <= text_end[:n])
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total += hashes[first + k] * _WORD_CODES[k]
    return mix(total), first


def shingle_sets(texts: Texts, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every lower-cased text, and bounds.

    A text with fewer than ``size`` words has its whole word sequence as its
    only shingle; a text without words has none.
    """
    low = texts.lowered()
    words = find_words(low)
    hashes = hash_spans(low.data, words.starts, words.ends)
    values, first = windows(hashes, words, size)
    cuts = np.searchsorted(first, words.bounds)
    counts = words.counts()
    parts: list[np.ndarray] = []
    for i in range(len(texts)):
        if counts[i] >= size:
            own = np.sort(values[cuts[i] : cuts[i + 1]])
            parts.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif counts[i]:
            own = hashes[words.bounds[i] : words.bounds[i + 1]]
            parts.append(mix(np.array([(own * _WORD_CODES[: len(own)]).sum() + np.uint64(len(own))])))
        else:
            parts.append(values[:0])
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else values[:0]), bounds


def gather(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a ragged array, concatenated, and their lengths."""
    sizes = (bounds[1:] - bounds[:-1])[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(bounds[rows] - (ends - sizes), sizes)
    return values[at], sizes
