"""Vectorised text columns: words, keyed fingerprints and minimiser runs of whole Arrow batches.

Every function works on the concatenated UTF-8 bytes of a slice of an Arrow string column, so a task spends
nanoseconds per byte and never a Python call per word.  Slices are bounded by bytes (a single longer document
forms its own slice), so memory follows the slice and not the batch.

Fingerprints are keyed: an operator draws a seed for each run and hands it to its tasks, and values are joined by a
non-linear mixer.  So no text can be written whose fingerprints collide, and equal fingerprints of unlike texts are as
rare as 64 (or, where two are compared, 128) random bits that agree.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
_MASK = (1 << 64) - 1
#: Longer byte ranges are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The separators of the word pattern ``[^\x20\x09-\x0D]+``.
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII that is neither letter nor digit.
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def draw_seed() -> int:
    """A seed for the fingerprints of one run."""
    return secrets.randbits(63)


@dataclass(frozen=True)
class Prints:
    """Keyed fingerprints; those of one seed can be compared."""

    seed: int
    _keys: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        keys = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([self.seed & _MASK], dtype=np.uint64)))
        object.__setattr__(self, "_keys", keys | np.uint64(1))

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprint of the sequence of two values."""
        out = a * self._keys[0]
        out += b * self._keys[1]
        out ^= out >> np.uint64(32)
        out *= self._keys[2]
        out ^= out >> np.uint64(29)
        return out

    def ranges(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of byte ranges of ``data``."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
        length = end - begin
        out = mix(length.astype(np.uint64) * self._keys[3] + self._keys[4])
        rows = np.flatnonzero((length > 0) & (length <= _LONG))
        at = 0
        while len(rows):
            left = length[rows] - at
            part = eight[begin[rows] + at] & _FIRST_BYTES[np.minimum(left, 8)]
            out[rows] = self.join(out[rows], part)
            at += 8
            rows = rows[left > 8]
        key = self._keys[:4].tobytes()
        for row in np.flatnonzero(length > _LONG).tolist():
            out[row] = int.from_bytes(hashlib.blake2b(data[begin[row] : end[row]].tobytes(), digest_size=8, key=key).digest(), "little")
        return out

    def grams(self, values: np.ndarray, n: int, reach: int = 1) -> np.ndarray:
        """Fingerprints of ``n`` consecutive units from each unit on, by doubling; a value covers ``reach`` <= ``n`` units."""
        out = values
        while reach < n:
            step = min(reach, n - reach)
            out = self.join(out[: max(0, len(out) - step)], out[step:])
            reach += step
        return out

    def byte_grams(self, data: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of ``n`` consecutive bytes from each byte on."""
        if n < 8:
            return self.grams(mix(data.astype(np.uint64) + self._keys[5]), n)
        values = np.empty(max(0, len(data) - 7), dtype=np.uint64)
        for shift in range(min(8, len(values))):
            own = values[shift::8]
            own[:] = np.frombuffer(data[shift : shift + 8 * len(own)].tobytes(), "<u8")
        values *= self._keys[6]
        values ^= values >> np.uint64(31)
        return self.grams(values, n, 8)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for slices of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


@dataclass
class Words:
    """Words of a slice: byte range, row and fingerprint of each; ``first[r]:first[r + 1]`` are those of row r."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    code: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, prints: Prints, lower: bool = False, separators: np.ndarray = _SEP) -> Words:
    sep = separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    inside = ~sep
    start = inside.copy()
    start[1:] &= sep[:-1] | edge[1:-1]
    stop = inside
    stop[:-1] &= sep[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    code = prints.ranges(_LOWER[data] if lower else data, begins, ends)
    first = np.searchsorted(begins, offsets, side="left")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(begins, ends, row, code, first)


@dataclass
class Runs:
    """Runs of consecutive windows that share a minimiser.

    A run holds the windows that start at ``lo..hi`` and covers the units ``lo:hi + width``.  ``key`` is the
    fingerprint of the minimising gram and ``body`` of it and all covered units, so two equal windows always lie in
    runs of equal key, and two runs of equal body hold the same windows.
    """

    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    key: np.ndarray
    body: np.ndarray


def minimiser_runs(prints: Prints, grams: np.ndarray, first: np.ndarray, width: int, gram: int) -> Runs:
    """Runs over all windows of ``width`` units inside the rows that ``first`` delimits; ``grams`` are of all units."""
    lengths = np.diff(first)
    counts = np.maximum(lengths - width + 1, 0)
    total = int(counts.sum())
    if not total:
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    at = np.arange(len(grams), dtype=np.uint64)
    best = ((grams >> bits) << bits) | at  # the leftmost gram wins a tie, in every copy of a window alike
    reach, span = 1, width - gram + 1
    while reach < span:
        step = min(reach, span - reach)
        best = np.minimum(best[: len(best) - step], best[step:])
        reach += step
    row = np.repeat(np.arange(len(counts)), counts)
    window = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    chosen = (best[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], total) - 1
    lo, hi = window[begin], window[last]
    key = grams[chosen[begin]]
    body = prints.join(key, (hi - lo).astype(np.uint64))
    for k in range(-(-(2 * width - gram) // gram)):  # grams side by side cover the run, the last one up to its end
        body = prints.join(body, grams[np.minimum(lo + k * gram, hi + width - gram)])
    return Runs(row[begin], lo, hi, key, body)
