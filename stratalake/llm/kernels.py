"""Vectorised text kernels that the operators of this subpackage share.

Every kernel works on slices of an Arrow string column, as bytes, so that memory is bounded by
the slice and the longest single text, not by the batch.  A word is a maximal run of bytes other
than 0x20 and 0x09-0x0D after A-Z became a-z; UTF-8 keeps these bytes for ASCII alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SIGNS = SPACES | np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """`n` fixed 64-bit numbers of a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_BYTE_VALUE = constants(256, 0xB17E)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out, out=out)


@lru_cache(maxsize=1)
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return _powers(_BASE, n), _powers(_BASE_INV, n)


@dataclass
class Slice:
    """Consecutive rows of a string column: row i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of at most `limit` bytes; a longer text is a slice of its own."""
    offsets, data = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, i + 65536)
        yield Slice(i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        i = j


@dataclass
class Words:
    """Words of a slice: row r has words bounds[r]:bounds[r + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words(part: Slice, spaces: np.ndarray = SPACES) -> Words:
    """64-bit hashes and byte places of all words of a slice; `spaces` says which bytes part words."""
    n = len(part.data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(part) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    gap = spaces[part.data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    edges = part.offsets[1:-1]
    before[edges[edges < n]] = True
    after[edges[edges > 0] - 1] = True
    solid = ~gap
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return Words(_word_hashes(part.data, starts, ends), np.searchsorted(starts, part.offsets), starts, ends)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words by prefix sums over at most about SLICE_BYTES at a time, however long the slice or a word is."""
    out = np.empty(len(starts), np.uint64)
    power, inverse = _power_tables(SLICE_BYTES)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + SLICE_BYTES - 1, side="right"))
        if j <= i:  # one word above a slice
            value, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for at in range(low, int(ends[i]), SLICE_BYTES):
                some = data[at : min(at + SLICE_BYTES, int(ends[i]))]
                value += (_BYTE_VALUE[LOWER[some]] * power[: len(some)]).sum(dtype=np.uint64) * factor
                factor *= np.uint64(pow(_BASE, SLICE_BYTES, 1 << 64))
            out[i] = value[0]
            i += 1
            continue
        high = int(ends[j - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[LOWER[data[low:high]]] * power[: high - low], out=total[1:])
        out[i:j] = (total[ends[i:j] - low] - total[starts[i:j] - low]) * inverse[starts[i:j] - low]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Shingles:
    """Shingle hashes of a slice: row r has hashes[bounds[r]:bounds[r + 1]]; repeats stay.

    at: the first word of each, as an index into the slice's words.
    """

    hashes: np.ndarray
    bounds: np.ndarray
    at: np.ndarray


@lru_cache(maxsize=8)
def _salts(k: int) -> np.ndarray:
    return constants(k, 0x5417)


def shingles(found: Words, k: int = 5, short: bool = True) -> Shingles:
    """All runs of `k` words; with `short`, a row of fewer words has its whole sequence as one."""
    salt = _salts(k)
    count = np.diff(found.bounds)
    n = len(found.hashes)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if len(full) else 0):
        full += (found.hashes[j : n - k + 1 + j] ^ salt[j]) * (salt[j] | np.uint64(1))
    inside = np.zeros(n + 1, np.int64)
    inside[found.bounds[:-1][count > 0]] += 1
    row = np.cumsum(inside[:n]) - 1
    last = found.bounds[1:][count > 0]
    keep = np.arange(len(full)) + k <= last[row[: len(full)]] if len(full) else np.zeros(0, bool)
    hashes, at = mix(full[keep] + np.uint64(k)), np.flatnonzero(keep)
    sizes = np.maximum(count - k + 1, 0)
    if short and (few := np.flatnonzero((count > 0) & (count < k))).size:
        total = count[few].astype(np.uint64)
        for j in range(k - 1):
            has = count[few] > j
            total[has] += (found.hashes[found.bounds[few[has]] + j] ^ salt[j]) * (salt[j] | np.uint64(1))
        place = np.concatenate([[0], np.cumsum(sizes)])[few]
        hashes, at = np.insert(hashes, place, mix(total)), np.insert(at, place, found.bounds[few])
        sizes[few] = 1
    return Shingles(hashes, np.concatenate([[0], np.cumsum(sizes)]), at)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def text_lists(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of consecutive slices of about `limit` bytes; nulls are empty."""
    column = strings(column)
    offsets, _ = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1), i + 65536)
        yield i, column.slice(i, j - i).to_pylist()
        i = j
