"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (runs of letters, digits and non-ASCII
characters, in lower case).  The hashes of every K words are joined with the items'; each shared one is a
seed, and a document and an item whose seeds can reach the threshold are tiled.  A tiling searches the
longest run of unmarked words that both have, by Karp-Rabin hashes of all windows of a length and a
binary search over lengths, marks every free pair of that length, and goes on with the next shorter until no
run of K words is left.  The item's coverage is its share of marked words, so an item that occurs in
pieces or in another order is found as well as an exact copy.  At THRESHOLD or more the document is contaminated.

The items reach the executors in blocks of at most BLOCK_BYTES of text (an item above that is a block
of its own); each block is one pass over the documents, so the sent data has a fixed bound however
large the benchmark is.  Documents are never shuffled.  Seeds are joined as distinct hashes, and a tiling
keeps a few numbers a word, so repetitive texts cost no more memory than others.

Defined results: null and empty texts have no words and match nothing; an item of fewer than K words
is one seed, its whole sequence, if it has SHORT_BYTES bytes of words (as in scripts without spaces), and is never found
below that, as common words would be; equal items are found alike, one row each, and repeated item rows count once; items without an id
count too; repeated documents give repeated rows; longest tiles win, of equal ones the first in the document, then in the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels
from .tables import mapped, pick

K = 5
THRESHOLD = 0.5
SHORT_BYTES = 24
BLOCK_BYTES = 4 << 20
_SIEVE = 24
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


@dataclass
class Items:
    """A block of benchmark items: their words' hashes, and every distinct seed of an item with the number of its places."""

    ids: list[int | None]
    words: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    count: np.ndarray
    sieve: np.ndarray
    short: list[int]

    @staticmethod
    def of(ids: list[int | None], texts: list[str]) -> Items:
        words, bounds, seeds, item = [np.zeros(0, np.uint64)], [0], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        short = set()
        for part in kernels.slices(pc.utf8_lower(pa.array(texts, pa.large_string()))):
            found = kernels.words(part, kernels.SIGNS)
            size = np.diff(found.bounds)
            runs = kernels.shingles(found, K)
            own = np.repeat(np.arange(len(part)), np.diff(runs.bounds))
            letters = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
            held = (size >= K) | (letters[found.bounds[1:]] - letters[found.bounds[:-1]] >= SHORT_BYTES)
            short.update(size[held & (size < K) & (size > 0)].tolist())
            words.append(found.hashes)
            bounds += (found.bounds[1:] + bounds[-1]).tolist()
            seeds.append(runs.hashes[held[own]])
            item.append(own[held[own]] + part.first)
        seed, of = np.concatenate(seeds), np.concatenate(item)
        order = np.lexsort((of, seed))
        seed, of = seed[order], of[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(seed)), bool), (np.diff(seed) != 0) | (np.diff(of) != 0)]))
        bits = np.zeros(1 << (_SIEVE - 3), np.uint8)
        np.bitwise_or.at(bits, (seed >> np.uint64(64 - _SIEVE + 3)).astype(np.int64), _bit(seed))
        return Items(ids, np.concatenate(words), np.array(bounds), seed[first], of[first], np.diff(np.concatenate([first, [len(seed)]])), bits, sorted(short))

    def joined(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an index into `hashes` and one into the seeds, where both are equal."""
        maybe = np.flatnonzero(self.sieve[(hashes >> np.uint64(64 - _SIEVE + 3)).astype(np.int64)] & _bit(hashes))
        low, high = (np.searchsorted(self.seeds, hashes[maybe], side) for side in ("left", "right"))
        size = high - low
        first = np.repeat(np.cumsum(size) - size, size)
        return np.repeat(maybe, size), np.repeat(low, size) + np.arange(len(first)) - first


def _bit(hashes: np.ndarray) -> np.ndarray:
    return np.left_shift(np.uint8(1), ((hashes >> np.uint64(64 - _SIEVE)) & np.uint64(7)).astype(np.uint8))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return kernels._powers(_STEP, n), kernels._powers(_BACK, n)


class _Sequence:
    """Words with marks; hashes of all unmarked windows of a length."""

    def __init__(self, words: np.ndarray, marked: np.ndarray):
        n = len(words)
        power, self.back = _powers(1 << max(10, n.bit_length()))
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * power[:n], out=self.total[1:])
        self.marked = marked

    def free(self, size: int) -> np.ndarray:
        """Starts of windows without a marked word."""
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        return np.flatnonzero(marks[size:] == marks[: len(marks) - size]) if size < len(marks) else np.zeros(0, np.int64)

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.total[starts + size] - self.total[starts]) * self.back[starts]


def tiles(words: np.ndarray, against: np.ndarray, k: int = K, barred: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of words: (place, place in `against`, length) of each tile, the longest first.

    `barred` places of the first sequence are in no tile.
    """
    here = _Sequence(words, np.zeros(len(words), bool) if barred is None else barred.copy())
    there = _Sequence(against, np.zeros(len(against), bool))
    out: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = here.free(size), there.free(size)
        own, other = here.windows(a, size), there.windows(b, size)
        hit = np.isin(own, other)
        return a[hit], own[hit], b, other

    longest = min(len(words), len(against))
    while longest >= k:
        low, high = k - 1, longest  # a run of `low` words is common, or low is below k
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < k:
            break
        places, hashes, starts, other = common(low)
        order = np.argsort(other, kind="stable")
        sorted_, open_ = other[order], starts[order]
        next_, done = {}, 0
        for a, h in zip(places.tolist(), hashes.tolist(), strict=True):
            if a < done:
                continue
            i = next_.get(h)
            if i is None:
                i = int(np.searchsorted(sorted_, np.uint64(h)))
            while i < len(sorted_) and sorted_[i] == h and there.marked[open_[i] : open_[i] + low].any():
                i += 1
            next_[h] = i
            if i < len(sorted_) and sorted_[i] == h:
                b = int(open_[i])
                here.marked[a : a + low] = True
                there.marked[b : b + low] = True
                out.append((a, b, low))
                done = a + low
                if there.marked.all():
                    return out
        longest = low  # the same length may be left where an earlier tile of it stood in the way
        if not len(common(low)[0]):
            longest = low - 1
    return out


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES; only one block at a time is on the driver."""
    rows = pick(benchmark, item_id="long", text="string").filter("text is not null").distinct()
    ids, texts, size = [], [], 0
    for row in rows.sort("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if size >= BLOCK_BYTES:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts)


def _leaks(column: pa.Array, own: Items, threshold: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item's place in the block, covered words, the item's words, tiles) of each pair at or above the threshold."""
    lengths = np.diff(own.bounds)
    for part in kernels.slices(pc.utf8_lower(kernels.strings(column))):
        found = kernels.words(part, kernels.SIGNS)
        for size in (*own.short, K):
            runs = kernels.shingles(found, size, short=False)
            at, seed = own.joined(runs.hashes)
            if not at.size:
                continue
            row = np.searchsorted(runs.bounds, at, "right") - 1
            # a seed of an item counts once in a row, with all its places in the item; each covers K words at most
            order = np.lexsort((seed, row))
            row, seed, at = row[order], seed[order], at[order]
            once = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(seed) != 0)])
            pair = row[once] * len(lengths) + own.item[seed[once]]
            pairs, back = np.unique(pair, return_inverse=True)
            reach = np.minimum(np.bincount(back, weights=own.count[seed[once]]) * size, lengths[pairs % len(lengths)])
            for p in pairs[reach >= threshold * lengths[pairs % len(lengths)]].tolist():
                r, i = divmod(p, len(lengths))
                n = int(lengths[i])
                if size < K:
                    if n == size:
                        yield part.first + r, i, n, n, 1
                    continue
                a, b = np.searchsorted(row, [r, r + 1])
                held = np.unique(at[a:b][own.item[seed[a:b]] == i])
                # only the words of seeds can be in a tile; what lies between is left out but for a barred word
                cover = np.zeros(int(found.bounds[r + 1] - found.bounds[r]) + 1, np.int64)
                start = runs.at[held] - found.bounds[r]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + K, -1)
                inside = np.cumsum(cover[:-1]) > 0
                keep = inside | np.concatenate([[False], inside[:-1]])
                made = tiles(found.hashes[found.bounds[r] : found.bounds[r + 1]][keep], own.words[own.bounds[i] : own.bounds[i + 1]], K, ~inside[keep])
                covered = sum(x for _, _, x in made)
                if covered >= threshold * n:
                    yield part.first + r, i, covered, n, len(made)


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, covered, item_words, coverage, tiles): every contaminated document with each item that it holds."""
    kind = "doc_id long, item_id long, covered long, item_words long, coverage double, tiles long"
    texts = pick(documents, doc_id="long", text="string")
    out = None
    for block in blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            ids = pa.array(sent.value.ids, pa.int64())
            for batch in batches:
                found = list(_leaks(batch.column(1), sent.value, threshold))
                rows, items, covered, words, made = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), ids.take(pa.array(items)), pa.array(covered), pa.array(words), pa.array(covered / np.maximum(words, 1)), pa.array(made)], ["doc_id", "item_id", "covered", "item_words", "coverage", "tiles"])

        some = mapped(texts, run, kind)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else documents.sparkSession.createDataFrame([], kind)


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that no item contaminates, with all their columns as they were."""
    place = documents.columns.index(text_col)
    for block in blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in _leaks(batch.column(place), sent.value, threshold)]] = False
                yield batch.filter(pa.array(keep))

        documents = mapped(documents, run, documents.schema)
    return documents
