"""Blocked Bloom filters built by a job and sent to the executors in a bounded size.

A filter has blocks of 512 bits; a key sets one bit in each of its block's eight words.  The number
of blocks follows the number of keys up to MAX_BLOCKS (16 MB); beyond that only more keys pass by
chance, so a join that follows stays exact at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .tables import mapped

MAX_BLOCKS = 1 << 18
BITS_PER_KEY = 14
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
_WORDS = [f"w{i}" for i in range(8)]


def blocks_for(keys: int, most: int = MAX_BLOCKS) -> int:
    return int(min(most, max(1, -(-keys * BITS_PER_KEY // 512))))


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the eight word masks of each 64-bit key; any numbers will do, as they are mixed here."""
    keys = kernels.mix(keys.view(np.uint64))
    block = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = (keys & np.uint64(0xFFFFFFFF))[:, None]
    return block.astype(np.int64), np.uint64(1) << (((low * SALTS) & np.uint64(0xFFFFFFFF)) >> np.uint64(26))


def build(keys: Column, df: DataFrame, count: int, most: int = MAX_BLOCKS) -> np.ndarray:
    """The filter of a column of 64-bit numbers: words by block and place; partial filters are joined by or before they meet."""
    blocks = blocks_for(count, most)

    def partial(batches):
        own = np.zeros((blocks, 8), np.uint64)
        for batch in batches:
            block, masks = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            for i in range(8):
                np.bitwise_or.at(own[:, i], block, masks[:, i])
        used = np.flatnonzero(own.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(own[used, i].view(np.int64)) for i in range(8))], ["block", *_WORDS])

    parts = mapped(df.select(keys.cast("long").alias("key")), partial, "block long, " + ", ".join(f"{w} long" for w in _WORDS))
    rows = parts.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in _WORDS)).toArrow()  # at most MAX_BLOCKS rows
    out = np.zeros((blocks, 8), np.uint64)
    if rows.num_rows:
        out[rows.column("block").to_numpy()] = np.column_stack([rows.column(w).to_numpy().astype(np.int64, copy=False).view(np.uint64) for w in _WORDS])
    return out


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may have been added."""
    block, masks = _places(keys, len(table))
    return ((table[block] & masks) == masks).all(axis=1)


def having(batch_keys: pa.Array, table: np.ndarray) -> np.ndarray:
    """Places of a batch's 64-bit numbers that may have been added; nulls have not."""
    known = np.flatnonzero(np.asarray(batch_keys.is_valid()))
    return known[passes(table, batch_keys.take(pa.array(known)).to_numpy(zero_copy_only=False))]
