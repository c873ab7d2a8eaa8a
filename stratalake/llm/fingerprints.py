"""Threshold-scaled sketches of documents: the shingle hashes below a fixed bound, now all of them, are kept.

A sketch is the sorted set of a text's 64-bit hashes of five-word shingles (a shorter text is one
shingle) that are below FRACTION of the hash range, written with 48 bits each in 8 characters.  As the
bound is the same for all texts, sketches merge by union, and the share of one text's sketch that is
in another's estimates containment however unequal both are.  The string starts with the number of
distinct shingles and a hash of them all, so equal texts have equal strings and texts whose sketches
are both empty are still told apart.

Defined results: null and empty texts have no shingles (fingerprint "0:"); two such texts have likeness 1;
sketches that keep nothing have likeness 1 where all their shingles agree, else 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .tables import mapped, pick

FRACTION = 1  # one in so many hashes is kept; 8 lost the near copies of texts below some 60 words
SHIFT = 64 - 48 - (FRACTION.bit_length() - 1)


def sketches(column: pa.Array, k: int = 5) -> list[tuple[int, int, np.ndarray]]:
    """Of each row: distinct shingles, a hash of their set, and the kept hashes in order."""
    bound, out = np.uint64((1 << 64) // FRACTION - 1), []
    for part in kernels.slices(column):
        found = kernels.shingles(kernels.words(part), k)
        for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
            own = np.unique(found.hashes[a:b])
            out.append((len(own), int(kernels.mix(own).sum(dtype=np.uint64)) if len(own) else 0, own[: np.searchsorted(own, bound, side="right")]))
    return out


def written(sketch: tuple[int, int, np.ndarray]) -> str:
    """The sketch as text; see `read`."""
    n, whole, kept = sketch
    if not n:
        return "0:"
    six = (kept >> np.uint64(SHIFT)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return f"{n}:{whole:016x}:{base64.b64encode(six).decode()}"


def read(text: str) -> tuple[int, int, np.ndarray]:
    """The sketch of a written fingerprint, its hashes cut to 48 bits."""
    if text == "0:":
        return 0, 0, np.zeros(0, np.uint64)
    n, whole, kept = text.split(":")
    six = np.frombuffer(base64.b64decode(kept), np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, 2:] = six
    return int(n), int(whole, 16), eight.view(">u8").ravel().astype(np.uint64)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Estimated shared part of both sets' union, 0 to 1."""
    if a[:2] == b[:2]:
        return 1.0
    both = len(a[2]) + len(b[2])
    if not both:
        return 0.0
    shared = both - len(np.union1d(a[2], b[2]))
    return shared / (both - shared)


def containment(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Estimated part of a's shingles that b has, 0 to 1; 0 where a's sketch is empty."""
    return float(np.isin(a[2], b[2], assume_unique=True).mean()) if len(a[2]) else 0.0


def merged(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> np.ndarray:
    """The sketch hashes of both texts together."""
    return np.union1d(a[2], b[2])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(written, sketches(batch.column(1)))), pa.string())], ["doc_id", "fingerprint"])

    return mapped(pick(df, **{id_col: "long", text_col: "string"}), run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_ranges(df: DataFrame, parts: int) -> DataFrame:
    """Columns (part, tail, doc_id, text): all rows by ranges of ids, each range ended by a copy of the row that follows it.

    The range bounds are quantiles of the ids; only each range's first id, at most `parts` of them,
    comes to the driver.  The last range is followed by the first.  A row without an id is in a part of its text's hash.
    """
    df = df.withColumn("text", F.coalesce("text", F.lit("")))
    bounds = np.array(sorted(set(df.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (2 * parts)) if parts > 1 else [])))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(0).to_numpy(), side="left").astype(np.int32))

    place = F.when(F.col("doc_id").isNull(), parts + F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).otherwise(part("doc_id"))
    firsts = df.select("doc_id").filter("doc_id is not null").select("doc_id", part("doc_id").alias("part")).groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()
    before = [(r["first"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]  # the first range's row follows the last range
    placed = df.select(place.alias("part"), F.lit(False).alias("tail"), "doc_id", "text")
    if not before:
        return placed
    heads = df.sparkSession.createDataFrame(before, "doc_id long, part int")
    tails = df.filter(F.col("doc_id").isin([b[0] for b in before])) if len(before) <= 500 else df
    return placed.unionByName(tails.join(F.broadcast(heads), "doc_id").select("part", F.lit(True).alias("tail"), "doc_id", "text"))


def edited_pairs(df: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one of the next larger id (of equal ids: the next text); after the last
    comes the first; a row without an id is followed by an empty text.  One shuffle moves the texts.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = in_ranges(pick(df, doc_id="long", text="string"), parts).repartition("part").sortWithinPartitions("part", "tail", "doc_id", "text")
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def judged(rows: list[tuple], column: pa.Array) -> Iterator[pa.RecordBatch]:
        """rows: (part, tail, doc_id, text), the last only as the one before's follower."""
        marks = sketches(column)
        take = [i for i in range(len(rows) - 1) if not rows[i][1]]
        nexts = ["" if rows[i][2] is None else rows[i + 1][3] for i in take]
        texts = [edited(rows[i][3], n) for i, n in zip(take, nexts, strict=True)]
        changed = sketches(pa.array(texts, pa.large_string()))
        empty = (0, 0, np.zeros(0, np.uint64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in take], pa.int64()),
                pa.array([len(rows[i][3]) for i in take], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                pa.array([written(marks[i]) for i in take], pa.string()),
                pa.array(list(map(written, changed)), pa.string()),
                pa.array([likeness(marks[i], c) for i, c in zip(take, changed, strict=True)], pa.float64()),
                pa.array([likeness(marks[i], empty if rows[i][2] is None else marks[i + 1]) for i in take], pa.float64()),
            ],
            schema=kinds,
        )

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            part, tail, ids = (batch.column(i).to_pylist() for i in range(3))
            for first, texts in kernels.text_lists(batch.column(3), 4 * kernels.SLICE_BYTES):
                rows = held + list(zip(part[first:], tail[first:], ids[first:], texts, strict=False))
                yield from judged(rows, pa.array([r[3] for r in rows], pa.large_string()))
                held = rows[-1:]
        if held and not held[0][1]:
            yield from judged([*held, (None, True, None, "")], pa.array([held[0][3], ""], pa.large_string()))

    return mapped(ready, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
