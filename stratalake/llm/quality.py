"""Quality scores by compression with dictionaries of good and of bad text.

`fit` builds two zstandard dictionaries from labelled training texts, one of each label.  A text is
compressed with either, and with none; a document compresses best with the dictionary of what it resembles.  The
difference of both sizes, over their sum and over the text's size, the three normalised sizes and the logarithm of
the text's size, with squares and three products, go through a penalised logistic calibration fitted on training
rows that no dictionary holds.  The score is the probability of label 1.

The fit takes a bounded sample of the labelled training rows: the SAMPLE rows of each label with the
smallest hash of their id (documented bound; the driver holds that many whole texts; a dictionary takes
a PASSAGE of each as far as DICT_BYTES go).  Scoring reads every row's whole text.

Defined results: null and empty texts have one fixed score, of an empty string; rows are scored one
for one, so repeated rows score alike; labels of null ids or null values teach nothing; with no
training label of one class the score is the constant share of the other.  Ids, languages, sources and labels are never inputs of a score.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, stats
from .tables import mapped, pick

SAMPLE = 2000
DICT_BYTES = 96 << 10
PASSAGE = 300
LEVEL = 6
FEATURES = 6
PENALTY = 5e-4


@dataclass
class Model:
    """Dictionaries, calibration weights and the constant that stands in when a class is missing."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    constant: float | None = None


def _dictionary(texts: list[bytes]) -> bytes:
    """A passage from the middle of as many texts as fit, as raw dictionary content; openings are often shared lines."""
    return b"\n".join(t[max(0, min(len(t) // 2, len(t) - PASSAGE)) :][:PASSAGE] for t in texts)[-DICT_BYTES:]


class Scorer:
    """One per Python worker: digested dictionaries and their contexts."""

    def __init__(self, model: Model):
        self.model = model
        if model.constant is None:
            self.own = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._digest(d), write_content_size=False) for d in (model.good, model.bad)]
            self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    @staticmethod
    def _digest(data: bytes) -> zstandard.ZstdCompressionDict:
        out = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.precompute_compress(level=LEVEL)
        return out

    def features(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        good, bad, plain = (c.compress for c in (*self.own, self.plain))
        for i, t in enumerate(texts):
            n, g, b, p = len(t) + 1, len(good(t)), len(bad(t)), len(plain(t))
            out[i] = (g - b) / (g + b), (b - g) / n, g / n, b / n, p / n, np.log(n)
        return out

    def scores(self, texts: list) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        return stats.sigmoid(_design(self.features(texts), self.model) @ self.model.weights)


def _design(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.clip((x - model.centre) / model.spread, -6, 6)
    return np.column_stack([np.ones(len(z)), z, z[:, :5] ** 2, z[:, 0] * z[:, 4], z[:, 1] * z[:, 4], z[:, 0] * z[:, 5]])


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model of labelled texts: every second row of each label feeds a dictionary, the others calibrate."""
    data = [t.encode() for t in texts]
    y = np.array(labels, float)
    if len(set(labels)) < 2 or min(np.bincount(np.array(labels, int))) < 4:
        return Model(b"", b"", np.zeros(1), np.zeros(1), np.ones(1), float((y.sum() + 1) / (len(y) + 2)))
    at = [np.flatnonzero(y == k) for k in (1, 0)]
    build, hold = (np.concatenate([rows[i::2] for rows in at]) for i in (0, 1))
    good, bad = (_dictionary([data[i] for i in build if y[i] == k]) for k in (1, 0))
    model = Model(good, bad, np.zeros(1), np.zeros(FEATURES), np.ones(FEATURES))
    x = Scorer(model).features([data[i] for i in hold])
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-9
    # rows weigh as their label's share of all labels, which the sample of each label evens out
    design = _design(x, model)
    model.weights = stats.logistic(design, y[hold], np.ones(len(design)), PENALTY * len(design))
    return model


def is_held_out(column):
    """crc32 of the id's decimal text mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, keep_out=is_held_out) -> Model:
    """Fits on labelled rows that `keep_out` leaves in: for each label, the `sample` ids of smallest hash.

    The chosen ids are at most 2 * sample and are sent to the scan as a broadcast join side of that size.
    """
    known = pick(labels, doc_id="long", **{label_col: "int"}).filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~keep_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label_col).alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    some = [known.filter(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    chosen = [(r["doc_id"], r["label"]) for part in some for r in part.collect()]
    if not chosen:
        return fit([], [])
    ids = documents.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    rows = pick(documents, doc_id="long", text="string").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows = sorted(((r["doc_id"], r["text"] or "", r["label"]) for r in rows), key=lambda r: zlib.crc32(str(r[0]).encode()))
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    if model.constant is None:
        share = np.bincount([r[2] for r in rows], minlength=2) / len(rows)
        whole = np.array([shares.get(0, 0), shares.get(1, 0)]) / max(1, sum(shares.values()))
        model.weights[0] += np.log(whole[1] / whole[0]) - np.log(share[1] / share[0])  # the sample evens the labels out; the score does not
    return model


_scorers: dict[int, tuple[bytes, Scorer]] = {}


def _scorer(packed: bytes) -> Scorer:
    if _scorers.get(0, (b"", None))[0] != packed:
        _scorers[0] = (packed, Scorer(pickle.loads(packed)))
    return _scorers[0][1]


def _scores(column: pa.Array, packed: bytes) -> np.ndarray:
    own = _scorer(packed)
    out = [np.zeros(0)]
    for part in kernels.slices(column):
        view = memoryview(part.data)
        out.append(own.scores([view[a:b] for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True)]))
    return np.concatenate(out)


def quality_scores(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    packed = pickle.dumps(model)

    def run(batches):
        for batch in batches:
            score = _scores(batch.column(1), packed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = mapped(pick(documents, doc_id="long", text="string"), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that the model accepts, with all their columns as they were."""
    packed, place = pickle.dumps(model), documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(pc.cast(batch.column(place), pa.string()), packed) >= threshold))

    return mapped(documents, run, documents.schema)
