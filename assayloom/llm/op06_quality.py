"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text is described by the counts of its character-class bigrams (64 classes of UTF-8 bytes, 4,096 kinds), damped by a logarithm,
and by how far its words and lines repeat, weighted by inverse document frequency and projected on the leading singular vectors of the labelled texts. The labelled
vectors (a bounded number of them) are broadcast; every document gets exact cosine products with all of them, block by block,
and its NEIGHBOURS nearest vote with a power of their similarity as weight. The score is the weighted share of votes for label 1,
drawn a little towards the share of label 1 among the labelled texts, which is also the score of a text without any bigram.

The labelled texts are at most SAMPLE, those of the smallest hash of their id among the allowed labels; all of each text is read.

Edge cases: a null text counts as an empty one; rows with a null label or doc_id are not learnt from; of several labels of one
document the greatest holds; without any label every score is 0.5; repeated rows get a score each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

SAMPLE = 4096
DIMENSIONS = 48
NEIGHBOURS = 25
POWER = 8
PRIOR_WEIGHT = 0.5
THRESHOLD = 0.3
BIGRAMS = 64 * 64
#: After the bigrams: the shares of words that repeat the word 1 to 4 words before, and of lines that repeat another.
LAGS = (1, 2, 3, 4)
KINDS = BIGRAMS + len(LAGS) + 1
REPEAT_WEIGHT = 60.0
#: Added to the number of words, so that a chance repetition in a short text weighs little.
FEW = 20
BLOCK = 256


def _classes() -> np.ndarray:
    """a-z, all capitals, all digits, space, line feed, each ASCII punctuation mark, bytes over 127, the rest."""
    table = np.full(256, 63, np.uint16)
    table[128:] = 62
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for i, c in enumerate(marks):
        table[c] = 30 + i
    table[97:123] = np.arange(26)
    table[65:91], table[48:58], table[32], table[10] = 26, 27, 28, 29
    return table


_TABLE = _classes()


def features(texts: list[str | None]) -> np.ndarray:
    """Damped bigram counts and shares of repetition, a row for each text; a text is read whole."""
    out = np.zeros((len(texts), KINDS), np.float32)
    for row, text in zip(out, texts, strict=True):
        kinds = _TABLE[np.frombuffer((text or "").encode(), np.uint8)]
        if len(kinds) > 1:
            row[:BIGRAMS] = np.bincount(kinds[:-1] * np.uint16(64) + kinds[1:], minlength=BIGRAMS)
    np.log1p(out, out=out)
    for row, text in zip(out, texts, strict=True):
        words = (text or "").split()
        for i, lag in enumerate(LAGS):
            if len(words) > lag:
                row[BIGRAMS + i] = REPEAT_WEIGHT * sum(map(eq, words, words[lag:])) / (len(words) - lag + FEW)
        lines = [x for x in (text or "").split("\n") if x]
        if len(lines) > 1:
            row[BIGRAMS + len(LAGS)] = REPEAT_WEIGHT * (len(lines) - len(set(lines))) / (len(lines) + FEW / 10)
    return out


class Neighbours:
    """Labelled vectors and the projection that made them."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.able = len(labels) > 0
        if self.able:
            self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
            rows = self._unit(counts * self.idf)
            self.axes = self._leading(rows, DIMENSIONS)
            self.vectors = self._unit(rows @ self.axes)

    @staticmethod
    def _leading(rows: np.ndarray, k: int) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration from a fixed start."""
        basis = np.random.default_rng(11).standard_normal((rows.shape[1], k + 16)).astype(np.float32)
        for _ in range(6):
            basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
        return (basis @ np.linalg.svd(rows @ basis, full_matrices=False)[2].T)[:, :k]

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
        """skip: for each row the labelled row that may not vote (itself, when labelled texts are scored)."""
        if not self.able:
            return np.full(len(counts), 0.5)
        cosine = self._unit(self._unit(counts * self.idf) @ self.axes) @ self.vectors.T
        if skip is not None:
            cosine[np.arange(len(cosine)), skip] = -1
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER
        return ((weight * self.labels[near]).sum(1) + PRIOR_WEIGHT * self.prior) / (weight.sum(1) + PRIOR_WEIGHT)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    """labels: doc_id, quality, those that may be learnt from."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).select("doc_id", "quality")
    )

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                rows = features(part.column(1).to_pylist())
                at = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
                    pa.array([r[a].tobytes() for r, a in zip(rows, at, strict=True)], pa.binary()),
                ], ["doc_id", "quality", "at", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
        .mapInArrow(sparse, f"doc_id {kind}, quality int, at binary, value binary")
        .groupBy("doc_id").agg(F.max(F.struct("quality", "at", "value")).alias("x")).select("doc_id", "x.*").orderBy("doc_id").collect()
    )
    counts = np.zeros((len(found), KINDS), np.float32)
    for row, r in zip(counts, found, strict=True):
        row[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.value, np.float32)
    return Neighbours(counts, np.array([r.quality for r in found]))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                scores = model.scores(features(part.column(1).to_pylist())).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose text is predicted good."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                yield part.filter(pa.array(model.scores(features(part.column(at).to_pylist())) >= THRESHOLD))
        release()

    return docs.mapInArrow(run, docs.schema)
