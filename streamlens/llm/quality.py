"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are character-class trigrams over all its bytes, and bins of a few whole-text ratios (repetition,
compressibility, line and word shapes). Term weights and the latent directions (a truncated SVD of the weighted terms) are fitted
on a bounded sample of labelled rows; the sample's latent vectors are broadcast, every text's cosines with all of them are exact
blocked products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_bucket, id_text, map_slices

#: Most labelled rows of each label that the classifier is fitted on and that are broadcast as vectors.
SAMPLE = 2500
DIMENSIONS = 48
NEIGHBOURS = 15
#: Neighbours' votes weigh as this power of their cosine.
SHARPNESS = 8.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_CLASSES = 14
_CLASS = np.full(256, 13, np.uint16)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:", b"!?", b"'\"-()", b"|\t", b"$%&*#@", b"<>{}[]/\\=+_~^`")):
    _CLASS[list(_chars)] = _k
_CLASS[128:192] = 11
_CLASS[192:] = 12
_BINS = 10
_RATIOS = 9
TERMS = _CLASSES**3 + _RATIOS * _BINS
#: How much the bins of one ratio weigh against all trigrams.
_RATIO_WEIGHT = 0.35


def terms(text: str) -> np.ndarray:
    """The term vector of a whole text; an empty one has only ratio terms."""
    raw = text.encode()
    out = np.zeros(TERMS, np.float32)
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(c) > 2:
        grams = np.bincount(c[:-2] * _CLASSES**2 + c[1:-1] * _CLASSES + c[2:], minlength=_CLASSES**3)
        out[: _CLASSES**3] = np.sqrt(grams / (len(c) - 2))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    kinds = np.bincount(c, minlength=_CLASSES) / max(1, len(raw))
    ratios = (
        np.log1p(len(words)) / 12,
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        len(set(words)) / n,
        min(1.0, len(zlib.compress(raw, 1)) / max(16, len(raw))),
        1 - len(set(lines)) / len(lines),
        min(1.0, len(raw) / n / 16),
        np.sqrt(kinds[1]),
        np.sqrt(kinds[5:11].sum()),
        min(1.0, n / len(lines) / 60),
    )
    for k, r in enumerate(ratios):
        at = min(max(float(r), 0.0), 1.0) * (_BINS - 1)
        low = min(int(at), _BINS - 2)
        first = _CLASSES**3 + k * _BINS + low
        out[first], out[first + 1] = _RATIO_WEIGHT * (low + 1 - at), _RATIO_WEIGHT * (at - low)
    return out


@dataclass
class Voters:
    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.weights) @ self.directions
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cosine = self.latent(x) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS + 1e-9
        return (vote * self.labels[near]).sum(1) / vote.sum(1)


def fit(x: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS) -> Voters:
    """Term weights (inverse document frequency), latent directions and labelled vectors of rows x with labels y; no rows: every score is 0.5."""
    if not len(y):
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y.astype(float), 0.5)
    weights = np.log1p(len(x) / (1 + (x > 0).sum(0))).astype(np.float32)
    used = np.flatnonzero(x.any(0))
    weighted = x[:, used] * weights[used]
    _, found = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    directions = np.zeros((TERMS, min(dimensions, len(used))), np.float32)
    directions[used] = found[:, ::-1][:, :dimensions]
    voters = Voters(weights, directions, np.zeros((0, 1), np.float32), y.astype(float), float(y.mean()))
    voters.vectors = voters.latent(x).astype(np.float32)
    return voters


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most `most` rows for each of the labels 0 and 1, by hash of the id, among ids for which keep holds.

    Rows with null ids or labels teach nothing; of several labels of an id the largest counts, and of several texts of an id the one with
    the least hash: an id is one row, however often it is repeated."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    found = id_text(docs).join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull())  # at most 2 * most rows are broadcast
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Voters:
    """Voters from the rows whose fold is not HELD_OUT. Only their term vectors reach the driver, sparsely."""
    sample = labelled_sample(docs, labels, "quality", hash_bucket(FOLDS) != HELD_OUT, most)

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [terms(t) for t in batch.column(1).to_pylist()]
        at = [np.flatnonzero(r).astype("<u2") for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i.tobytes() for i in at], pa.binary()), pa.array([r[i].tobytes() for r, i in zip(rows, at, strict=True)], pa.binary())], ["doc_id", "y", "at", "value"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = map_slices(sample.select("doc_id", "text", "y"), sparse, f"doc_id {kind}, y int, at binary, value binary").toPandas().sort_values("doc_id")  # an id once: 2 * most rows at most
    x = np.zeros((len(found), TERMS), np.float32)
    for k, (at, value) in enumerate(zip(found["at"], found["value"], strict=True)):
        x[k, np.frombuffer(at, "<u2")] = np.frombuffer(value, np.float32)
    return fit(x, found["y"].to_numpy(dtype=float))


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text scores as an empty one. An empty table gives none; other columns are ignored."""
    rows = id_text(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([terms(t or "") for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(x))], ["doc_id", "score"])

    return map_slices(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, columns unchanged, whose score is at least threshold. Texts are scored where they lie: no join, no shuffle.

    A null text scores as an empty one; a null id and repeated rows are rows like any other; a score of just threshold stays; an empty
    table gives none; without labels every score is 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(names.index("text")).to_pylist()
                good = held.value.score(np.stack([terms(t or "") for t in texts])) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
