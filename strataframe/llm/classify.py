"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's features are hashed words, word shapes and repeats of a word (weighted by tf-idf); a truncated singular value
decomposition of labelled texts gives the latent space. The labelled vectors are broadcast, every
document is compared with all of them in blocked matrix products, and its nearest neighbours' labels
are weighted by similarity. Word order, language, source and ids are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .shared import small_batches

WIDTH = 2048
#: Cells that also count words equal to the word before.
REPEATS = 16
#: Labelled texts that are learnt from, at most (those of the least hashed ids): some 3 MB of broadcast vectors.
BANK = 4096
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, then signs by themselves
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _i, _c in enumerate(b".,;:!?#$%&*|<>()[]{}\"'-_=+/\\@~^`"):
    _CLASS[_c] = 5 + _i


def features(rows: list[bytes]) -> np.ndarray:
    """(rows, WIDTH) counts: half for hashed lower-case words, half for hashed word shapes."""
    out = np.zeros((len(rows), WIDTH), np.float32)
    half = WIDTH // 2
    lower, row, begin, end = H.words([x.translate(H.LOWER) for x in rows], H.BLANK)
    if not len(row):
        return out
    kind = _CLASS[np.frombuffer(b" ".join(rows), np.uint8)]
    size = end - begin
    shape = kind[begin]
    for j in (1, 2, 3):
        shape = shape * 64 + np.where(size >= j, kind[np.maximum(end - j, begin)], 63)
    shape = shape * 8 + np.minimum(size, 21) // 3
    for at, code in ((0, lower), (half, H.mix(shape.astype(H.U)))):
        cell = row * half + (code % H.U(half)).astype(np.int64)
        out[:, at : at + half] += np.bincount(cell, minlength=len(rows) * half).reshape(len(rows), half)
    again = np.flatnonzero((lower[1:] == lower[:-1]) & (row[1:] == row[:-1]))
    out[:, :REPEATS] += np.bincount(row[again], minlength=len(rows))[:, None]
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    bank: np.ndarray
    labels: np.ndarray
    prior: float
    k: int

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        z = _unit(np.log1p(counts) * self.idf) @ self.axes
        return _unit(z)

    def score(self, rows: list[bytes]) -> np.ndarray:
        """Mean label of the k nearest labelled texts, weighted by similarity; the prior without any."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        z = self.vectors(features(rows))
        out = np.empty(len(rows))
        for a in range(0, len(rows), 256):
            near = z[a : a + 256] @ self.bank.T
            k = min(self.k, near.shape[1])
            at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** 8
            total = w.sum(1)
            vote = (w * self.labels[at]).sum(1)
            out[a : a + 256] = np.where(total > 1e-12, (vote + 1e-9 * self.prior) / (total + 1e-9), self.prior)
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit_model(counts: np.ndarray, labels: np.ndarray, axes: int = 64, k: int = 16) -> Model:
    n = len(counts)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32)
    x = _unit(np.log1p(counts) * idf)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    top = vectors[:, ::-1][:, :axes] * 1.0
    model = Model(idf, top.astype(np.float32), np.zeros((0, axes), np.float32), labels.astype(np.float64), float(labels.mean()) if n else 0.5, k)
    model.bank = model.vectors(counts).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bank: int = BANK, **options) -> Model:
    """Learn from the labelled rows of docs, bank of them at most; rows without id, label or text are left out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = H.texts(batch["text"])
            for a, b in H.slices(rows):
                packed = [x.astype(np.float32).tobytes() for x in features(rows[a:b])]
                at = [np.flatnonzero(np.frombuffer(x, np.float32)).astype(np.int16) for x in packed]
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), batch["label"].slice(a, b - a), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([np.frombuffer(x, np.float32)[i].tobytes() for x, i in zip(packed, at, strict=True)], pa.binary())], names=["doc_id", "label", "at", "n"])

    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = texts.mapInArrow(run, "doc_id long, label double, at binary, n binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    counts = np.zeros((len(got), WIDTH), np.float32)
    for i, x in enumerate(got):
        counts[i, np.frombuffer(x["at"], np.int16)] = np.frombuffer(x["n"], np.float32)
    return fit_model(counts, np.array([x["label"] for x in got]), **options)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs: 0 to 1, higher where label 1 is likelier. Texts without words get the prior."""
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = H.texts(batch["text"])
            for a, b in H.slices(rows):
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(given.value.score(rows[a:b]))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
