"""Quality classifier: votes of nearest neighbours in a latent-semantic space.

A text becomes a bag of hashed terms: its words, the shapes of its words (runs of upper
case, lower case, digits, signs), pairs of shapes, and marks of how often words and lines
come again. A bounded labelled sample gives tf-idf weights and, by a singular value
decomposition, the latent space. The sample's vectors are broadcast (MAX_PER_LABEL * 2
rows of DIMENSIONS floats); every document is compared with all of them, block by block,
exactly; the K nearest vote by similarity.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, remainder, texts
from .toxicity import sample_labelled

#: Bounds: labelled documents for each label, hashed shapes and words, dimensions of the latent space; voters.
MAX_PER_LABEL = 1500
SHAPES, WORDS, MARKS = 4032, 4096, 64
TERMS = 1 + SHAPES + WORDS + MARKS
#: What a word counts beside a shape.
WORD_WEIGHT = 0.1
DIMENSIONS = 48
K = 15
BLOCK = 256

_SHAPE = bytearray(range(256))
for _c in range(256):
    if 65 <= _c <= 90:
        _SHAPE[_c] = 65
    elif 97 <= _c <= 122 or _c > 127:
        _SHAPE[_c] = 97
    elif 48 <= _c <= 57:
        _SHAPE[_c] = 57
    elif _c in b" \t\n\x0b\x0c\r":
        _SHAPE[_c] = 32
_SHAPE = bytes(_SHAPE)


def shapes(text: bytes) -> list[bytes]:
    """Words as shapes: letters, digits and equal signs in a run count once."""
    if not text:
        return []
    b = np.frombuffer(text.translate(_SHAPE), np.uint8)
    keep = np.ones(len(b), bool)
    keep[1:] = b[1:] != b[:-1]
    return b[keep].tobytes().split()


def bag(text: bytes) -> dict[int, float]:
    """Hashed terms of a text with log frequencies by share of the words, so that length matters little."""
    words, shape = text.lower().split(), shapes(text)
    n = len(words)
    if not n:
        return {0: 1.0}
    c = Counter(shape)
    c.update(x + b" " + y for x, y in zip(shape, shape[1:], strict=False))
    out: dict[int, float] = defaultdict(float)  # terms that share a slot add up
    for t, k in c.items():
        out[1 + xxhash.xxh3_64_intdigest(t) % SHAPES] += math.log1p(100 * k / n)
    for w, k in Counter(words).items():
        out[1 + SHAPES + xxhash.xxh3_64_intdigest(w) % WORDS] += WORD_WEIGHT * math.log1p(100 * k / n)
    lines = text.split(b"\n")
    marks = (
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        sum(map(len, words)) / n / 20,
        min(1.0, n / len(lines) / 100),
        sum(w[-1:] in b".!?" for w in words) / n,
    )
    for i, m in enumerate(marks):
        out[TERMS - MARKS + i] = math.log1p(100 * m)
    return out


def matrix(bags: list[dict[int, float]]) -> np.ndarray:
    x = np.zeros((len(bags), TERMS), np.float32)
    for i, b in enumerate(bags):
        x[i, list(b)] = list(b.values())
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The positions of each row's ``k`` largest values, of equal ones the first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(1) > k):  # ties at the border
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


@dataclass
class Neighbours:
    """The latent space (idf weights and basis) and the labelled vectors in it."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    rate: float

    def project(self, bags: list[dict[int, float]]) -> np.ndarray:
        return unit(unit(matrix(bags) * self.idf) @ self.basis)

    def vote(self, bags: list[dict[int, float]], k: int = K) -> np.ndarray:
        """Share of label 1 among the ``k`` most similar labelled vectors, weighted by similarity; ties by position."""
        if not len(self.vectors):
            return np.full(len(bags), self.rate)
        out, k = [], min(k, len(self.vectors))
        for i in range(0, len(bags), BLOCK):
            cosine = self.project(bags[i : i + BLOCK]) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.clip(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-3, 1) ** 8
            out.append((weight * self.labels[near]).sum(1) / weight.sum(1))
        return np.clip(np.concatenate(out), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = MAX_PER_LABEL, dimensions: int = DIMENSIONS) -> Neighbours:
    """Learn the space from at most ``2 * per_label`` labelled documents (crc32 of the id modulo 5 not 0)."""

    def step(batch: pa.RecordBatch) -> dict:
        bags = [bag(t) for t in texts(batch)]
        return {
            "doc_id": column(batch, "doc_id"),
            "label": column(batch, "label"),
            "terms": pa.array([list(b) for b in bags], pa.list_(pa.int32())),
            "values": pa.array([list(b.values()) for b in bags], pa.list_(pa.float64())),
        }

    table = arrow_map(sample_labelled(docs, labels, "quality", per_label), step, "doc_id long, label int, terms array<int>, values array<double>").toArrow()
    n = table.num_rows
    if not n:
        return Neighbours(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    ids, y = table["doc_id"].to_pylist(), table["label"].to_numpy().astype(float)
    order = np.array(sorted(range(n), key=lambda i: (xxhash.xxh3_64_intdigest(str(ids[i])), y[i])))
    # the sample as one matrix, filled from the arrow columns and changed in place: the driver holds no other copy
    terms, values = table["terms"].combine_chunks(), table["values"].combine_chunks()
    at = np.argsort(order)[np.repeat(np.arange(n), np.diff(terms.offsets.to_numpy()))]
    u = np.zeros((n, TERMS), np.float32)
    u[at, terms.flatten().to_numpy()] = values.flatten().to_numpy()
    idf = np.log((1 + n) / (1 + np.count_nonzero(u, axis=0))).astype(np.float32) + 0.1
    u *= idf
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-9)
    # singular vectors by way of the documents' products, a table of the sample's size squared
    values, vectors = np.linalg.eigh((u @ u.T).astype(np.float64))
    top = [i for i in np.argsort(-values)[:dimensions] if values[i] > 1e-6]
    basis = u.T @ (vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
    return Neighbours(idf, basis, unit(u @ basis), y[order], float(y.mean()))


def quality(docs: DataFrame, space: Neighbours, threshold: float = 0.3, k: int = K) -> DataFrame:
    """Score every document: doc_id, score (0 to 1), predicted (1 if at least ``threshold``).

    Null and empty texts are a bag of one own term and get their neighbours' votes.
    Repeated rows and rows without doc_id are scored like any other. A very long text
    is one bag, a very long word one term. Of neighbours equally near, those first in
    the sample's hash order vote. An empty table gives an empty result; without
    labelled rows every score is 0.5. Other columns are left out, whatever their names.
    """

    def step(batch: pa.RecordBatch) -> dict:
        score = space.vote([bag(t) for t in texts(batch)], k)
        return {
            "doc_id": column(batch, "doc_id"),
            "score": pa.array(score, pa.float64()),
            "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32()),
        }

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents and score all: doc_id, held_out, score, predicted."""
    return quality(docs, fit(docs, labels)).select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", "predicted")
