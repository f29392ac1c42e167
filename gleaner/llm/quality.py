"""Operator 1: a quality classifier by nearest-neighbour voting in a latent-semantic space.

Documents become hashed tf-idf vectors of words, word shapes and a few coarse ratios (repetition, capitals, symbols, word
length); a truncated singular value decomposition of at most ``per_class`` labelled rows of each label gives the latent
space. The labelled vectors are broadcast, which that parameter bounds. Every document is compared with all of them by
blocked cosine products, without an approximate index, and its ``neighbours`` nearest vote with the cube of their
cosines, each label's votes weighed by its share of the sample.

Edge cases: a null, empty or blank text has the zero vector and scores 0; cosines are rounded to five digits, and ties among neighbours go to the smaller place
in the sample; repeated rows score alike; with rows of only one label, that label is the score; without labelled rows every
score is 0.5. Further columns pass through, one named as the output is replaced; an empty table gives none. The text is scored as a whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import CACHE, batches, extended, fold, labelled_sample, map_arrow
from gleaner.sources.tables import read_table

WORD_BINS, SHAPE_BINS, RATIOS, STEPS = 3072, 960, 5, 12
BINS = WORD_BINS + SHAPE_BINS + RATIOS * STEPS


class _Words(dict):
    """word -> word bin, shape bin, capitals, letters and digits, length."""

    def __missing__(self, word: str) -> tuple[int, int, int, int, int]:
        if len(self) >= CACHE:
            self.clear()
        shape = []
        for c in word:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not shape or shape[-1] != kind:
                shape.append(kind)
        code = lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass"))
        core = "".join(c for c in word.lower() if c.isalnum())
        self[word] = found = (code(core) % WORD_BINS, WORD_BINS + code("".join(shape)) % SHAPE_BINS, sum(map(str.isupper, word)), sum(map(str.isalnum, word)), len(word))
        return found


def features(text: str | None, cache: _Words) -> np.ndarray | None:
    """Counts by bin, damped; None where there is no word."""
    counts = Counter(text.split()) if text else {}
    if not counts:
        return None
    n = np.fromiter(counts.values(), np.float64, len(counts))
    known = np.array([cache[w] for w in counts], np.int64)
    out = np.log1p(np.bincount(known[:, 0], n, BINS) + np.bincount(known[:, 1], n, BINS))
    total, chars = n.sum(), (known[:, 4] * n).sum()
    ratios = ((1 - len(n) / total), (known[:, 2] * n).sum() / chars, 1 - (known[:, 3] * n).sum() / chars, min(chars / total / 24, 1), n.max() / total)
    at = [WORD_BINS + SHAPE_BINS + i * STEPS + min(int(r**0.5 * STEPS), STEPS - 1) for i, r in enumerate(ratios)]
    out[at] = 3.0
    return out.astype(np.float32)


@dataclass
class Neighbours:
    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    k: int

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = (counts * self.idf) @ self.space
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(counts), 0.5)
        if not len(self.labels):
            return out
        k = min(self.k, len(self.labels))
        for i in range(0, len(counts), block):
            cosines = (self.embed(counts[i : i + block]) @ self.vectors.T).round(5)
            least = np.partition(cosines, -k, axis=1)[:, -k, None]
            tied = cosines == least
            near = (cosines > least) | (tied & (np.cumsum(tied, axis=1) <= k - (cosines > least).sum(1, keepdims=True)))
            near = np.nonzero(near)[1].reshape(-1, k)
            votes = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** 3 * self.weights[near]
            out[i : i + block] = (votes * self.labels[near]).sum(1) / votes.sum(1)
        return np.clip(out, 0.0, 1.0)


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for batch, texts in batches(it, "text"):
        rows = [features(t, cache) for t in texts]
        at = [np.flatnonzero(r).astype(np.int32) if r is not None else np.zeros(0, np.int32) for r in rows]
        values = [r[i] if r is not None else np.zeros(0, np.float32) for r, i in zip(rows, at, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["label", "at", "value"])


def fit(sample: DataFrame, dims: int = 64, k: int = 15, seed: int = 7) -> Neighbours:
    """Learns the space from rows (label, text); the driver gets at most BINS numbers of each."""
    rows = map_arrow(sample, _counts, "label int, at array<int>, value array<float>").collect()
    rows.sort(key=lambda r: (r.label, r.at, r.value))
    labels = np.array([r.label for r in rows], np.float64)
    x = np.zeros((len(rows), BINS), np.float32)
    for i, r in enumerate(rows):
        x[i, r.at] = r.value
    idf = np.log((1 + len(rows)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x *= idf
    norms = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x /= norms
    dims = max(1, min(dims, *x.shape)) if len(rows) else 1
    basis = np.random.default_rng(seed).standard_normal((BINS, dims + 16), np.float32)
    for _ in range(3 if len(rows) else 0):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False) if len(rows) else (0, 0, np.eye(dims + 16, dtype=np.float32))
    space = (basis @ vt[:dims].T).astype(np.float32)
    share = np.bincount(labels.astype(int), minlength=2)
    model = Neighbours(idf, space, np.zeros((0, dims), np.float32), labels, 1.0 / np.maximum(share[labels.astype(int)], 1), k)
    model.vectors = model.embed(x / np.maximum(idf, 1e-9)).astype(np.float32)
    return model


def score_quality(docs: DataFrame, model: Neighbours, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (double, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, schema = extended(docs, **{out: "double"})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = _Words(), shared.value
        for batch, texts in batches(it, text_col):
            scores = np.zeros(len(texts))
            for i in range(0, len(texts), 256):
                rows = [features(t, cache) for t in texts[i : i + 256]]
                if full := [j for j, r in enumerate(rows) if r is not None]:
                    scores[[i + j for j in full]] = m.score(np.stack([rows[j] for j in full]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, out])

    return map_arrow(docs, run, schema)


def learn_quality(docs: DataFrame, labels: DataFrame, learn, per_class: int = 2000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> Neighbours:
    return fit(labelled_sample(docs, labels, label, learn, per_class, id_col, text_col), **options)


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = learn_quality(docs, labels, fold("doc_id", 5) != 0)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


