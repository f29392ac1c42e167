"""Operator 7: toxicity by maximum-scoring segments of token log-odds.

At most ``per_class`` labelled rows of each label are sampled, and one of those that share their smallest five-word
shingle is kept, so that copies don't make chance words look significant. Document counts of words and of their first four
and five letters, pooled in ``BINS`` hash bins, give log-odds with an informative Dirichlet prior. A token's score is the largest
of its bins' log-odds, or, where none is above 0, its word's own; those of less than ``least_z`` standard errors count as 0. All are lessened by
``drift``, so that the expected score of clean text is below 0. A linear scan finds all maximal scoring segments of a text.

Karlin-Altschul statistics of the clean rows give the rate by which a segment's score, less the logarithm of the text's length, becomes its
worth; segments of positive worth are the significant passages, and their sum, or else the best worth, is the text's extreme value.
A Gumbel distribution is fitted to the extreme values of clean rows that have any scoring token. Token scores for that are learnt from the
other half of the rows, so the fit isn't flattered. The chance that clean text reaches the value is the share of clean rows with a scoring token times the Gumbel
tail; a logistic regression on minus its logarithm, over the same rows, gives the score.

Edge cases: a null, empty or wordless text, and one without a scoring token, has no passage and the lowest score of all; repeated rows
score alike; equal scores keep text order; with rows of only one label every score is that label; without labelled rows
every score is 0. Whole texts are scanned. A column whose name is an output's is replaced, others pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import CACHE, WordHashes, batches, checkpointed, extended, fold, hash64, labelled_sample, map_arrow, shingle_hashes, word_array, words_of
from gleaner.sources.tables import read_table

BINS, MOST_SURPRISE = 1 << 20, 40.0


def bins_of(word: str) -> tuple[int, ...]:
    return tuple(hash64(w) % BINS for w in (word, f"5 {word[:5]}", f"4 {word[:4]}")[: 3 if len(word) > 5 else 2 if len(word) > 4 else 1])


class _Bins(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = bins_of(word)
        return found


class _Scores(dict):
    def __init__(self, odds: np.ndarray, drift: float):
        self.odds, self.drift = odds, drift

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        odds = [float(self.odds[b]) for b in bins_of(word)]
        self[word] = found = (max(odds) if max(odds) > 0 else odds[0]) - self.drift
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    stack: list[list] = []  # start, end, sum before, sum with it, place of the nearest one with a smaller sum before
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    for p, low, total in zip(at.tolist(), upto[at].tolist(), upto[at + 1].tolist(), strict=True):
        start = p
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append([start, p + 1, low, total, j])
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


@dataclass
class Toxicity:
    odds: np.ndarray
    drift: float
    rate: float  # of worth by score
    reached: float  # share of clean rows with a scoring token
    location: float
    scale: float
    share: float | None  # of toxic rows; None without any labelled rows
    line: tuple[float, float] = (0.0, 1.0)  # log-odds of "toxic" by the surprise

    def passages(self, s: np.ndarray) -> tuple[list[tuple[int, int, float]], float]:
        """Significant segments of a text's token scores, and its extreme value, minus infinity without a scoring token."""
        found = segments(s)
        if not found:
            return [], -math.inf
        worth = [(a, b, self.rate * x - math.log(len(s) + 1)) for a, b, x in found]
        above = [x for x in worth if x[2] > 0]
        return above, sum(x[2] for x in above) if above else max(x[2] for x in worth)

    def surprise(self, value: np.ndarray) -> np.ndarray:
        """Minus the logarithm of the chance that a clean text reaches the value; 0 without a scoring token."""
        z = np.clip((value - self.location) / self.scale, -700, 700)
        tail = np.where(z > 30, np.exp(-z), -np.expm1(-np.exp(-np.minimum(z, 30))))
        return np.where(np.isinf(value), 0.0, -np.log(self.reached * np.maximum(tail, 1e-300)))

    def probability(self, value: np.ndarray) -> np.ndarray:
        if self.share is None or self.share in (0, 1):
            return np.full(len(value), self.share or 0.0)
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * np.minimum(self.surprise(value), MOST_SURPRISE), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, 0 at least, of a logistic regression, steadied by half a row of each label at both ends."""
    x, y = np.concatenate([x, [0, 0, MOST_SURPRISE, MOST_SURPRISE]]), np.concatenate([y, [0, 1, 0, 1]])
    weight, b = np.concatenate([weight, [0.5, 0.05, 0.05, 0.5]]), np.zeros(2)
    f = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ b, -30, 30)))
        b = b + np.linalg.solve((f * (weight * p * (1 - p) + 1e-9)[:, None]).T @ f + 1e-6 * np.eye(2), f.T @ (weight * (y - p)))
    return float(b[0]), max(float(b[1]), 0.0)


def _karlin(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(rate * score) = 1 over the tokens of clean rows."""
    share = counts / max(counts.sum(), 1)
    mean = lambda rate: (share * np.exp(np.minimum(rate * values, 700))).sum()
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def _log_odds(n: np.ndarray, prior: float, least_z: float) -> np.ndarray:
    """From document counts of both labels, the log-odds that are at least ``least_z`` standard errors from 0, 0 for the others."""
    a = prior * n.sum(0) + 1e-3
    odds = [np.log((n[y] + a) / (n[y].sum() + a.sum() - n[y] - a)) for y in (0, 1)]
    delta = odds[1] - odds[0]
    error = np.sqrt(1 / (n[0] + a) + 1 / (n[1] + a))
    return np.where(np.abs(delta) >= least_z * error, np.clip(delta, -8, 8), 0).astype(np.float32)


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn, per_class: int = 5000, label: str = "toxic", drift: float = 0.25, prior: float = 0.03, least_z: float = 2.5, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """The driver gets, of each sampled row, its bins, at most three numbers a word, and then its extreme value."""
    sample = checkpointed(labelled_sample(docs, labels, label, learn, per_class, id_col, text_col))
    spark = docs.sparkSession

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hashes = _Bins(), WordHashes()
        for batch, texts in batches(it, "text"):
            words = [words_of(t) for t in texts]
            keys = [int(h.min() >> np.uint64(1)) if len(h := shingle_hashes(word_array(w, hashes), 5)) else -1 for w in words]
            bins = [np.unique(np.fromiter((b for x in set(w) for b in cache[x]), np.int32)).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(keys, pa.int64()), pa.array(bins, pa.binary())], ["label", "key", "bins"])

    half_of = lambda key: hash64(str(key)) & 1
    n, seen = np.zeros((2, 2, BINS)), set()  # by half and label
    for r in sorted(map_arrow(sample, count, "label int, key long, bins binary").collect(), key=lambda r: (r.key, r.label, r.bins)):
        if r.key not in seen:
            seen.add(r.key)
            n[half_of(r.key), r.label, np.frombuffer(r.bins, np.int32)] += 1
    rows = {r[label]: r["n"] for r in labels.where(learn).groupBy(label).agg(F.count("*").alias("n")).collect()}
    known = rows.get(1, 0) + rows.get(0, 0)
    model = Toxicity(_log_odds(n.sum(0), prior, least_z), drift, 1.0, 1.0, 0.0, 1.0, rows.get(1, 0) / known if known else None)
    if model.share is None or model.share in (0, 1):
        return model
    # For each half, scores learnt from the other one.
    given = spark.sparkContext.broadcast([_log_odds(n[1 - h], prior, least_z) for h in (0, 1)])

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches, hashes, sums = [_Scores(o, drift) for o in given.value], WordHashes(), [Counter(), Counter()]
        for batch, texts in batches(it, "text"):
            for y, text in zip(batch.column("label").to_pylist(), texts, strict=True):
                if y == 0:
                    h = shingle_hashes(word_array(words_of(text), hashes), 5)
                    half = half_of(int(h.min() >> np.uint64(1)) if len(h) else -1)
                    sums[half].update(dict(zip(*(x.tolist() for x in np.unique(caches[half].of(text).round(2), return_counts=True)), strict=True)))
        rows = [(h, v, c) for h in (0, 1) for v, c in sums[h].items()]
        columns = zip(*rows, strict=True) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64()), strict=True)], ["half", "value", "n"])

    clean = map_arrow(sample, spread, "half int, value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
    model.rate = _karlin(np.array([r["value"] for r in clean]), np.array([r["n"] for r in clean], np.float64))

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches, hashes = [_Scores(o, drift) for o in given.value], WordHashes()
        for batch, texts in batches(it, "text"):
            keys = [int(h.min() >> np.uint64(1)) if len(h := shingle_hashes(word_array(words_of(t), hashes), 5)) else -1 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([model.passages(caches[half_of(k)].of(t))[1] for k, t in zip(keys, texts, strict=True)], pa.float64())], ["label", "x"])

    measured = sorted((r.x, r.label) for r in map_arrow(sample, measure, "label int, x double").collect())
    x, y = np.array([r[0] for r in measured]), np.array([r[1] for r in measured], np.float64)
    hit = x[np.isfinite(x) & (y == 0)]
    model.reached = (len(hit) + 1) / ((y == 0).sum() + 2)
    held = np.concatenate([hit, -np.log(-np.log((np.arange(8) + 0.5) / 8))])  # a standard Gumbel's quantiles steady a small sample
    model.scale = float(held.std()) * math.sqrt(6) / math.pi
    model.location = float(held.mean()) - 0.5772156649 * model.scale
    weight = np.where(y == 1, rows[1] / max((y == 1).sum(), 1), rows[0] / max((y == 0).sum(), 1))
    model.line = _logistic(np.minimum(model.surprise(x), MOST_SURPRISE), y, weight)
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) and passages: start and end, in words, and score of each significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, schema = extended(docs, toxicity="double", passages="array<struct<start:int,end:int,score:double>>")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = _Scores(m.odds, m.drift)
        for batch, texts in batches(it, text_col):
            found = [m.passages(cache.of(t)) for t in texts]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            spans = pa.array([[{"start": a, "end": b, "score": x} for a, b, x in f[0]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.probability(np.array([f[1] for f in found], np.float64))), spans], [*batch.schema.names, "toxicity", "passages"])

    return map_arrow(docs, run, schema)


def op7_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = learn_toxicity(docs, labels, fold("doc_id", 4) != 2)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
