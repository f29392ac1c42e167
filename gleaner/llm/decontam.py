"""Operator 6: benchmark decontamination by a BM25 index of the test items and block-max WAND.

The items are indexed with impacts that are BM25 contributions over the item's score for its own words, so one threshold
serves all items. Every passage of a document, ``WINDOW`` words at each ``STRIDE`` words, is a query. Terms of few items are
the essential ones: a passage is passed over if there is no item for which its essential terms in the passage, with all of
the item's other terms, reach the threshold, a bound that loses nothing. For the others block-max WAND retrieves all
items above the threshold. An item longer than ``PIECE`` words is indexed as a whole and in pieces of ``PIECE`` words at each
``STRIDE`` words, each with impacts over its own score, so that whatever the item's length a passage can hold a piece whole.
A hit is verified on the words about the passage, always for the whole item: both the item's question
(all but its last sentence, which is extended backwards to ``LEAST_ANSWER`` words or half the item, or the first two thirds of a single sentence) and its answer (the rest) must have ``overlap`` of
their distinct word pairs there.

The index is broadcast; it holds at most ``shard`` items and ``MOST_BYTES`` of text. More items are cut into several
indexes, and the documents are read once for each; number, mean length and document frequencies are those of all items.

Edge cases: null, empty and wordless texts and items have no hits; a text shorter than a window is one passage; repeated
items each have their hits, repeated rows get equal results; ties in WAND go by item; without items nothing is hit;
documents'
further columns play no part, and ``without_leaks`` returns them all. Passages cover whole texts, and no number of items or hits is capped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import batches, map_arrow, words_of
from gleaner.sources.tables import read_table

WINDOW, STRIDE, BLOCK, MOST_BYTES = 96, 32, 32, 32 << 20
PIECE = WINDOW - STRIDE  # a run of so many words lies within one passage, wherever it begins
LEAST_ANSWER = 8  # words; a shorter last sentence is taken with the words before it
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


@dataclass
class Postings:
    items: list[int]  # rows of the index: whole items and pieces
    impacts: list[float]
    block_max: list[float]
    most: float


@dataclass
class Index:
    ids: list[int]
    lengths: list[int]
    pairs: list[tuple[set, set]]
    owner: list[int]  # for each row of the index, the place of its item in the lists above
    terms: dict[str, Postings]
    essential: dict[str, int]  # term -> row of the arrays below
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    rest: np.ndarray  # for each row of the index, what its other terms add at most

    def passages(self, words: list[str], threshold: float) -> list[int]:
        """First words of the passages that may reach the threshold for some item or piece."""
        rows = np.fromiter(map(self.essential.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(rows >= 0)
        if not len(at):
            return []
        rows = rows[at]
        n = self.starts[rows + 1] - self.starts[rows]
        where = np.repeat(self.starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at, items, impacts = np.repeat(at, n), self.items[where], self.impacts[where]
        last = max(-(-(len(words) - WINDOW) // STRIDE), 0)
        keys, sums = [], []
        for back in range(-(-WINDOW // STRIDE)):
            start = at // STRIDE - back
            ok = (start >= 0) & (start <= last) & (start * STRIDE + WINDOW > at)
            keys.append(start[ok] * len(self.rest) + items[ok])
            sums.append(impacts[ok])
        keys, which = np.unique(np.concatenate(keys), return_inverse=True)
        bound = np.bincount(which, np.concatenate(sums), len(keys)) + self.rest[keys % len(self.rest)]
        return (np.unique(keys[bound >= threshold - 1e-9] // len(self.rest)) * STRIDE).tolist()


@dataclass
class Statistics:
    n: int
    mean: float
    df: dict[str, int]  # a word that isn't in it is in one item


class _Rows(dict):
    def __missing__(self, word: str) -> int:
        return -1


def _pairs(words: list[str]) -> set:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else set(words)


def _parts(text: str) -> tuple[list[str], list[str]]:
    """The words of the question and of the answer."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        words, n = [w for s in sentences for w in s], len(sentences[-1])
        n = max(n, min(LEAST_ANSWER, len(words) // 2))
        return words[:-n], words[-n:]
    words = sentences[0] if sentences else []
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def _pieces(words: list[str]) -> list[list[str]]:
    """What is indexed of an item: all of it and, if it is long, pieces of it."""
    if len(words) <= PIECE:
        return [words]
    return [words, *(words[i : i + PIECE] for i in range(0, len(words) - PIECE, STRIDE)), words[-PIECE:]]


def build_index(items: list[tuple[int, str]], threshold: float = 0.6, k1: float = 1.2, b: float = 0.75, known: Statistics | None = None) -> Index:
    """The index of ``items``, with the statistics of all items if ``known`` has them, or else of these."""
    held = [(i, words, t) for i, t in items if (words := words_of(t))]
    known = known or Statistics(len(held), sum(len(words) for _, words, _ in held) / max(len(held), 1), Counter(w for _, words, _ in held for w in set(words)))
    df = {w: known.df.get(w, 1) for _, words, _ in held for w in words}
    index, lists = Index([], [], [], [], {}, _Rows(), *[np.zeros(0)] * 4), {}
    for item, words, text in held:
        for piece in _pieces(words):
            length = len(piece)
            impacts = {w: math.log(1 + (known.n - df[w] + 0.5) / (df[w] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * length / known.mean)) for w, n in Counter(piece).items()}
            whole = sum(impacts.values())
            for w, x in impacts.items():
                lists.setdefault(w, []).append((len(index.owner), x / whole))
            index.owner.append(len(index.ids))
        question, answer = _parts(text)
        index.ids.append(item), index.lengths.append(len(words)), index.pairs.append((_pairs(question), _pairs(answer)))
    for w, rows in lists.items():
        xs = [x for _, x in rows]
        index.terms[w] = Postings([i for i, _ in rows], xs, [max(xs[j : j + BLOCK]) for j in range(0, len(xs), BLOCK)], max(xs))
    few = {w for w in lists if df[w] <= max(2, known.n // 20)}
    rest = np.ones(len(index.owner))
    for w in few:
        for i, x in lists[w]:
            rest[i] -= x
    hard = rest >= threshold - 0.1  # for items of common words, all terms are essential
    kept = {w: rows for w in sorted(lists) if (rows := [r for r in lists[w] if w in few or hard[r[0]]])}
    index.essential.update((w, i) for i, w in enumerate(kept))
    index.starts = np.concatenate([[0], np.cumsum([len(r) for r in kept.values()])]).astype(np.int64)
    index.items = np.array([i for r in kept.values() for i, _ in r], np.int64)
    index.impacts = np.array([x for r in kept.values() for _, x in r], np.float64)
    index.rest = np.where(hard, 0.0, rest)
    return index


def block_max_wand(lists: list[Postings], threshold: float) -> list[tuple[int, float]]:
    """All rows of the index whose summed impacts reach the threshold, with the sums, in order."""
    out, heads = [], [[p.items[0], 0, p] for p in lists]  # current item, place, list
    heads.sort(key=lambda h: h[0])
    slack = threshold - 1e-9
    while heads:
        bound, pivot = 0.0, -1
        for j, h in enumerate(heads):
            bound += h[2].most
            if bound >= slack:
                pivot = j
                break
        if pivot < 0:
            break
        item = heads[pivot][0]
        while pivot + 1 < len(heads) and heads[pivot + 1][0] == item:
            pivot += 1
        shallow, stop = 0.0, math.inf  # blocks that hold, or come after, the pivot's item
        for h in heads[: pivot + 1]:
            p = h[2]
            j = h[1] // BLOCK
            while j + 1 < len(p.block_max) and p.items[min((j + 1) * BLOCK, len(p.items)) - 1] < item:
                j += 1
            shallow += p.block_max[j]
            stop = min(stop, p.items[min((j + 1) * BLOCK, len(p.items)) - 1])
        if shallow < slack:
            target = stop + 1
            if pivot + 1 < len(heads):
                target = min(target, heads[pivot + 1][0])
            target = max(target, item + 1)
        elif heads[0][0] == item:
            score = sum(h[2].impacts[h[1]] for h in heads[: pivot + 1])
            if score >= slack:
                out.append((item, score))
            target = item + 1
        else:
            target = item
        moved = []
        for h in heads[: pivot + 1]:
            if h[0] < target:
                p, at = h[2], h[1]
                while at < len(p.items) and p.items[at] < target:
                    block_end = (at // BLOCK + 1) * BLOCK
                    at = block_end if block_end <= len(p.items) and p.items[block_end - 1] < target else at + 1
                if at == len(p.items):
                    continue
                h[0], h[1] = p.items[at], at
            moved.append(h)
        heads = sorted(moved + heads[pivot + 1 :], key=lambda h: h[0])
    return out


def hits(words: list[str], index: Index, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(item, word, score, question overlap, answer overlap) of each item that a text holds, at its best passage."""
    passed: dict[int, list[tuple[float, int]]] = {}
    for start in index.passages(words, threshold):
        terms = {w for w in words[start : start + WINDOW] if w in index.terms}
        if sum(index.terms[w].most for w in terms) < threshold - 1e-9:
            continue
        for row, score in block_max_wand([index.terms[w] for w in sorted(terms)], threshold):
            passed.setdefault(index.owner[row], []).append((-score, start))
    found = []
    for at in sorted(passed):
        n, failed = index.lengths[at], set()
        for score, start in sorted(passed[at]):
            span = max(start - n, 0), min(start + WINDOW + n, len(words))
            if span in failed:
                continue
            there = words[slice(*span)]
            near = _pairs(there) | set(there)
            question, answer = (len(p & near) / len(p) if p else 1.0 for p in index.pairs[at])
            if question >= overlap and answer >= overlap:
                found.append((index.ids[at], start, -score, question, answer))
                break
            failed.add(span)
    return found


def _shards(items: DataFrame, shard: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    part, used = [], 0
    for r in items.where(F.col(text_col).isNotNull()).select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        size = len(r[1]) * (3 if len(words_of(r[1])) > PIECE else 1)  # pieces overlap by half
        if part and (len(part) == shard or used + size > MOST_BYTES):
            yield part
            part, used = [], 0
        part.append((r[0], r[1]))
        used += size
    yield part


def statistics(items: DataFrame, text_col: str) -> Statistics:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches(it, "text"):
            held = [words for t in texts if (words := words_of(t))]
            df = Counter(w for words in held for w in set(words))
            counts = [(None, len(held), sum(map(len, held))), *((w, n, 0) for w, n in df.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*counts, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["word", "n", "length"])

    rows = map_arrow(items.select(F.col(text_col).alias("text")), run, "word string, n long, length long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    out = Statistics(0, 0.0, {})
    for r in rows.where("word IS NULL OR n > 1").toLocalIterator():
        if r.word is None:
            out.n, out.mean = r.n, r.length / max(r.n, 1)
        else:
            out.df[r.word] = r.n
    return out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, shard: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, word, score, question, answer), one row for each item that a document holds."""
    out, shards = None, _shards(items, shard, item_col, text_col)
    first, more = next(shards), list(islice(shards, 1))
    known = statistics(items, text_col) if more else None
    for part in chain([first], more, shards):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(part, threshold, known=known))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, texts in batches(it, "text"):
                rows = [(i, *h) for i, t in zip(batch.column("id").to_pylist(), texts, strict=True) for h in hits(words_of(t), index, threshold, overlap)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "item", "word", "score", "question", "answer"])

        found = map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, item long, word int, score double, question double, answer double")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` that hold no item."""
    gone = find_leaks(docs, items, id_col=id_col, **options).select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op6_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark")).groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("score").alias("score"))
    joined = docs.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return joined.select("doc_id", (F.size(items) > 0).alias("leaked"), F.size(items).alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"), "score")
