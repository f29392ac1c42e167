"""Operator 3: near-duplicate detection by DartMinHash on weighted five-word shingles.

A text is the weighted set of its five-word shingles, the weight being how often one occurs. Over each element, darts
fall on the plane of weight and rank with intensity one, as hashes of the element decide; those under the element's
weight are its darts, each in one of ``SIZE`` coordinates, and a coordinate keeps the hash of its earliest dart. Only ranks up
to ``RATE / total weight`` are looked at first, which fills all coordinates of most texts; texts with a gap
look further. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Signatures are cut into ``BANDS`` bands of ``ROWS``: a pair of similarity 0.8 shares a band with probability 0.9999.
Texts of equal words are collapsed to one representative before. Similarities are exact, of whole texts.

First, each member of a band's bucket is compared with one centre, the representative that lies in the largest buckets, and
connected components of the links give labels. Then the buckets that still hold different labels are compared throughout:
cut into blocks of about ``SPLIT`` members, each pair of blocks is a unit of work, in which members of different labels
are compared and only links that join two labels are given out. So no bucket is capped, no task gets a whole large bucket, and
no list of pairs is ever made; a bucket whose members are alike costs as many comparisons as it has members, one that isn't as many as
it has pairs of different labels. The links are a spanning set of the classes, not all pairs.

Edge cases: texts of fewer than five words are one shingle; texts without a word (null, empty) are alone, each its own
class; equal texts share a class; rows that repeat an id share one. Ids may be of any type that has an order; a row with a null id
gets the class of an equal text that has an id, else null, and is never dropped. ``keep_one`` passes further columns through,
whatever their names; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Tables, WordHashes, batches, map_arrow, mix, shingle_hashes, uniform, word_array, words_of
from gleaner.sources.tables import read_table

K, BANDS, ROWS = 5, 24, 5
SIZE = BANDS * ROWS
RATE = SIZE * (math.log(SIZE) + 3)
SPLIT = 256
_FIRST = -2  # ranks below 2**_FIRST make the first cell


@lru_cache(4096)
def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson number, to where nothing is left."""
    most = int(mean + 12 * math.sqrt(mean) + 16)
    logs = np.cumsum(np.log(np.maximum(np.arange(most), 1))) if most else np.zeros(1)
    return np.cumsum(np.exp(np.arange(most) * math.log(mean) - mean - logs))


def _throw(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, most: np.ndarray, best: np.ndarray, what: np.ndarray, lowest: int, highest: int) -> None:
    """Throws the darts of the elements into the cells of ranks 2**lowest .. 2**highest and keeps the earliest of each coordinate.

    ``most`` is the rank up to which each element's darts count. Cells of weight are [0, 1), [1, 2), [2, 4), ...
    """
    for v in range(int(np.ceil(np.log2(max(weight.max(initial=1.0), 1.0)))) + 1):
        low, wide = (0.0, 1.0) if v == 0 else (2.0 ** (v - 1), 2.0 ** (v - 1))
        in_v = np.flatnonzero(weight > low)
        if not len(in_v):
            break
        hv, mv = mix(h[in_v] + np.uint64(0x9E3779B97F4A7C15 * (v + 1) & (1 << 64) - 1)), most[in_v]
        for r in range(lowest, highest + 1):
            start, tall = (0.0, 2.0**r) if r == _FIRST else (2.0 ** (r - 1), 2.0 ** (r - 1))
            in_r = np.flatnonzero(mv > start)
            if not len(in_r):
                break
            cell = mix(hv[in_r] + np.uint64(0xD1B54A32D192ED03 * (r - _FIRST + 1) & (1 << 64) - 1))
            number = np.searchsorted(_poisson(wide * tall), uniform(cell), side="right")
            dart = 0
            while len(hit := np.flatnonzero(number > dart)):
                d = mix(cell[hit] + np.uint64(2 * dart + 1))
                at = in_v[in_r[hit]]
                w = low + wide * uniform(d)
                d2 = mix(d)
                rank = start + tall * uniform(d2)
                d3 = mix(d2)
                ok = (w < weight[at]) & (rank <= most[at])
                at, rank, d3 = at[ok], rank[ok], d3[ok]
                slot = doc[at] * SIZE + (d3 % np.uint64(SIZE)).astype(np.int64)
                np.minimum.at(best, slot, rank)
                first = rank == best[slot]
                what[slot[first]] = d3[first]
                dart += 1


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of SIZE hashes for each weighted set (hashes, weights), none of them empty."""
    n = len(sets)
    h = np.concatenate([s[0] for s in sets])
    weight = np.concatenate([s[1] for s in sets]).astype(np.float64)
    doc = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    total = np.array([s[1].sum() for s in sets], np.float64)
    best, what = np.full(n * SIZE, np.inf), np.zeros(n * SIZE, np.uint64)
    reach = RATE / total
    todo = np.arange(n)
    while len(todo):
        mine = np.isin(doc, todo)
        hs, ws, ds = h[mine], weight[mine], doc[mine]
        most = reach[ds]
        _throw(hs, ws, ds, most, best, what, _FIRST, int(np.ceil(np.log2(most.max()))))
        todo = np.flatnonzero(np.isinf(best.reshape(n, SIZE)).any(1))
        reach[todo] *= 2
    return what.reshape(n, SIZE)


def weighted_shingles(text: str | None, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(word_array(words_of(text), cache), K), return_counts=True)


def likeness(one: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, weights: np.ndarray, which: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of one weighted set to others, whose elements are given together; 0 where both are empty."""
    both = np.zeros(len(totals))
    if len(one[0]):
        at = np.minimum(np.searchsorted(one[0], hashes), len(one[0]) - 1)
        there = one[0][at] == hashes
        both = np.bincount(which[there], np.minimum(weights[there], one[1][at[there]]), len(totals))
    either = one[1].sum() + totals - both
    return both / np.maximum(either, 1)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    return float(likeness(a, b[0], b[1], np.zeros(len(b[0]), np.int64), np.array([b[1].sum()]))[0])


def joining(sets: list[tuple[np.ndarray, np.ndarray]], labels: list, left: list[bool], right: list[bool], threshold: float) -> list[tuple[int, int, float]]:
    """Links (i, j, similarity) between members of different labels, one on the left, one on the right, until none are left that would join labels."""
    names, label = np.unique(np.array([str(x) for x in labels]), return_inverse=True)
    root = np.arange(len(names))
    on_left, on_right = np.array(left, bool), np.array(right, bool)
    totals = np.array([w.sum() for _, w in sets], np.float64)
    which = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    hashes, weights = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    common, found = np.bincount(label).argmax(), []
    for i in np.argsort(label == common, kind="stable").tolist():  # members of the commonest label last: most of them are then done
        other = root[label] != root[label[i]]
        other &= (on_right if on_left[i] else False) | (on_left if on_right[i] else False)
        other &= np.minimum(totals, totals[i]) >= threshold * np.maximum(totals, totals[i]) - 1e-9
        on_left[i] = on_right[i] = False  # all its pairs are looked at now
        if not other.any():
            continue
        some = other[which]
        likes = likeness(sets[i], hashes[some], weights[some], which[some], totals)
        for j in np.flatnonzero(other & (likes >= threshold)).tolist():
            if root[label[i]] != root[label[j]]:
                root[root == root[label[j]]] = root[label[i]]
                found.append((i, j, float(likes[j])))
    return found


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, bands): a hash of the text's words, null without words, and the keys of its bands."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch, texts in batches(it, "text", 1_500_000):
            words = [word_array(words_of(t), cache) for t in texts]
            keys = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None for w in words]
            full = [i for i, w in enumerate(words) if len(w)]
            bands: list = [None] * len(words)
            if full:
                signed = signatures([np.unique(shingle_hashes(words[i], K), return_counts=True) for i in full]).reshape(len(full), BANDS, ROWS)
                key = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, r])
                for i, row in zip(full, key.astype(np.int64), strict=True):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "words", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, words binary, bands array<long>")


def _compared(asked: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, similarity, label_a, label_b) found in the units (u, i, j) of rows (u, i, j, id, label, left, right)."""
    rows = asked.join(texts, "id").repartition("u", "i", "j").sortWithinPartitions("u", "i", "j")
    ids = rows.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, unit, held = WordHashes(), None, []

        def links() -> pa.RecordBatch:
            found = joining([h[3] for h in held], [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], threshold) if held else []
            columns = [[name[i] for i, _, _ in found] for name in (at_id, at_label)] + [[name[j] for _, j, _ in found] for name in (at_id, at_label)] + [[s for _, _, s in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, kind, kind, kind, pa.float64()), strict=True)], ["a", "label_a", "b", "label_b", "similarity"])

        at_id, at_label, kind = [], [], None
        for batch, texts in batches(it, "text"):
            kind = batch.column("id").type
            for *here, doc, label, left, right, text in zip(*(batch.column(c).to_pylist() for c in ("u", "i", "j", "id", "label", "left", "right")), texts, strict=True):
                if here != unit:
                    if held:
                        yield links()
                    unit, held, at_id, at_label = here, [], [], []
                held.append((label, left, right, weighted_shingles(text, cache)))
                at_id.append(doc), at_label.append(label)
        if held:
            yield links()

    return map_arrow(rows.select("u", "i", "j", "id", "label", "left", "right", "text"), run, f"a {ids}, label_a {ids}, b {ids}, label_b {ids}, similarity double")


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, label): the smallest node of each connected component of the links (a, b), by alternating large and small stars."""
    edges = tables.put(f"{name}_edges", links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    rows, seen, turn = edges.count(), None, 0
    few = lambda d: d.coalesce(max(1, -(-2 * rows // tables.ROWS)))
    while rows:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = few(both.where("b > a").join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        joined = few(large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = tables.put(f"{name}_edges{turn + 1}", small, 2 * rows)
        tables.drop(f"{name}_edges{turn or ''}")
        edges, turn = after, turn + 1
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (id, class_id, copies), one row per document, and spanning links (a, b, similarity) between representatives."""
    tables = Tables(docs.sparkSession, "near_duplicates")
    hashed = tables.put("hashed", _hashed(docs, id_col, text_col))
    grouped = hashed.where("words IS NOT NULL").groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    reps = tables.put("reps", grouped, BANDS * hashed.count())  # as each row becomes so many
    rows = reps.where("rep IS NOT NULL").select(F.col("rep").alias("node"), F.explode("bands").alias("key"))
    shared = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    members = tables.put("members", shared.withColumn("c", F.sum("n").over(Window.partitionBy("node"))))
    most = members.count()
    centre = members.groupBy("key").agg(F.max(F.struct("c", F.xxhash64("node").alias("h"), "node")).alias("m")).select("key", F.col("m.node").alias("centre"))
    beside = tables.put("beside", members.select("key", "node", "n").join(centre, "key").where("node <> centre"), most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    # Members grow with the documents: the join is by merging at every size, never by broadcasting them.
    texts = tables.put("texts", texts.join(members.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi"))
    tables.drop("members")

    def spread(node: str, n: Column | str) -> Column:
        return F.pmod(F.xxhash64(node), F.ceil(F.col(n) / SPLIT)).cast("int")

    pairs = tables.put("pairs", beside.groupBy("centre", "node").agg(F.max("n").alias("n")).withColumn("i", spread("node", "n")), most)
    unit = (F.col("centre").alias("u"), "i", F.lit(0).alias("j"))
    star = pairs.select(*unit, F.col("node").alias("id"), F.col("node").alias("label"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    middle = pairs.select("centre", "i").distinct().select(*unit, F.col("centre").alias("id"), F.col("centre").alias("label"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    found = tables.put("links", _compared(star.unionByName(middle), texts, threshold))
    labels = tables.put("labels", components(found, tables, "star"), most)
    tables.drop("pairs")

    named = beside.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    either = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"), *(F.sum(F.xxhash64("node", F.lit(s)).cast("decimal(38,0)")).alias(f"set{s}") for s in (0, 1)))
    mixed = either.where("x <> y").groupBy("n", "set0", "set1").agg(F.min("key").alias("key")).select("key")  # buckets of the same members once
    rest = tables.put("rest", named.join(mixed, "key"), most)
    links, final = found.select("a", "b", "similarity"), labels
    if not rest.isEmpty():
        blocks = F.ceil(F.col("n") / SPLIT).cast("int")
        cut = rest.withColumn("at", spread("node", "n")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        cut = cut.select(F.col("key").alias("u"), F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.col("node").alias("id"), "label", "at")
        asked = cut.select("u", "i", "j", "id", "label", (F.col("at") == F.col("i")).alias("left"), (F.col("at") == F.col("j")).alias("right"))
        again = tables.put("more_links", _compared(asked, texts, threshold))
        links = links.unionByName(again.select("a", "b", "similarity"))
        merged = components(again.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), tables, "rest")
        held = labels.unionByName(rest.select("node", "label")).distinct().join(merged.select(F.col("node").alias("label"), F.col("label").alias("whole")), "label", "left")
        final = tables.put("classes", held.select("node", F.coalesce("whole", "label").alias("label")), 2 * most)
    tables.drop("beside", "rest", "texts")
    named = reps.select("words", "rep", "copies").join(final.select(F.col("node").alias("rep"), "label"), "rep", "left")
    named = named.select("words", F.coalesce("label", "rep").alias("label"), "copies")
    out = hashed.select("id", "words").join(named, "words", "left")
    return out.select("id", F.coalesce("label", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies")), links


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, and one row of it, the first by a hash of all columns."""
    kept = docs.join(classes.where("id <> class_id").select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    if twice.isEmpty():
        return kept.select(*docs.columns)
    of_row = F.struct(*(F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c in docs.columns))
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(of_row))
    again = kept.join(twice, id_col, "left_semi").select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("r"), F.row_number().over(first).alias("n")).where("n = 1").select("r.*")
    return kept.join(twice, id_col, "left_anti").select(*docs.columns).unionByName(again)


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class and how many documents have its very words."""
    classes, _ = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.withColumnRenamed("id", "doc_id")
