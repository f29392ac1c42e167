"""Operator 10: removal of repeated passages by content-defined chunks of lines.

A rolling hash over the hashes of two adjacent lines decides where chunks end, so that a shift of lines moves boundaries
with it; chunks hold four lines on the average. Where a repeated passage begins or ends inside a chunk, runs of lines and
single lines of at least ``long_line`` words catch what the chunks miss: from each line with words, forwards and backwards,
the shortest run that has ``least_words`` words and two lines with words, and windows of two lines with as many. So a passage
of several lines with words and twice ``least_words`` words in all is covered by runs inside it, however short its lines are.
A chunk of several lines counts from ``least_words`` words on, too. Keys that occur more than once anywhere are candidates; neighbouring candidates with the same
source are merged into spans, each span is compared byte by byte with its first occurrence (smallest id, then line), and
the spans that are equal are removed. So of every removed line an equal one stays at a smaller place.

Edge cases: null texts stay null, empty ones empty; texts without repeats are untouched; repeats within one text count;
rows with a null id are left alone; rows that repeat an id are taken as one document and don't repeat each other; an empty table gives none; further
columns pass through, those named as outputs are replaced. No count, text or number of occurrences is capped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import M64, WORD, Tables, batches, extended, fresh, hash64, map_arrow
from gleaner.sources.tables import read_table

DIVISOR = 4


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def pieces(text: str, least_words: int, long_line: int) -> list[tuple[int, int, int]]:
    """(key, first line, lines) of the chunks, runs, two-line windows and long lines of a text."""
    lines = text.split("\n")
    hashes = [hash64(x) for x in lines]
    words = [len(WORD.findall(x)) for x in lines]
    found = {}

    def take(start: int, end: int) -> None:
        if (start, end) not in found and sum(words[start:end]) >= (least_words if end - start > 1 else long_line):
            key = end - start
            for h in hashes[start:end]:
                key = _mixed((key * 0x9E3779B97F4A7C15 + h) & M64)
            found[start, end] = key

    start = 0
    for i in range(len(lines)):
        rolled = _mixed(((hashes[i - 1] if i else 0) * 0x9E3779B97F4A7C15 + hashes[i]) & M64)
        if rolled % DIVISOR == 0 or i == len(lines) - 1:
            take(start, i + 1)
            start = i + 1
        take(i, i + 1)
        if i:
            take(i - 1, i + 1)
    worded = [i for i, n in enumerate(words) if n]
    upto = [0, *accumulate(words[i] for i in worded)]
    for k in range(len(worded)):  # the end of the run from line k on, and the start of the run up to it
        end = max(bisect_left(upto, upto[k] + least_words), k + 2)
        if end <= len(worded):
            take(worded[k], worded[end - 1] + 1)
        first = min(bisect_right(upto, upto[k + 1] - least_words) - 1, k - 1)
        if first >= 0:
            take(worded[first], worded[k] + 1)
    return [(k - (1 << 64) if k >> 63 else k, a, b - a) for (a, b), k in found.items()]


def _spans(found: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Merges (line, lines, source id, source line) that overlap and go on in the same source."""
    out: list[list[int]] = []
    for at, n, doc, line in sorted(found, key=lambda x: (x[2], x[3] - x[0], x[0])):
        last = out[-1] if out else None
        if last and last[2] == doc and last[3] - last[0] == line - at and at <= last[0] + last[1]:
            last[1] = max(last[1], at + n - last[0])
        else:
            out.append([at, n, doc, line])
    return out


def remove_repeated(docs: DataFrame, least_words: int = 20, long_line: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with clean_text, n_lines, n_removed and removed (line, lines) spans."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, "text", 1_000_000):
            rows = [(k, i, a, n) for i, t in zip(batch.column("id").to_pylist(), texts, strict=True) for k, a, n in pieces(t, least_words, long_line)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "id", "line", "n"])

    # What grows with the documents is joined by merging at every size, never by broadcasting it.
    tables = Tables(docs.sparkSession, "line_chunks")
    chunks = tables.put("chunks", map_arrow(plain, cut, "key long, id long, line int, n int"))
    first = chunks.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("id", "line")).alias("first")).where("times > 1").select("key", F.col("first.id").alias("src"), F.col("first.line").alias("src_line"))
    again = chunks.join(first, "key").where("id <> src OR line <> src_line")
    again = again.groupBy("id").agg(F.collect_set(F.struct("line", "n", "src", "src_line")).alias("found"))

    def cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, "text", 1_000_000):
            rows = []
            for text, found in zip(texts, batch.column("found").to_pylist(), strict=True):
                lines = text.split("\n")
                rows += [(f["src"], f["line"], f["n"], "\n".join(lines[f["line"] : f["line"] + f["n"]])) for f in found]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["src", "src_line", "n", "first_span"])

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, "text", 1_000_000):
            rows = []
            for i, text, found in zip(batch.column("id").to_pylist(), texts, batch.column("found").to_pylist(), strict=True):
                lines = text.split("\n")
                rows += [(i, at, n, src, line, "\n".join(lines[at : at + n])) for at, n, src, line in _spans([(f["line"], f["n"], f["src"], f["src_line"]) for f in found])]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "line", "n", "src", "src_line", "span"])

    spans = tables.put("spans", map_arrow(plain.join(again.hint("merge"), "id"), gather, "id long, line int, n int, src long, src_line int, span string"))
    tables.drop("chunks")
    asked = spans.select("src", "src_line", "n").distinct().groupBy("src").agg(F.collect_list(F.struct(F.col("src_line").alias("line"), "n", F.col("src").alias("src"), F.col("src_line").alias("src_line"))).alias("found"))
    first_spans = map_arrow(plain.join(asked.withColumnRenamed("src", "id").hint("merge"), "id"), cut_out, "src long, src_line int, n int, first_span string")
    equal = spans.join(first_spans, ["src", "src_line", "n"]).where(F.col("span") == F.col("first_span"))  # byte by byte, once for each occurrence
    equal = equal.groupBy("id").agg(F.collect_set(F.struct("line", "n")).alias("spans"))
    equal = tables.put("equal", equal)
    tables.drop("spans")
    docs, schema = extended(docs, clean_text="string", n_lines="int", n_removed="int", removed="array<struct<line:int,n:int>>")
    key, cuts = fresh(docs, "_id"), fresh(docs, "_spans")
    joined = docs.withColumn(key, F.col(id_col).cast("long")).join(equal.select(F.col("id").alias(key), F.col("spans").alias(cuts)).hint("merge"), key, "left").select(*(f"`{c}`" for c in docs.columns), cuts)

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, text_col, 1_000_000):
            out, total, gone, where = [], [], [], []
            for text, spans in zip(texts, batch.column(cuts).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                drop = np.zeros(len(lines), bool)
                for s in spans or ():
                    drop[s["line"] : s["line"] + s["n"]] = True
                out.append(None if text is None else "\n".join(x for x, d in zip(lines, drop, strict=True) if not d))
                total.append(len(lines)), gone.append(int(drop.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                where.append([{"line": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kind = pa.list_(pa.struct([("line", pa.int32()), ("n", pa.int32())]))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != cuts]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string()), pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(where, kind)], [f.name for f in schema])

    return map_arrow(joined, clean, schema)


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"), F.to_json("removed").alias("removed"))
