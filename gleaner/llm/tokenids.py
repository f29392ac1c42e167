"""Operator 2: token ids in compressed binary blocks.

Texts are encoded with a tokenizer file and an end id is appended to each. In ascending order of document ids, whole documents
are put into blocks of at least ``BLOCK`` ids (the last one of a part may have fewer), and each block is coded by itself by the
context-mixing range coder of ``rangecoder``, whose model starts empty at every block.

File format: Parquet files (columns part long, block int, payload binary), so that Spark's commit protocol writes them on any
store. Parts follow one another in ascending order of ids, blocks within a part too. A payload is, little-endian: ``GIDS``,
the version 2 (32 bits), the number of ids of the part before this block (64), the numbers of ids and of documents (32 each),
the CRC-32 of all the other bytes; then each document's id (64) and number of ids (32); then the coded bytes. Ids may be any
below 2^31; a larger one is refused. A wrong checksum raises an error that names the place.

A part has at most ``part_bytes`` of text, one document or the rows of one id more; a block is coded, shipped and read as a
whole, and holds no more than ``BLOCK`` ids and its last document.

Edge cases: null and empty texts are the end id alone; rows that repeat an id are adjacent, ordered by text; null ids come first
and are written as the smallest long; an empty table gives no blocks and reads back as no rows; other columns aren't written,
whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import rangecoder
from gleaner.llm.common import map_arrow, merged, shared_folder
from gleaner.sources.tables import read_table

BLOCK, END = 1 << 14, 2
_HEAD, _ENTRY = struct.Struct("<4sIQIII"), np.dtype([("id", "<i8"), ("n", "<u4")])
_FILES = "part long, block int, payload binary"
#: Two blanks, or white space other than blanks and line feeds: where these stand, cutting a text before each blank could change its ids.
_UNCUT = r"  |[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that never share a pretoken with a letter or digit before them; an apostrophe may.
MARKS = ".,;:!?$#&%*()[]{}+-=/<>@_~\"|"
#: Words that a worker's cache of ids may hold, some 200 bytes each.
WORDS = 800_000


def _marks(piece: str) -> tuple[str, str]:
    """The piece cut before the marks at its end, if a letter or digit that all versions of Unicode know stands before them."""
    stem = piece.rstrip(MARKS)
    return (stem, piece[len(stem) :]) if stem and stem[-1] < "\u0250" and stem[-1].isalnum() else (piece, "")


class Encoder:
    """Texts to ids as bytes (unsigned, 32 bits, little-endian), equal to encoding whole texts.

    Where a tokenizer's pretokens are those of plain byte-level ones, a blank after something that isn't white space begins a new
    pretoken, so a text is cut there. A lone line feed is a pretoken, too, and one ends where marks follow a letter or digit. Each different piece
    of a batch is looked up in a cache of ids that come from the tokenizer; those that it lacks are cut at feeds and marks, and what
    is still unknown is encoded together, with line feeds between that are found again in the ids. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids of pieces after a blank, and of pieces with none before them.
        self.known: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {"": b""}
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        if hasattr(self.tokenizer.model, "_resize_cache"):  # it would only hold what this cache lacks
            self.tokenizer.model._resize_cache(0)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        pretokens = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        plain = pretokens.get("type") == "ByteLevel" and pretokens.get("use_regex") and not pretokens.get("add_prefix_space")
        self.cuts = bool(plain and self.tokenizer.normalizer is None and len(feed) == 1)
        self.feed = feed[0] if self.cuts else -1

    def _all(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, table: dict[str, bytes], pieces: list[str], before: str) -> None:
        """Adds the ids of each piece after a blank or nothing to the table; no piece is empty or holds a line feed."""
        for k in range(0, len(pieces), 512):
            some = pieces[k : k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([before + f"\n{before}".join(some)], add_special_tokens=False)[0].ids, "<u4")
            feeds = (4 * np.flatnonzero(ids == self.feed)).tolist()
            if len(feeds) == len(some) - 1:
                held = ids.tobytes()
                table.update(zip(some, (held[a:b] for a, b in zip([0, *(f + 4 for f in feeds)], [*feeds, len(held)], strict=True)), strict=True))
            else:
                table.update(zip(some, self._all([before + p for p in some]), strict=True))

    def _after_blank(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if not new:
            return found
        # The tables are cut back before, never while their entries are in use; those that came first are the frequent ones.
        self.known, self.bare = (dict(islice(t.items(), WORDS // 2)) if len(t) + len(new) > WORDS else t for t in (self.known, self.bare))
        whole, made, blank, bare = [], {}, [], set()
        for p in new:
            if p.isalpha():
                blank.append(p)
            elif all(parts := p.split("\n")):
                made[p] = (stem, tail), *others = [_marks(x) for x in parts]
                blank.append(stem)
                bare.add(tail)
                for pair in others:
                    bare.update(pair)
            else:
                whole.append(p)
        self._learn(self.known, [p for p in dict.fromkeys(blank) if p not in self.known], " ")
        self._learn(self.bare, [p for p in bare if p not in self.bare], "")
        feed = np.array([self.feed], "<u4").tobytes()
        for p, ((stem, tail), *others) in made.items():
            self.known[p] = self.known[stem] + self.bare[tail] + b"".join(feed + self.bare[s] + self.bare[t] for s, t in others)
        self.known.update(zip(whole, self._all([f" {p}" for p in whole]), strict=True))
        return [self.known[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null one has none."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return self._all(texts.to_pylist())
        uncut = pc.match_substring_regex(texts, f"{_UNCUT}|{self.special}" if self.special else _UNCUT)
        whole = np.flatnonzero(uncut.to_numpy(zero_copy_only=False))
        out = dict(zip(whole.tolist(), self._all(texts.take(pa.array(whole)).to_pylist()), strict=True)) if len(whole) else {}
        cut = pc.split_pattern(pc.if_else(uncut, "", texts), " ")
        bounds, coded = np.asarray(cut.offsets), cut.flatten().dictionary_encode()
        pieces, code = coded.dictionary.to_pylist(), np.array(coded.indices)
        firsts, code[bounds[:-1]] = np.unique(code[bounds[:-1]], return_inverse=True)  # with no blank before them
        code[bounds[:-1]] += len(pieces)
        table, code, ends = self._after_blank(pieces) + self._all([pieces[i] for i in firsts]), code.tolist(), bounds.tolist()
        return [out[i] if i in out else b"".join(map(table.__getitem__, code[a:b])) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that its cache lasts."""
    return Encoder(path)


def encode_blocks(docs: DataFrame, tokenizer: str, end: int = END, part_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, block, payload): the blocks of all documents, parts in ascending order of the ids."""
    rangecoder.register(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 << 20))), -(-total // part_bytes))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", F.col("text").asc_nulls_first())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        last, held, entries, used = np.array([end], "<u4").tobytes(), [], [], 0

        def emit() -> pa.RecordBatch:
            columns = ([part], [block], [start], [b"".join(held)], [np.array(entries, _ENTRY).tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "start", "ids", "docs"])

        for batch in merged(it, "text"):
            for doc, ids in zip(batch.column("id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                held += (ids, last)
                n = len(ids) // 4 + 1
                entries.append((doc, n))
                used += n
                if used >= BLOCK:
                    yield emit()
                    block, start = block + 1, start + used
                    held, entries, used = [], [], 0
        if used:
            yield emit()

    blocks = map_arrow(ordered, run, "part long, block int, start long, ids binary, docs binary")
    return blocks.select("part", "block", F.expr(f"{rangecoder.PACK}(ids, docs, start)").alias("payload"))


def write_blocks(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    encode_blocks(docs, tokenizer, **options).write.mode("errorifexists").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, start, ids, docs) of each block in the files at ``path``, checked and decoded: ids and documents' entries as in the file format."""
    rangecoder.register(spark)
    entries = F.expr(f"substring(payload, {_HEAD.size + 1}, cast({_ENTRY.itemsize} * {_number(20, 4)} AS int))")
    return spark.read.schema(_FILES).parquet(path).select("part", F.expr(_number(8, 8)).alias("start"), F.expr(f"{rangecoder.UNPACK}(payload)").alias("ids"), entries.alias("docs"))


def _number(at: int, size: int) -> str:
    """SQL of a little-endian number in the payload."""
    turned = f"reverse(regexp_replace(hex(substring(payload, {at + 1}, {size})), '(.)(.)', '$2$1'))"
    return f"cast(conv({turned}, 16, 10) AS bigint)"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at ``path``; only a row for each part is shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for part, start, ids, docs in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "ids", "docs")), strict=True):
                at, data = 0, memoryview(ids)
                for e in np.frombuffer(docs, _ENTRY).tolist():
                    rows.append((part, e[0], start + at // 4, e[1], zlib.crc32(data[at : at + 4 * e[1]])))
                    at += 4 * e[1]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = map_arrow(read_blocks(spark, path), run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    heads = spark.read.schema(_FILES).parquet(path).select("part", (F.expr(_number(8, 8)) + F.expr(_number(16, 4))).alias("upto"))
    sizes = heads.groupBy("part").agg(F.max("upto").alias("ids"))
    before = sizes.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op2_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark, "token_ids")
    write_blocks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
