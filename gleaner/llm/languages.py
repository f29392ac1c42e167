"""Operator 5: language identification by compression.

For each language, text of at most ``per_language`` documents becomes a raw-content dictionary for zstandard of at most
``dictionary`` bytes, which all these documents share evenly. Of each the driver gets at most ``per_text`` characters, in
``PIECES`` pieces spread over the whole text; of all texts only the letters count, in lower case. A document is compressed with each dictionary, in chunks of
``CHUNK`` bytes so that a long text cannot outgrow the dictionaries, and the language that gives the fewest bytes wins. Where
the margin over the second is under ``margin`` of the best size, the operator rejects: its ``lang`` is ``und``, though
``lang_best`` still names the best guess.

Edge cases: a null text or one without a letter is ``und`` with score 0, in both columns; equal sizes go to the language
with more documents to learn from, then to the one that sorts first; repeated rows agree; without any dictionary everything is ``und``. More than ``MOST_LANGUAGES``
languages to learn are refused. An empty table gives none; columns named as outputs are replaced, others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import batches, extended, fold, map_arrow
from gleaner.sources.tables import read_table

CHUNK, PIECES, MOST_LANGUAGES = 8 << 10, 4, 256


_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased runs of letters with one space between them: what is compressed."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def _fill(texts: list[bytes], most: int) -> bytes:
    """At most ``most`` bytes, of every text an even share in pieces spread over it; what short texts leave goes to the others."""
    out, left = {}, most
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share = left // (len(texts) - done) - 1  # and a space
        text = texts[i]
        if len(text) > share:
            n = max((share + 1) // PIECES - 1, 0)
            text = b" ".join(text[(len(text) - n) * k // (PIECES - 1) :][:n] for k in range(PIECES))
        out[i] = text
        left -= len(text) + 1
    return b" ".join(out[i] for i in range(len(texts)))[:most]


def learn_languages(docs: DataFrame, learn, per_language: int = 300, per_text: int = 1200, dictionary: int = 112 << 10, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Dictionaries by language; the driver gets at most ``per_language`` times ``per_text`` characters of each."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    w = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ids = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_language).drop("_n")
    size, piece = F.length(text_col), per_text // PIECES
    starts = [F.floor((size - piece) * k / (PIECES - 1)).cast("int") + 1 for k in range(PIECES)]
    spread = F.when(size <= per_text, F.col(text_col)).otherwise(F.concat_ws(" ", *[F.substring(F.col(text_col), at, F.lit(piece)) for at in starts]))
    langs = known.select(lang_col).distinct().count()
    if langs > MOST_LANGUAGES:
        raise ValueError(f"{langs} languages; at most {MOST_LANGUAGES} dictionaries are broadcast")
    # At most per_language ids of each language are broadcast.
    texts = known.join(F.broadcast(ids), (known[id_col] == ids["_id"]) & (known[lang_col] == ids["_lang"])).select("_lang", F.xxhash64("_id").alias("h"), spread.alias("t"))
    by: dict[str, list] = {}
    for r in texts.collect():
        by.setdefault(r._lang, []).append((r.h, r.t))
    frequent = [r[lang_col] for r in known.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).collect()]
    return {lang: _fill([letters(t) for _, t in sorted(by[lang])], dictionary) for lang in frequent if lang in by}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01, level: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred (``und`` also where the margin is narrow), lang_best and lang_score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    docs, schema = extended(docs, lang_pred="string", lang_best="string", lang_score="double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(shared.value)
        coders = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(shared.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch, texts in batches(it, text_col):
            pred, best, score = [], [], []
            for text in texts:
                if not coders or text is None or not any(map(str.isalpha, text)):
                    pred.append("und"), best.append("und"), score.append(0.0)
                    continue
                data = letters(text)
                parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
                sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in coders])
                order = np.argsort(sizes, kind="stable")
                first, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
                best.append(langs[order[0]])
                pred.append(langs[order[0]] if second - first >= margin * first else "und")
                score.append(float(1 / (1 + 2.0 ** -min(second - first, 60))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "lang_best", "lang_score"])

    return map_arrow(docs, run, schema)


def op5_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn_languages(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("lang_best").alias("lang_pred"), F.col("lang_score").alias("score"), (F.col("lang_pred") == "und").alias("rejected"))
