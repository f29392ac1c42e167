"""What several operators share: lineage cuts, word hashing, and the folds of the labelled rows."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
#: Entries that a per-worker cache may hold before it is emptied; a cache never changes a result.
CACHE = 200_000
M64 = (1 << 64) - 1


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session of one machine, as in tests, gets a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.sparkContext.__dict__.setdefault("_gleaner_folder", None) or tempfile.mkdtemp(prefix="gleaner")
        spark.sparkContext._gleaner_folder = base
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path, in the folder that driver and executors share."""
    return f"{_shared(spark)}/{name}_{uuid.uuid4().hex}"


class Tables:
    """Intermediate tables as Parquet in the shared folder: they cut lineage, outlive executors, and go as soon as nothing needs them."""

    ROWS = 200_000  # of a file, where the number of rows is known to be small

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.at = spark, shared_folder(spark, name), {}

    def put(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Writes the table; ``rows``: a bound of its number of rows, by which to write fewer files."""
        path = f"{self.base}/{len(self.at)}_{name}"
        schema = df.schema
        (df if rows is None else df.coalesce(max(1, -(-rows // self.ROWS)))).write.parquet(path)
        self.at[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at[name])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % mod


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class WordHashes(dict):
    """word -> unsigned 64-bit hash, computed once while it is cached."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = hash64(word)
        return h


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores, of the whole text."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_array(words: list[str], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words in text order; a shorter, nonempty text is one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Doubles in [0, 1) from hashes."""
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def batches(it: Iterable[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterable[tuple[pa.RecordBatch, list]]:
    """Slices of the record batches whose texts have about ``most`` bytes together, or a single row, with the texts."""
    for batch in it:
        column = batch.column(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, used = 0, 0
        for i, n in enumerate(sizes):
            if i > start and used + n > most:
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, used = i, 0
            used += int(n)
        if len(sizes) > start:
            yield batch.slice(start), column.slice(start).to_pylist()


def merged(it: Iterable[pa.RecordBatch], text: str, most: int = 8_000_000) -> Iterable[pa.RecordBatch]:
    """Record batches put together until their texts have ``most`` bytes, where work on a text is shared by its batch."""
    held, used = [], 0
    for batch in it:
        held.append(batch)
        used += batch.column(text).nbytes
        if used >= most:
            yield pa.concat_batches(held)
            held, used = [], 0
    if held:
        yield pa.concat_batches(held)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with batches bounded in rows and bytes, so that very long texts don't meet in one batch.

    Plans read these two settings when they run, so they stay lowered in the session; lower ones of the user's are kept.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(fn, schema)


def extended(df: DataFrame, **columns: str) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns of these names, and its schema with them at the end: a clashing column is replaced."""
    df = df.drop(*columns)
    return df, T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items())).fields])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """(label, text) of at most ``per_class`` rows of each of the labels 0 and 1: those of the smallest id hashes.

    The ids alone are broadcast, which the bound allows; a document without a text counts as empty.
    """
    known = labels.where(learn).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    order = (F.xxhash64("_id"), F.col("_id"))
    ids = known.where("_label = 0").orderBy(*order).limit(per_class).unionByName(known.where("_label = 1").orderBy(*order).limit(per_class))
    return docs.join(F.broadcast(ids), docs[id_col] == ids["_id"]).select(F.col("_label").cast("int").alias("label"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
