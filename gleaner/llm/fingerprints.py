"""Operator 9: document fingerprints by Order MinHash, from DataFrame functions only.

A text is cut into pieces: runs of at most eight characters that aren't white space. Its elements are the runs of ``K`` pieces, each numbered by its occurrence. Hashes of elements fall into ``BUCKETS`` ranges;
in each range the two smallest are kept, put into text order and hashed together. A fingerprint has, for each range, six
hex digits of that hash (``------`` where the text has no element). The likeness of two fingerprints is the share of the
ranges filled in either in which they agree; moving, repeating or replacing parts of a text changes it, as edit distance does.

All is done within a row on sorted arrays of longs that hold the leading 40 bits of a hash and a 24-bit position; a text of
over 16 million pieces counts positions modulo 2^24. Null and empty texts have an empty fingerprint, equal to one another
(likeness 1); a text of fewer pieces than ``K`` is one element. Equal texts have equal fingerprints, so repeated rows do; equal hashes
are ordered by their place in the text; an empty table gives none; further columns pass through, one named fingerprint is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.sources.tables import read_table

K, BUCKETS, HEX = 3, 64, 6
PIECES = r"\S{1,8}"
_LOW = (1 << 24) - 1


def _high(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.bitwiseAND(F.lit(~_LOW).cast("long"))


def fingerprint_array(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Adds ``out``: for each range, 24 bits of its tuple's hash, or -1. Each step is a projection of its own, so that none is computed twice."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECES), F.lit(0))
    df = df.withColumn("_p", pieces)
    gram = lambda i: F.xxhash64(F.get("_p", i), *(F.get("_p", i + j) for j in range(1, k)))
    elements = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_p") - k, F.lit(0))), lambda i: _high(gram(i)).bitwiseOR(i.cast("long")))
    df = df.withColumn("_e", F.sort_array(F.when(F.size("_p") > 0, elements).otherwise(F.array().cast("array<bigint>")))).drop("_p")
    differ = lambda x, i, shift: F.shiftrightunsigned(F.get("_e", i).bitwiseXOR(x), shift)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(24))])
    occurrence = lambda x, i: i - F.aggregate(steps, i, lambda at, step: F.when(differ(x, at - step, 24) == 0, at - step).otherwise(at))
    again = lambda x, i: _high(F.xxhash64(_high(x), occurrence(x, i))).bitwiseOR(x.bitwiseAND(F.lit(_LOW).cast("long")))
    df = df.withColumn("_e", F.sort_array(F.transform("_e", lambda x, i: F.when(differ(x, i - 1, 24) == 0, again(x, i)).otherwise(x))))
    df = df.withColumn("_m", F.filter("_e", lambda x, i: ~differ(x, i - 2, 58).eqNullSafe(F.lit(0)))).drop("_e")
    bucket, pos = lambda x: F.shiftrightunsigned(x, 58), lambda x: x.bitwiseAND(F.lit(_LOW).cast("long"))

    def pair(x: Column, y: Column) -> Column:
        both = F.when(pos(x) <= pos(y), F.xxhash64(_high(x), _high(y))).otherwise(F.xxhash64(_high(y), _high(x)))
        return F.when(bucket(y) == bucket(x), both).otherwise(F.xxhash64(_high(x))).bitwiseAND(F.lit(_LOW).cast("long")).cast("int")

    # Buckets are signed here, as the sort is: of each range, the place of its first element, found by counting smaller ones.
    firsts = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (i == 0) | (bucket(F.get("_m", i)) != bucket(F.get("_m", i - 1))))
    heads = F.when(F.size("_m") > 0, F.transform(firsts, lambda i: F.struct(bucket(F.get("_m", i)).cast("int").alias("b"), pair(F.get("_m", i), F.get("_m", i + 1)).alias("h"))))
    df = df.withColumn("_t", F.coalesce(heads, F.array().cast("array<struct<b:int,h:int>>"))).drop("_m")
    df = df.withColumn("_k", F.transform("_t", lambda v: v["b"]))
    table = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.get("_t", F.array_position("_k", b).cast("int") - 1)["h"], F.lit(-1)))
    # The second reference to each array keeps the optimizer from moving its making into the loop over the ranges.
    return df.withColumn(out, F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), table)).drop("_t", "_k")


def fingerprint_text(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda h: F.when(h < 0, F.lit("-" * HEX)).otherwise(F.lower(F.lpad(F.hex(h), HEX, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    either = F.zip_with(a, b, lambda x, y: F.when((x < 0) & (y < 0), F.lit(None)).otherwise((x == y).cast("int")))
    filled = F.filter(either, lambda v: v.isNotNull())
    return F.when(F.size(filled) == 0, 1.0).otherwise(F.size(F.filter(filled, lambda v: v == 1)) / F.size(filled)).cast("double")


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with fingerprint (string)."""
    kept = [f"`{c}`" for c in docs.columns if c.lower() != "fingerprint"]
    rows = fingerprint_array(docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text")), "text", "prints")
    return rows.select("row.*", fingerprint_text(F.col("prints")).alias("fingerprint"))


def with_next(rows: DataFrame, ids: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows by ``id_col`` (after the last: the first).

    ``ids`` has the same ids. Rows are dealt by ranges of the id between quantiles, eight for each shuffle partition, and
    the first row of each range is also sent to the range before it; so one shuffle does, and no task sees all rows. Null
    ids come first; rows of one id are ordered by ``columns``.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63)).cast("long")).cast("double")
    blocks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(ids.select(key.alias("k")).approxQuantile("k", [i / blocks for i in range(blocks)], 0.2 / blocks)))
    if not bounds:
        bounds = [0.0]
    bounds[0] = float(ids.agg(F.min(key)).first()[0] or bounds[0])
    at, n = F.array(*map(F.lit, bounds)), len(bounds)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    seek = lambda acc, s: F.when((acc + s <= n) & (F.get(at, acc + s - 1) <= key), acc + s).otherwise(acc)
    rows = rows.withColumn("_b", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), seek) - 1)
    here, before = F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost")), F.struct(F.pmod(F.col("_b") - 1, F.lit(n)).alias("b"), F.lit(1).alias("ghost"))
    rows = rows.withColumn("_d", F.explode(F.when(F.get(at, F.col("_b")) == key, F.array(here, before)).otherwise(F.array(here))))
    w = Window.partitionBy("_d.b").orderBy("_d.ghost", F.col(id_col).asc_nulls_first(), *columns)
    out = rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("_d.ghost = 0")
    return out.drop("_b", "_d")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprint_array(rows, "text", "fp"), docs.select("doc_id"), "doc_id", ["text", "fp"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_q", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("left(text, cast(n_chars - _q as int))"), F.expr("left(next_text, _q)"))
    rows = fingerprint_array(rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("_edited")), "_edited", "_ef")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint_text(F.col("fp")).alias("fingerprint"), fingerprint_text(F.col("_ef")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("_ef")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
