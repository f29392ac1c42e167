"""The corpus pipeline: five stages, each on all that its predecessor kept.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns mean to a stage what its operator's docstring says:
no stage but the mix drops a document for having no text, unless the quality model rejects it; every stage but the last returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, mixing, neardup, quality, tokenids
from gleaner.llm.common import fold, fresh, shared_folder
from gleaner.sources.tables import read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a text without a word scores 0 and goes. It learns from the labelled rows of the original documents."""
    model = quality.learn_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    score = fresh(docs, "score")
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= 0.3).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    classes, _ = neardup.near_duplicates(docs.select("doc_id", "text"))
    return neardup.keep_one(docs, classes).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; one without words adds nothing, and is taken with the whole copies of its source only."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of token ids; written as Parquet they are the operator's files."""
    return tokenids.encode_blocks(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix), ("token_ids", encode)]

#: No SQL: the stages' models, hashes and coder can't be expressed in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again."""
    docs, base = read_table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(path)
        docs = spark.read.parquet(path)
    return docs
