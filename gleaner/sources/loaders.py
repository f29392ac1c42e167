"""Loaders: the ways in which labelled code comes in, each ending in samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import code, text
from gleaner.operators.agreement import majority_vote
from gleaner.types import LABEL, NEGATIVE, POSITIVE, UNKNOWN

#: Names that tell the answer, and the phrase of lines that do.
LEAKY = r"(?i)long|smell|unnecessar|parameter|complex|nest"
BANNER = "smelly code for research"


def label_of(status: Column, quality: str, source: str, confidence: Column | None = None) -> Column:
    """A label without annotators."""
    values = {"status": status, "quality": F.lit(quality), "source": F.lit(source), "confidence": confidence, "adjudicated": F.lit(False), "annotators": F.array().cast("array<string>")}
    return F.struct(*[(v if (v := values.get(f.name)) is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in LABEL])


def make_samples(rows: DataFrame, with_metrics: bool = True) -> DataFrame:
    """Rows (sample_id, repository_url, language, code and others) with family, content hash, fingerprint and metrics."""
    if with_metrics:
        rows = code.normalized(rows, "code", "language", "_norm").withColumn("static_metrics", code.metrics_udf("code", "language"))
    else:
        rows = rows.withColumn("_norm", text.collapse(text.strip_hash_comments(F.col("code"))))
    rows = rows.withColumn("_abstract", text.abstracted(text.tokens(F.col("_norm"))))
    made = {"repository_family_id": text.family_id(F.col("repository_url")), "content_hash": text.exact_hash(F.col("_norm")), "fingerprint": text.fingerprint(F.col("_abstract"))}
    return rows.withColumns(made).drop("_norm", "_abstract")


def synthetic_fixture(sources: DataFrame, truth: DataFrame, aspect: str) -> DataFrame:
    """Functions of files (file, language, source): those in ``truth`` (file, name) are positive, all others unknown, not negative."""
    bare = sources.withColumn("source", text.drop_lines(F.col("source"), BANNER))
    found = code.extract(bare, "source", "language").join(truth.distinct().withColumn("_true", F.lit(True)), ["file", "name"], "left")
    status = F.when(F.col("_true"), POSITIVE).otherwise(UNKNOWN)
    new = F.when(F.col("name").rlike(LEAKY), F.concat(F.lit("fn_"), F.substring(F.sha2("name", 256), 1, 6))).otherwise(F.col("name"))
    return found.select(
        F.concat_ws(":", F.lit("fixture"), F.col("file").cast("string")).alias("sample_id"), "language", new.alias("symbol"), text.rename_leaky(F.col("code"), F.col("name"), LEAKY).alias("code"),
        "start_line", "end_line", F.create_map(F.lit(aspect), label_of(status, "silver", "fixture")).alias("labels"),
    )


def tool_labelled(rows: DataFrame, aspect: str, limit: int | None = None) -> DataFrame:
    """Java code with a tool's 0 or 1 (row, code, label): without classes and texts of differing labels, the first row of each text."""
    kept = code.normalized(rows.where(~text.class_like(F.col("code"))).withColumn("language", F.lit("java")), "code", "language", "_norm").withColumn("content_hash", text.exact_hash(F.col("_norm")))
    agreed = kept.groupBy("content_hash").agg(F.min("row").alias("row"), (F.min("label") == F.max("label")).alias("_one")).where("_one").drop("_one")
    first = kept.join(agreed, ["content_hash", "row"], "left_semi").drop("_norm")
    first = first.orderBy("row").limit(limit) if limit else first
    status = F.when(F.col("label") == 1, POSITIVE).otherwise(NEGATIVE)
    return first.select(F.concat(F.lit("code:"), F.col("row").cast("string")).alias("sample_id"), "language", "code", "content_hash", F.create_map(F.lit(aspect), label_of(status, "weak", "tool")).alias("labels"))


def human_reviews(votes: DataFrame, sources: DataFrame, aspect: str) -> tuple[DataFrame, DataFrame]:
    """Samples of the judged lines by majority of the votes (sample, positive, review, path, start_line, end_line), and those whose file is missing."""
    voted = majority_vote(votes, "sample", "positive", "review", ["path", "start_line", "end_line"])
    joined = voted.join(sources, "path", "left").withColumn("code", text.slice_lines(F.col("source"), F.col("start_line"), F.col("end_line")))
    label = label_of(F.when(F.col("label") == 1, POSITIVE).otherwise(NEGATIVE), "silver", "majority", F.col("confidence"))
    rows = joined.select(F.concat(F.lit("review:"), F.col("sample").cast("string")).alias("sample_id"), "path", "start_line", "end_line", "code", F.create_map(F.lit(aspect), label).alias("labels"))
    return rows.where("code IS NOT NULL"), rows.where("code IS NULL")


def mine(files: DataFrame, least_lines: int = 3, cap: int = 4000) -> DataFrame:
    """Functions of ``least_lines`` at least in source files (repository, commit, file_path, language, source), ``cap`` of a repository: those of the smallest hashes."""
    found = code.extract(files, "source", "language").where(F.col("end_line") - F.col("start_line") + 1 >= least_lines)
    key = F.substring(text.seeded_hash(F.col("repository"), F.col("commit"), F.col("file_path"), F.col("start_line")), 1, 16)
    rows = found.withColumn("sample_id", F.concat(F.lit("gp:"), key)).drop("source")
    w = Window.partitionBy("repository").orderBy(text.seeded_hash("cap", F.col("sample_id")), "sample_id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
