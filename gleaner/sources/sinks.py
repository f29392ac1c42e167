"""Writers: tables, review sheets, reports, and stages that resume."""

from __future__ import annotations

import hashlib
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.files import encode


def write_samples(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet, and the same rows as JSON lines; refuses to overwrite unless told to."""
    mode, rows = "overwrite" if overwrite else "errorifexists", encode(df)
    rows.write.mode(mode).parquet(f"{path}/parquet")
    rows.write.mode(mode).json(f"{path}/jsonl")


def write_training(typed: DataFrame, excluded: DataFrame, path: str) -> DataFrame:
    """Training rows as train, validation rows as test; locked test rows aren't written. Returns counts by file."""
    files = F.when(F.col("split") == "train", "train").when(F.col("split") == "val", "test")
    kept = typed.join(excluded.select("sample_id").distinct(), "sample_id", "left_anti").withColumn("file", files).where("file IS NOT NULL")
    kept.write.mode("errorifexists").partitionBy("file").parquet(path)
    return kept.groupBy("file").agg(F.count("*").alias("rows"), F.sum(F.size("gold")).alias("questions"), F.countDistinct("split_group").alias("groups"))


def write_sheets(assigned: DataFrame, path: str, aspects: list[str] = ()) -> None:
    """One folder per reviewer and batch, with blank cells for the aspects' labels, their confidences and notes."""
    cells = [c for a in aspects for c in (a, f"{a}_confidence")] + ["notes"]
    assigned = assigned.withColumns({c: F.lit("") for c in cells if c not in assigned.columns})
    assigned.write.mode("errorifexists").partitionBy("reviewer", "batch").option("header", True).csv(path)


def markdown(items: DataFrame) -> DataFrame:
    """(item_id, markdown): an item as reviewers see it."""
    # Fixed value: an item's heading.
    form = "### %s\n\n%s · lines %d · effective LOC %d · parameters %d · max nesting %d\n\n```%s\n%s\n```\n"
    return items.select("item_id", F.format_string(form, "item_id", "language", "lines", "effective_loc", "parameter_count", "max_nesting", "language", "code").alias("markdown"))


def report(title: str, sections: dict[str, dict]) -> str:
    """Markdown of collected metrics."""
    lines = [f"# {title}"]
    for name, values in sections.items():
        lines += ["", f"## {name}", "", *(f"- {k}: {round(v, 4) if isinstance(v, float) else v}" for k, v in values.items())]
    return "\n".join(lines) + "\n"


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table: read again if it was finished, else made and written. Spark's commit is the marker."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_vectors(cache_path: str, new: DataFrame) -> None:
    """Adds (text_sha1, vec) rows to an embedding cache; readers drop repeated keys."""
    new.write.mode("append").parquet(cache_path)


def read_vectors(spark: SparkSession, cache_path: str) -> DataFrame:
    """(text_sha1, vec) of an embedding cache, one row a key: a retried append may have written some twice."""
    return spark.read.parquet(cache_path).groupBy("text_sha1").agg(F.min("vec").alias("vec"))


def write_table(df: DataFrame, path: str) -> None:
    """A metric table as CSV with a header."""
    df.write.mode("errorifexists").options(header=True, emptyValue="").csv(path)


def read_evidence(spark: SparkSession, path: str) -> dict | None:
    """A JSON document of any store; None where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def append_log(path: str, line: str) -> None:
    """A stamped line to standard output and to a file of the driver."""
    log = logging.Logger("gleaner")
    for handler in (logging.StreamHandler(sys.stdout), logging.FileHandler(path)):
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
        log.info(line)
        log.removeHandler(handler)
        handler.close()
