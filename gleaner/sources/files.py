"""Readers for the raw files: sample tables, CSV exports, review sheets, source trees, archives."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.code import EXTENSIONS
from gleaner.functions.text import EXCLUDED_PATH, LICENSE_FILE
from gleaner.types import LABELS, METRICS, SAMPLE, STATUSES


def encode(df: DataFrame) -> DataFrame:
    """Labels and metrics as JSON text, columns in their fixed order."""
    return df.withColumns({c: F.to_json(c) for c in ("labels", "static_metrics") if not isinstance(df.schema[c].dataType, T.StringType)}).select(*SAMPLE.fieldNames())


def decode(df: DataFrame) -> DataFrame:
    """JSON text of labels and metrics to a map and a struct; decoded columns stay."""
    kinds = {"labels": LABELS, "static_metrics": METRICS}
    return df.withColumns({c: F.from_json(c, t) for c, t in kinds.items() if isinstance(df.schema[c].dataType, T.StringType)})


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.schema(SAMPLE).parquet(path))


def samples_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    as_text = lambda v: json.dumps(v, sort_keys=True) if isinstance(v, dict) else v
    return spark.createDataFrame([tuple(as_text(r.get(f.name)) for f in SAMPLE) for r in rows], SAMPLE)


def read_csv(spark: SparkSession, path: str, columns: str, sep: str = ",", keep: list[str] | None = None) -> DataFrame:
    """All text, with quoted line ends; empty fields and the word null stay as they are. Only the columns to ``keep`` are parsed."""
    rows = spark.read.options(header=True, quote='"', escape='"', multiLine=True, nullValue="\0", emptyValue="", sep=sep, enforceSchema=False).csv(path, schema=columns)
    return (rows.select(*keep) if keep else rows).na.fill("")


def drop_repeated_headers(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) != column)


def read_sheets(spark: SparkSession, pattern: str, columns: str, aspects: list[str]) -> DataFrame:
    """Review sheets to rows (item_id, reviewer, aspect, status, confidence, notes); blank cells are left out, other statuses refused.

    The reviewer is in the sheet's name, <reviewer>_batch<n>.csv, or in its folders, reviewer=<reviewer>/batch=<n>.
    """
    named = F.regexp_extract(F.input_file_name(), r"([^/=]+)(?:_batch\d+\.csv|/batch=\d+/[^/]*)$", 1)
    wide = read_csv(spark, pattern, columns).withColumn("reviewer", named)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), F.lower(F.trim(a)).alias("status"), F.expr(f"try_cast(`{a}_confidence` AS double)").alias("confidence")) for a in aspects]))
    long = wide.withColumn("_r", rows).select("item_id", "reviewer", "_r.*", "notes").where("status <> ''")
    refused = F.raise_error(F.concat_ws(" ", F.lit("invalid status"), "item_id", "aspect", "status"))
    return long.withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(refused))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, source) of the source files below ``root``; hidden and excluded paths and bad UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return source_files(files.withColumn("rel", F.element_at(F.split("path", f"{root.rstrip('/').rpartition('/')[2]}/", 2), -1)))


def source_files(files: DataFrame) -> DataFrame:
    """Of files (path, rel, content) the sources, with their language; ``rel`` is the path below the tree's root."""
    ends = "|".join(EXTENSIONS)
    kept = files.where(F.col("rel").rlike(rf"\.({ends})$") & ~F.col("rel").rlike(r"(^|/)\.") & ~F.col("rel").rlike(EXCLUDED_PATH))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return kept.select("path", F.col("rel").alias("file_path"), table[F.regexp_extract("rel", r"\.(\w+)$", 1)].alias("language"), F.expr("try_validate_utf8(cast(content AS string))").alias("source")).where("source IS NOT NULL")


def read_zip_json(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Rows of a JSON list inside the zip archives at ``path``."""
    return zip_records(spark.read.format("binaryFile").load(path), member, schema)


def zip_records(archives: DataFrame, member: str, schema: str) -> DataFrame:
    """Rows of a JSON list inside zip archives (content), one archive at a time in a task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for content in batch.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    yield pd.DataFrame({"row": [json.dumps(x) for x in json.load(f)]})

    text = archives.select("content").mapInPandas(run, "row string")
    return text.select(F.from_json("row", schema).alias("r")).select("r.*")


def license_file(files: DataFrame) -> DataFrame:
    """(repository, license_file): the first name, in order, that looks like a license."""
    named = F.when(F.col("name").rlike(LICENSE_FILE), F.col("name"))
    return files.groupBy("repository").agg(F.min(named).alias("license_file"))
