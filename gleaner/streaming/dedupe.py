"""Exact deduplication of a stream of samples, batch by batch, against the table kept so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def dedupe_stream(stream: DataFrame, hash_col: str, id_col: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to ``path`` the first row of each hash that isn't there; a batch that is retried adds nothing twice."""

    def batch(rows: DataFrame, epoch: int) -> None:
        first = rows.groupBy(hash_col).agg(F.min(id_col).alias(id_col))
        new = rows.join(first, [hash_col, id_col], "left_semi").dropDuplicates([hash_col])
        spark = rows.sparkSession
        kept = spark.read.schema(rows.schema).option("ignoreMissingFiles", True)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            new = new.join(kept.parquet(path).select(hash_col), hash_col, "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
