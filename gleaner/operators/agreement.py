"""Votes, reviewer agreement, label resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_vote(votes: DataFrame, key: str, positive: str, order: str, first: list[str] = ()) -> DataFrame:
    """Label and confidence of each key's votes; ties are left out."""
    by = votes.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("int")).alias("pos"), *[F.min_by(c, order).alias(c) for c in first]).where("2 * pos <> n")
    return by.withColumn("label", (2 * F.col("pos") > F.col("n")).cast("int")).withColumn("confidence", F.greatest("pos", F.col("n") - F.col("pos")) / F.col("n"))


def pivot(reviews: DataFrame, reviewers: list[str]) -> DataFrame:
    """One column per reviewer of (item_id, aspect): the status of the first row in order of status."""
    return reviews.groupBy("item_id", "aspect").pivot("reviewer", reviewers).agg(F.min("status"))


def kappa(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa and raw agreement of the columns a and b by key; kappa is 1 where chance alone explains all."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    side = lambda x: cells.groupBy(*keys, F.col(x).alias("category")).agg(F.sum("c").alias(f"n_{x}"))
    chance = side("a").join(side("b"), [*keys, "category"]).groupBy(*keys).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("both"))
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("both") / (F.col("n") * F.col("n")), F.lit(0.0))
    return total.join(chance, keys, "left").select(*keys, "n", F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 4).alias("kappa"), F.round(po, 4).alias("agreement"))


def disagreements(pairs: DataFrame, a: str, b: str, earlier: DataFrame | None = None) -> DataFrame:
    """Items on which the two differ, with what was adjudicated before."""
    rows = pairs.where(F.col(a) != F.col(b))
    return rows if earlier is None else rows.join(earlier, ["item_id", "aspect"], "left").na.fill("", ["adjudicated_status", "adjudicator", "rationale"])


def resolve(grid: DataFrame, reviews: DataFrame, adjudications: DataFrame, version: str = "annotation/1") -> DataFrame:
    """status, quality, adjudicated, source, confidence and annotators of each (item_id, partition, aspect) of ``grid``.

    Equal reviews of two or more are gold, also when they agree on unknown; differing ones need a valid adjudication; a
    single review counts outside the test partition only, and weakly.
    """
    by = reviews.groupBy("item_id", "aspect").agg(F.countDistinct("reviewer").alias("k"), F.collect_set("status").alias("s"), F.round(F.avg("confidence"), 3).alias("confidence"), F.sort_array(F.collect_set("reviewer")).alias("annotators"))
    adjudications = adjudications.withColumn("adjudicated_status", F.lower(F.trim("adjudicated_status")))
    valid = adjudications.where(F.col("adjudicated_status").isin("positive", "negative", "unknown")).select("item_id", "aspect", "adjudicated_status", "adjudicator")
    rows = grid.join(by, ["item_id", "aspect"], "left").join(valid, ["item_id", "aspect"], "left")
    k, one = F.coalesce("k", F.lit(0)), F.size("s") == 1
    case = lambda *v: F.when(k == 0, v[0]).when((k >= 2) & one, v[1]).when((k >= 2) & F.col("adjudicated_status").isNotNull(), v[2]).when(k >= 2, v[3]).when(F.col("partition") == "test", v[4]).otherwise(v[5])
    only = F.element_at("s", 1)
    unknown, lit = F.lit("unknown"), F.lit
    return rows.select(
        "item_id", "partition", "aspect", case(unknown, only, F.col("adjudicated_status"), unknown, unknown, only).alias("status"),
        case(lit("weak"), lit("gold"), lit("gold"), lit("weak"), lit("weak"), lit("weak")).alias("quality"), case(lit(False), lit(True), lit(True), lit(False), lit(False), lit(False)).alias("adjudicated"),
        case(lit("unreviewed"), lit(f"{version}/agreed"), F.concat(lit(f"{version}/adjudicated:"), F.col("adjudicator")), lit(f"{version}/disagreement-pending"), lit(f"{version}/single-review"), lit(f"{version}/single-review")).alias("source"), "confidence",
        F.coalesce("annotators", F.array().cast("array<string>")).alias("annotators"),
    )


def label_map(resolved: DataFrame, rubric: str) -> DataFrame:
    """(item_id, partition, labels): the resolved labels of each item as the map that samples carry."""
    label = F.struct("status", "quality", "source", F.lit(rubric).alias("rubric_version"), "confidence", "annotators", "adjudicated")
    return resolved.groupBy("item_id", "partition").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("aspect", label.alias("label"))))).alias("labels"))


def label_counts(resolved: DataFrame) -> DataFrame:
    """Evidence of the labels: how many of each partition, quality and status, unreviewed ones apart."""
    return resolved.groupBy("partition", "quality", "status", (F.col("source") == "unreviewed").alias("unreviewed")).agg(F.count("*").alias("n"))


def unreviewed(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items without any review."""
    return items.join(reviews.select("item_id").distinct(), "item_id", "left_anti")
