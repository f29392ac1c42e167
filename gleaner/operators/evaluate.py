"""Metrics of binary predictions, thresholds, cluster bootstrap, success rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counts(label: str = "label", pred: str = "pred") -> list[Column]:
    y, p = F.col(label), F.col(pred)
    cell = lambda a, b, name: F.count_if((y == a) & (p == b)).alias(name)
    return [F.count("*").alias("n"), cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn")]


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy beside tp, fp, fn, tn; 0 where nothing is counted."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    df = df.withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "accuracy": _share(tp + tn, tp + fp + fn + tn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", _share(2 * p * r, p + r))


def slices(df: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """Counts and rates for each grouping set, from one aggregation."""
    keys = sorted({k for s in sets for k in s})
    return rates(df.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*counts()))


def macro_f1(df: DataFrame, aspects: list[str]) -> DataFrame:
    """Mean F1 over the given aspects; one without rows counts as 0."""
    f1 = rates(df.where(F.col("aspect").isin(aspects)).groupBy("aspect").agg(*counts()))
    return f1.agg((F.coalesce(F.sum("f1"), F.lit(0.0)) / len(aspects)).alias("macro_f1"))


def language_macro_f1(df: DataFrame) -> DataFrame:
    """By language, mean F1 over the aspects that it has."""
    return rates(df.groupBy("language", "aspect").agg(*counts())).groupBy("language").agg(F.avg("f1").alias("macro_f1"))


def average_precision(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Area under the stepwise precision-recall curve; null without positives. Ranks are taken within a key's sort."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    hits = df.withColumn("_tp", F.sum("label").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(w))
    return hits.groupBy(*keys).agg((F.sum(F.when(F.col("label") == 1, F.col("_tp") / F.col("_k"))) / F.sum("label")).alias("average_precision"))


def brier(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col("p_true") - F.col("label"), 2)).alias("brier"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, frac_pos) for every bin of equal width; a bound belongs to the bin above."""
    edges = [float(e) for e in np.linspace(0, 1, bins + 1)[1:-1]]
    at = sum((F.when(F.col("p_true") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    found = df.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("p_true").alias("mean_p"), F.avg("label").alias("frac_pos"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def select_thresholds(df: DataFrame, score: str = "margin") -> DataFrame:
    """By aspect, the threshold with the best F1: 0, a midpoint of neighbouring scores or just below the least; ties go to the one next to 0."""
    by = df.groupBy("aspect", F.col(score).alias("s")).agg(F.sum("label").alias("pos"), F.count("*").alias("rows"))
    above = Window.partitionBy("aspect").orderBy("s").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("aspect")
    by = by.withColumns({
        "_tp": F.coalesce(F.sum("pos").over(above), F.lit(0)), "_sel": F.coalesce(F.sum("rows").over(above), F.lit(0)), "_all": F.sum("pos").over(whole),
        "_next": F.lead("s").over(Window.partitionBy("aspect").orderBy("s")), "_low": F.min("s").over(whole), "_rows": F.sum("rows").over(whole),
    })
    mids = by.where("_next IS NOT NULL").select("aspect", ((F.col("s") + F.col("_next")) / 2).alias("t"), "_tp", "_sel", "_all", F.lit(1).alias("kind"))
    least = by.groupBy("aspect").agg((F.min("_low") - 1e-6).alias("t"), F.max("_all").alias("_tp"), F.max("_rows").alias("_sel"), F.max("_all").alias("_all"), F.lit(2).alias("kind"))
    zero = by.groupBy("aspect").agg(F.lit(0.0).alias("t"), F.sum(F.when(F.col("s") > 0, F.col("pos")).otherwise(0)).alias("_tp"), F.sum(F.when(F.col("s") > 0, F.col("rows")).otherwise(0)).alias("_sel"), F.max("_all").alias("_all"), F.lit(0).alias("kind"))
    every = zero.unionByName(mids).unionByName(least)
    precision, recall = _share(F.col("_tp"), F.col("_sel")), _share(F.col("_tp"), F.col("_all"))
    every = every.withColumn("f1", _share(2 * precision * recall, precision + recall))
    best = every.groupBy("aspect").agg(F.min(F.struct((-F.round("f1", 12)).alias("f"), F.abs("t").alias("a"), "kind", "t", "f1")).alias("b"))
    return best.select("aspect", F.col("b.t").alias("threshold"), F.col("b.f1").alias("val_f1"))


#: Bounds of the length bins, closed on the right.
LENGTHS = (0, 256, 512, 1024, 2048)


def errors(df: DataFrame, length: str) -> DataFrame:
    """error (fp, fn, tp, tn) and length_bin of each prediction; no length gives the bin nan."""
    kind = F.concat(F.when(F.col("label") == F.col("pred"), "t").otherwise("f"), F.when(F.col("pred") == 1, "p").otherwise("n"))
    bins = F.when(F.coalesce(F.col(length), F.lit(0)) <= 0, "nan")
    for low, high in zip(LENGTHS, LENGTHS[1:], strict=False):
        bins = bins.when(F.col(length) <= high, f"({low}, {high}]")
    return df.withColumn("error", kind).withColumn("length_bin", bins.otherwise(f"({LENGTHS[-1]}, 1000000000]"))


def top_errors(df: DataFrame, k: int = 5) -> DataFrame:
    """The k wrong predictions of largest margin in each aspect, language and kind."""
    w = Window.partitionBy("aspect", "language", "error").orderBy(F.desc(F.abs("margin")), "decision_id")
    return df.where(F.col("error").isin("fp", "fn")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def holdout_recall(positives: DataFrame) -> DataFrame:
    """By aspect, the share of held-out positives that were predicted, and their number."""
    return positives.groupBy("aspect").agg(F.avg("pred").alias("recall"), F.count("*").alias("support"))


def cluster_counts(df: DataFrame, cluster: str, systems: dict[str, str]) -> DataFrame:
    """tp, fp, fn of each system by cluster and aspect: all that a bootstrap needs of the rows."""
    cell = lambda p, a, b: F.count_if((F.col("label") == a) & (F.col(p) == b))
    return df.groupBy(cluster, "aspect").agg(*[cell(p, a, b).alias(f"{n}_{name}") for n, p in systems.items() for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))])


def hashed_draws(clusters: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """(rep, cluster, times): for each replicate as many draws with replacement as there are clusters, by hashes."""
    n = clusters.count()
    numbered = clusters.select(cluster, (F.row_number().over(Window.orderBy(cluster)) - 1).cast("long").alias("_i"))
    spark = clusters.sparkSession
    slots = spark.range(reps).withColumnRenamed("id", "rep").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "rep", "slot")), 1, 12)
    picked = slots.withColumn("_i", F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(max(n, 1)))).groupBy("rep", "_i").agg(F.count("*").alias("times"))
    return picked.join(numbered, "_i").select("rep", cluster, "times")


def bootstrap(per_cluster: DataFrame, draws: DataFrame, cluster: str, aspects: list[str], a: str | None, b: str) -> DataFrame:
    """(rep, value): macro F1 of ``b``, minus that of ``a`` if given, of each replicate."""
    sums = draws.join(per_cluster, cluster).groupBy("rep", "aspect").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in per_cluster.columns if c not in (cluster, "aspect")])
    f1 = lambda s: _share(2.0 * F.col(f"{s}_tp"), 2 * F.col(f"{s}_tp") + F.col(f"{s}_fp") + F.col(f"{s}_fn"))
    return sums.where(F.col("aspect").isin(aspects)).groupBy("rep").agg((F.sum(f1(b) - (f1(a) if a else F.lit(0.0))) / len(aspects)).alias("value"))


def interval(values: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return values.agg(q[0].alias("low"), q[1].alias("high"), F.count("*").alias("reps"))


def same_decisions(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both hold the same decisions."""
    if a.select("decision_id").join(b.select("decision_id", F.lit(1).alias("_b")), "decision_id", "full_outer").where("_b IS NULL").count() or b.join(a, "decision_id", "left_anti").count():
        raise ValueError("the two systems must be compared on the same decisions")


def success_rule(seeds: DataFrame, leakage_ok: bool, support_ok: bool, least_gain: float = 0.05, most_loss: float = 0.05) -> DataFrame:
    """Passed if every seed (seed, macro_f1, gain, low, worst_loss) gains enough, surely, and loses nowhere."""
    ok = (F.col("gain") >= least_gain) & (F.col("low") > 0) & (F.col("worst_loss") >= -most_loss)
    return seeds.agg((F.coalesce(F.bool_and(ok), F.lit(False)) & F.lit(leakage_ok and support_ok)).alias("passed"), F.avg("macro_f1").alias("mean_f1"), F.stddev_samp("macro_f1").alias("sd_f1"), F.count("*").alias("seeds"))
