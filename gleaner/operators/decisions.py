"""Labels, decisions, baselines, predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.types import NEGATIVE, POSITIVE, QUALITIES, STATUSES, UNKNOWN


def status(labels: Column | str, aspect: Column | str) -> Column:
    """A label's status; a missing one is unknown."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(labels[F.lit(aspect) if isinstance(aspect, str) else aspect]["status"], F.lit(UNKNOWN))


def is_clean(labels: Column, aspects: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (status(labels, a) == NEGATIVE for a in aspects))


def is_gold(label: Column, least: int = 2) -> Column:
    return F.coalesce((label["quality"] == "gold") & label["adjudicated"] & (F.coalesce(F.size(label["annotators"]), F.lit(0)) >= least), F.lit(False))


def gold_on_test(df: DataFrame) -> DataFrame:
    """On test rows only gold labels stay."""
    return df.withColumn("labels", F.when(F.col("split") == "test", F.map_filter("labels", lambda _, v: is_gold(v))).otherwise(F.col("labels")))


def fill_unknown(df: DataFrame, rules: dict[str, tuple[str, int]]) -> DataFrame:
    """Labels by rule where none is known, of weak quality."""
    made = F.map_from_arrays(
        F.array(*map(F.lit, rules)),
        F.array(*[F.struct(F.when(F.coalesce(F.col(m) >= t, F.lit(False)), POSITIVE).otherwise(NEGATIVE).alias("status"), F.lit("weak").alias("quality"), F.lit("rule").alias("source"), F.lit(None).cast("string").alias("rubric_version"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("annotators"), F.lit(False).alias("adjudicated")) for m, t in rules.values()]),
    )
    known = F.map_filter("labels", lambda _, v: v["status"] != UNKNOWN)
    return df.withColumn("labels", F.map_concat(known, F.map_filter(made, lambda k, _: ~F.map_contains_key(known, k))))


def decisions(df: DataFrame, aspects: list[str], keep: list[str]) -> DataFrame:
    """One row per sample and aspect with a known status: label 0 or 1."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), status("labels", a).alias("status")) for a in aspects]))
    known = df.withColumn("_d", rows).where(F.col("_d.status").isin(POSITIVE, NEGATIVE))
    return known.select(F.concat_ws("::", F.col("sample_id").cast("string"), "_d.aspect").alias("decision_id"), "sample_id", "_d.aspect", (F.col("_d.status") == POSITIVE).cast("int").alias("label"), *keep)


def typed_rows(df: DataFrame) -> DataFrame:
    """Known labels of each sample as ``gold``; samples with none are left out."""
    known = F.transform_values(F.map_filter("labels", lambda _, v: v["status"].isin(POSITIVE, NEGATIVE)), lambda _, v: v["status"] == POSITIVE)
    return df.withColumn("gold", known).where(F.size("gold") > 0)


def by_rules(df: DataFrame, rules: dict[str, tuple[str, int]], out: str = "pred") -> DataFrame:
    """1 where the aspect's metric reaches its threshold; a null metric counts as 0."""
    hit = reduce(lambda c, r: c.when(F.col("aspect") == r[0], F.coalesce(F.col(r[1][0]) >= r[1][1], F.lit(False))), list(rules.items())[1:], F.when(F.col("aspect") == next(iter(rules)), F.coalesce(F.col(next(iter(rules.values()))[0]) >= next(iter(rules.values()))[1], F.lit(False))))
    return df.withColumn(out, F.coalesce(hit, F.lit(False)).cast("int"))


def majority(train: DataFrame, target: DataFrame) -> DataFrame:
    """1 for aspects of which at least half the training labels are positive."""
    share = train.groupBy("aspect").agg((F.avg("label") >= 0.5).cast("int").alias("_p"))
    return target.join(share, "aspect", "left").withColumn("pred", F.coalesce("_p", F.lit(0))).drop("_p")


def apply_thresholds(df: DataFrame, thresholds: DataFrame, score: str = "margin") -> DataFrame:
    """pred: the score is strictly over the aspect's threshold."""
    held = thresholds.select("aspect", F.col("threshold").alias("_t"))
    return df.join(held, "aspect", "left").withColumn("pred", (F.col(score) > F.col("_t")).cast("int")).drop("_t")


def question(name: str, definition: str) -> dict:
    return {"instructions": f"Is this {name}?", "criteria": {"true": f"Yes. It is {definition}.", "false": f"No. It is not {definition}."}}


def state_text(df: DataFrame, fields: list[str]) -> DataFrame:
    """JSON of the fields that aren't empty."""
    return df.withColumn("state_text", F.to_json(F.struct(*[F.when(F.col(f) != "", F.col(f)).alias(f) for f in fields])))


def token_audit(df: DataFrame, state_tokens: Column, candidate_tokens: Column, most: int = 2048) -> DataFrame:
    """Marks decisions whose state and longest candidate don't fit."""
    return df.withColumns({"state_tokens": state_tokens, "candidate_tokens": candidate_tokens}).withColumn("truncated", F.col("state_tokens") + F.col("candidate_tokens") > most - 1)


def exclude_truncated(samples: DataFrame, decided: DataFrame) -> DataFrame:
    """Samples of which no decision was truncated."""
    return samples.join(decided.where("truncated").select("sample_id").distinct(), "sample_id", "left_anti")


def violations(df: DataFrame, required: list[str], filled: list[str], aspects: list[str]) -> DataFrame:
    """(rule, n): missing columns, repeated ids, empty texts, unknown aspects, bad statuses and qualities."""
    spark, missing = df.sparkSession, [c for c in required if c not in df.columns]
    if missing:
        return spark.createDataFrame([(f"missing column {c}", 1) for c in missing], "rule string, n long")
    names = F.explode(F.map_entries("labels"))
    counts = df.agg(*[F.count_if(F.col(c) == "").alias(f"empty {c}") for c in filled], (F.count("*") - F.countDistinct("sample_id")).alias("repeated sample_id"))
    labels = df.select(names.alias("e")).agg(F.count_if(~F.col("e.key").isin(aspects)).alias("unknown aspect"), F.count_if(~F.col("e.value.status").isin(*STATUSES)).alias("bad status"), F.count_if(~F.col("e.value.quality").isin(*QUALITIES)).alias("bad quality"))
    long = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in d.columns])).alias("r")).select("r.*")
    return long(counts).unionByName(long(labels))


def leave_one_language_out(df: DataFrame, held_out: str) -> DataFrame:
    return df.where((F.col("language") != held_out) | (F.col("split") == "test"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cosine_margin(df: DataFrame, state: str, true: str, false: str, scale: float = 1.0) -> DataFrame:
    """logits by scaled cosines, margin = true - false, p_true = sigmoid(margin)."""
    df = df.withColumns({"logit_true": scale * cosine(F.col(state), F.col(true)), "logit_false": scale * cosine(F.col(state), F.col(false))})
    return df.withColumn("margin", F.col("logit_true") - F.col("logit_false")).withColumn("p_true", 1 / (1 + F.exp(-F.col("margin"))))


def ordered_distinct(rows: DataFrame, column: str, order: str, limit: int) -> DataFrame:
    """(position, value): the first different values in order of their first appearance; only these are numbered, in one task."""
    first = rows.groupBy(column).agg(F.min(order).alias("_first")).orderBy("_first").limit(limit)
    return first.withColumn("position", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long")).drop("_first")


def missing_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts without a vector, with the key of the cache."""
    return texts.select("text").distinct().withColumn("text_sha1", F.sha1("text")).join(cache.select("text_sha1"), "text_sha1", "left_anti")


def parity(a: DataFrame, b: DataFrame, column: str = "margin", most: float = 1e-3) -> DataFrame:
    """(worst, passed): the largest difference of two score tables."""
    joined = a.select("decision_id", F.col(column).alias("x")).join(b.select("decision_id", F.col(column).alias("y")), "decision_id", "full_outer")
    worst = F.max(F.coalesce(F.abs(F.col("x") - F.col("y")), F.lit(float("inf"))))
    return joined.agg(worst.alias("worst")).withColumn("passed", F.col("worst") < most)
