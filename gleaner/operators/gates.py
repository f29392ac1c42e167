"""Support tables and the gates that decide whether results count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.decisions import is_gold

#: Licenses that admit a repository.
LICENSES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "ISC", "Unlicense", "0BSD", "Zlib", "PSF-2.0", "MPL-2.0", "EPL-2.0", "EPL-1.0", "CC0-1.0")


def support(decided: DataFrame) -> DataFrame:
    """positive and negative by language and aspect."""
    return decided.groupBy("language", "aspect").agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


def support_gates(decided: DataFrame, languages: list[str], aspects: list[str], least: int = 50, least_cell: int = 20) -> DataFrame:
    """(level, language, aspect, positive, negative, passed) over the whole grid; cells that pass are confirmatory."""
    spark = decided.sparkSession
    grid = spark.createDataFrame([(x, a) for x in [*languages, None] for a in [*aspects, None] if x or a], "language string, aspect string")
    table = support(decided)
    sets = table.groupingSets([[F.col("language"), F.col("aspect")], [F.col("language")], [F.col("aspect")]], "language", "aspect").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    rows = grid.alias("g").join(sets.alias("s"), F.col("g.language").eqNullSafe(F.col("s.language")) & F.col("g.aspect").eqNullSafe(F.col("s.aspect")), "left")
    level = F.when(F.col("g.language").isNull(), "aspect").when(F.col("g.aspect").isNull(), "language").otherwise("cell")
    p, n = F.coalesce("positive", F.lit(0)), F.coalesce("negative", F.lit(0))
    return rows.select(level.alias("level"), "g.language", "g.aspect", p.alias("positive"), n.alias("negative"), (F.least(p, n) >= F.when(level == "cell", least_cell).otherwise(least)).alias("passed"))


def supported(gates: DataFrame) -> bool:
    return bool(gates.where("level <> 'cell'").agg(F.bool_and("passed")).first()[0])


def pilot_counts(decided: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Rows by split, aspect and label; raises where they differ from a frozen table of the same columns."""
    found = decided.groupBy("split", "aspect", "label").agg(F.count("*").alias("n"))
    if frozen is not None:
        held = found.select("split", "aspect", "label", "n")
        if held.exceptAll(frozen.select(*held.columns)).count() or frozen.select(*held.columns).exceptAll(held).count():
            raise RuntimeError("the counts differ from the frozen manifest")
    return found


def balanced_support(counts: DataFrame, splits: list[str]) -> bool:
    """Whether every aspect has as many positives as negatives, and some, in each of the splits."""
    sides = counts.where(F.col("split").isin(splits)).groupBy("split", "aspect").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
    return bool(sides.agg(F.coalesce(F.bool_and((F.col("p") == F.col("q")) & (F.col("p") > 0)), F.lit(False))).first()[0])


def test_labels(decided: DataFrame) -> DataFrame:
    """Evaluated rows, those not gold, examples, and whether all is gold and anything is evaluated."""
    bad = ~F.coalesce("label_gold", F.lit(False))
    return decided.agg(F.count("*").alias("evaluated"), F.count_if(bad).alias("not_gold"), F.slice(F.array_sort(F.collect_set(F.when(bad, F.col("decision_id")))), 1, 10).alias("examples")).withColumn("passed", (F.col("evaluated") > 0) & (F.col("not_gold") == 0))


def admission(repositories: DataFrame) -> DataFrame:
    """Passed if each repository has a full commit, an admitted license, and its file."""
    ok = F.col("commit").rlike("^[0-9a-f]{40}$") & F.col("license").isin(*LICENSES) & F.col("license_file").isNotNull()
    return repositories.agg(F.count("*").alias("repositories"), F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("passed"))


def admission_status(evidence: dict | None) -> dict:
    if evidence is None:
        return {"passed": False, "reason": "no admission record"}
    return {"passed": bool(evidence.get("pass")), "reason": None if evidence.get("pass") else "a repository was not admitted"}


def agreement_status(evidence: dict | None, rubric: str, aspects: list[str], least: float = 0.60) -> dict:
    """Passed if people agreed enough on every aspect, under this rubric."""
    failures = []
    if evidence is None:
        return {"passed": False, "failures": ["no agreement record"]}
    if evidence.get("rubric_version") != rubric:
        failures.append("another rubric version")
    if evidence.get("machine_reviewers"):
        failures.append("machine reviewers")
    failures += [f"kappa of {a}: {evidence.get('test_kappa', {}).get(a)}" for a in aspects if (evidence.get("test_kappa", {}).get(a) or 0) < least]
    return {"passed": not failures, "failures": failures}


def test_gate(labels_ok: bool, admitted: dict, agreed: dict, support_ok: bool, primary: bool = True) -> list[str]:
    """What keeps a test from counting; raises in primary mode if anything does."""
    failures = [name for name, ok in (("labels", labels_ok), ("admission", admitted["passed"]), ("agreement", agreed["passed"]), ("support", support_ok)) if not ok]
    if failures and primary:
        raise RuntimeError("the test is locked: " + ", ".join(failures))
    return failures


def transfer_allowed(enabled: bool, confirmatory_pass: bool) -> bool:
    return enabled and confirmatory_pass


__all__ = ["LICENSES", "admission", "admission_status", "agreement_status", "is_gold", "support", "support_gates", "supported", "test_gate", "test_labels", "transfer_allowed"]
