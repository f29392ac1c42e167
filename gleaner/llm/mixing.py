"""Operator 4: mixing sources to target weights by Pareto order sampling.

Every source gets a target in words; whole copies of all its documents are certain, and what is left of the target is
drawn by Pareto order sampling: documents are ranked by their random odds over their inclusion odds, and the lowest
ranks are taken up to the fixed size of the sample, counted in words. The first document that no longer fits leaves a gap: down the
ranks, the next ``FILL`` documents that are small enough are each taken if they still fit. What is left then goes to the
document nearest in size, if that comes closer to the target than leaving it open.

The cut in the ranks is found by histograms, three levels of 1024 cells, in which documents that are certain and those drawn with
small odds are spread too; so no source is sorted or gathered in one task. Rows about sources, some 100 bytes each, are
in one task for the targets, and broadcast where there are at most ``MOST_SOURCES``.

Edge cases: a null or blank text has size 0 and adds nothing; a null source is a source of its own, the last one; rows that repeat an id
share one decision; an empty table gives no rows; a null id ranks as an empty one. Further columns pass through: ``mix_sources``
renames those that clash with its own by a suffix ``_in``, ``apply_mix`` returns all columns as they were. Inclusion odds grow with the square
root of a document's size; a document larger than its source's sample isn't drawn. Random numbers are hashes of the ids, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed
from gleaner.sources.tables import read_table

WORDS = r"[^\x20\x09-\x0D]+"
BITS, LEVELS, FILL, MOST_SOURCES = 10, 3, 256, 4096


def _random(id_: Column, seed: int) -> Column:
    """A number in (0, 1) from 12 hex digits of md5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.lit(str(seed)))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def _targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: its size, target, whole copies and words left to draw. Rows here are sources, not documents."""
    per = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.sum(F.col("_size") * F.col("_lean")).alias("_leaned"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    per = per.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / weight).withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_level"))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything)["_level"]
    per = per.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * level))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return per.withColumn("_whole", F.least(whole, F.lit(most).cast("long"))).withColumn("_rest", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Adds the Pareto rank ``_q`` and its cell ``_cell``; needs a source's columns beside each document's. Certain documents rank by their random numbers, below zero."""
    pi = F.col("_rest") * F.col("_lean") / F.col("_leaned")
    u = _random(F.col("_id"), seed)
    rows = rows.withColumn("_q", F.when((F.col("_size") == 0) | (F.col("_size") > F.col("_rest")), None).when(pi >= 1, u - 1).otherwise(u / (1 - u) / (pi / (1 - pi))))
    share = F.col("_rest") / F.col("source_size")  # brings ranks near 1, however small the sample
    even = F.col("_q") * share / (1 - share + F.col("_q") * share)
    place = F.when(F.col("_q") < 0, (F.col("_q") + 1) / 2).otherwise(0.5 + even / 2)
    top = (1 << BITS * LEVELS) - 1
    return rows.withColumn("_cell", F.least(F.floor(place * float(top + 1)), F.lit(top)).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_copies: int = 3, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``most_copies``), one row per input row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    keys = lambda d: d.withColumn("_id", F.col(id_col)).withColumn("_source", F.col(source_col)).withColumn("_size", size).withColumn("_lean", F.floor(F.sqrt("_size")) + 1)
    inner = {"_id", "_source", "_size", "_lean", "_leaned", "_rest", "_whole", "_cut", "_last", "_gap", "_filled", "_fit", "_q", "_cell", "_s"}
    clash = (inner | {"size", "source_size", "target", "copies"}) & set(docs.columns)
    docs = reduce(lambda d, c: d.withColumnRenamed(c, f"{c}_in"), sorted(clash), docs)
    sized = checkpointed(keys(docs.select(id_col, text_col, source_col)).select("_id", "_source", "_size", "_lean"))
    targets = checkpointed(_targets(sized, weights, most_copies))
    few = targets.count() <= MOST_SOURCES

    def beside(d: DataFrame, t: DataFrame, how: str = "inner") -> DataFrame:
        t = t.withColumnRenamed("_source", "_s")
        return d.join(F.broadcast(t) if few else t, F.col("_source").eqNullSafe(F.col("_s")), how).drop("_s")

    own = ("_source", "source_size", "_leaned", "_rest")
    drawn = _ranked(beside(sized, targets.where("_rest > 0").select(*own)), seed).where("_q IS NOT NULL").select("_source", "_id", "_size", "_q", "_cell", "_rest")
    can = drawn.groupBy("_source").agg(F.sum("_size").alias("_can"))
    targets = checkpointed(beside(targets, can, "left"))
    fits = F.col("_can") <= F.col("_rest")  # all that can be drawn is
    whole = targets.where(fits).select("_source", F.lit(1 << BITS * LEVELS).cast("long").alias("_cut"), F.lit(None).alias("_last"), (F.col("_rest") - F.col("_can")).alias("_gap"))
    drawn = beside(drawn, targets.where(~fits).select("_source"))
    for level in range(LEVELS):
        part = F.shiftright("_cell", BITS * (LEVELS - 1 - level))
        sums = drawn.withColumn("_part", part).groupBy("_source", "_part").agg(F.sum("_size").alias("_words"), F.max("_rest").alias("_rest"))
        upto = sums.withColumn("_upto", F.sum("_words").over(Window.partitionBy("_source").orderBy("_part"))).where(F.col("_upto") >= F.col("_rest"))
        first = upto.groupBy("_source").agg(F.min(F.struct("_part", "_upto", "_words", "_rest")).alias("c"))
        cut = checkpointed(first.select("_source", F.col("c._part").alias("_cut"), (F.col("c._rest") - (F.col("c._upto") - F.col("c._words"))).alias("_left")))
        drawn = beside(drawn.drop("_rest"), cut).where(part == F.col("_cut")).drop("_cut").withColumnRenamed("_left", "_rest")
    w = Window.partitionBy("_source").orderBy("_q", "_id", "_size")
    inside = drawn.withColumn("_upto", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_upto") <= F.col("_rest"))
    last = inside.groupBy("_source").agg(F.max(F.struct("_q", "_id")).alias("_last"), F.max("_upto").alias("_upto"))
    cut = beside(cut, last, "left").select("_source", "_cut", "_last", (F.col("_left") - F.coalesce("_upto", F.lit(0))).alias("_gap"))
    cut = cut.unionByName(whole.withColumn("_last", F.col("_last").cast(cut.schema["_last"].dataType)))
    cuts = checkpointed(beside(targets, cut, "left").select(*own, "target", "_whole", "_cut", "_last", "_gap"))

    before = (F.col("_cell") < F.col("_cut")) | ((F.col("_cell") == F.col("_cut")) & (F.struct("_q", "_id") <= F.col("_last")))
    taken = F.coalesce(F.col("_q").isNotNull() & before, F.lit(False))
    left = _ranked(beside(sized, cuts.where("_gap > 0")), seed).where(~taken & (F.col("_size") > 0))
    next_ = left.where("_q IS NOT NULL AND _size <= _gap").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= FILL)
    lists = next_.groupBy("_source").agg(F.max("_gap").alias("g"), F.sort_array(F.collect_list(F.struct("_n", "_q", "_id", "_size"))).alias("rows"))
    none = F.array().cast(f"array<struct<_q:double,_id:{sized.schema['_id'].dataType.simpleString()}>>")
    take = lambda acc, x: F.when(x["_size"] <= acc["g"], F.struct((acc["g"] - x["_size"]).alias("g"), F.concat(acc["t"], F.array(F.struct(x["_q"].alias("_q"), x["_id"].alias("_id")))).alias("t"))).otherwise(acc)
    filled = lists.select("_source", F.aggregate("rows", F.struct("g", none.alias("t")), take).alias("f")).select("_source", F.col("f.t").alias("_filled"), F.col("f.g").alias("_open"))
    cuts = beside(cuts, checkpointed(filled), "left").withColumn("_gap", F.coalesce("_open", "_gap")).drop("_open")
    fill = F.coalesce(F.array_contains("_filled", F.struct("_q", "_id")), F.lit(False))
    off = F.abs(F.col("_size") - F.col("_gap"))
    rest = _ranked(beside(sized, cuts.where("_gap > 0")), seed).where(~taken & ~fill & (F.col("_size") > 0) & (off < F.col("_gap")))
    fit = rest.groupBy("_source").agg(F.min(F.struct(off.alias("off"), _random(F.col("_id"), seed).alias("u"), F.col("_id").alias("id"))).alias("f")).select("_source", F.struct("f.id").alias("_fit"))
    cuts = beside(cuts, checkpointed(fit), "left")
    all_ = _ranked(beside(keys(docs), cuts), seed)
    fitted = F.col("_fit").isNotNull() & F.col("_id").eqNullSafe(F.col("_fit.id"))
    copies = (F.col("_whole") + F.when(taken | fill | fitted, 1).otherwise(0)).cast("int")
    return all_.select(*docs.columns, F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with the columns of ``docs``."""
    packed = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    mixed = mix_sources(packed, id_col="id", text_col="text", source_col="source", **options)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), leaned AS (SELECT *, floor(sqrt(size))::BIGINT + 1 AS lean FROM sized),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * lean)::BIGINT AS leaned,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM leaned GROUP BY source
), filled AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
  FROM per WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (SELECT *, cap / w <= lvl AS is_full FROM filled),
targets AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE w * (SELECT arg_min(lvl, cap / w) FROM flagged WHERE NOT is_full) END AS target FROM flagged
), counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM targets
), rested AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM counted),
ranked AS (
  SELECT d.doc_id, d.size, r.source, r.source_size, r.target, r.whole, r.rest, rest * lean / leaned AS pi, rest > 0 AND size > 0 AND size <= rest AS can,
    (('0x' || substr(md5(d.doc_id::VARCHAR || ':20240601'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM leaned d JOIN rested r ON d.source IS NOT DISTINCT FROM r.source
), odds AS (
  SELECT *, CASE WHEN NOT can THEN NULL WHEN pi >= 1 THEN u - 1 ELSE u / (1 - u) / (pi / (1 - pi)) END AS q FROM ranked
), summed AS MATERIALIZED (
  SELECT *, can AND sum(CASE WHEN can THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS prefix FROM odds
), gaps AS MATERIALIZED (
  SELECT source, rest - coalesce(sum(size) FILTER (WHERE prefix), 0) AS gap FROM summed WHERE rest > 0 GROUP BY source, rest
), small AS MATERIALIZED (
  SELECT s.source, s.doc_id, s.size, row_number() OVER (PARTITION BY s.source ORDER BY q, doc_id, size) AS n
  FROM summed s JOIN gaps g ON s.source IS NOT DISTINCT FROM g.source WHERE can AND NOT prefix AND size <= gap QUALIFY n <= 256
), steps AS (
  SELECT source, gap, 0::BIGINT AS n, NULL::BIGINT AS doc_id, false AS took FROM gaps
  UNION ALL
  SELECT s.source, CASE WHEN c.size <= s.gap THEN s.gap - c.size ELSE s.gap END, c.n, c.doc_id, c.size <= s.gap
  FROM steps s JOIN small c ON c.source IS NOT DISTINCT FROM s.source AND c.n = s.n + 1
), fill AS (SELECT source, doc_id FROM steps WHERE took), open AS (SELECT source, arg_max(gap, n) AS gap FROM steps GROUP BY source),
left_over AS (
  SELECT s.*, o.gap FROM summed s JOIN open o ON s.source IS NOT DISTINCT FROM o.source
  WHERE NOT prefix AND size > 0 AND doc_id NOT IN (SELECT doc_id FROM fill) AND abs(size - o.gap) < o.gap
), fits AS (SELECT source, arg_min(doc_id, {'a': abs(size - gap), 'u': u, 'd': doc_id}) AS fit FROM left_over GROUP BY source)
SELECT doc_id, size, source_size, target, size * (whole + extra) AS taken, (whole + extra)::INT AS copies
FROM (
  SELECT s.*, CASE WHEN prefix OR doc_id IN (SELECT doc_id FROM fill) OR doc_id = fit THEN 1 ELSE 0 END AS extra
  FROM summed s LEFT JOIN fits f ON s.source IS NOT DISTINCT FROM f.source
)
"""
