"""Queries of sources, sinks, loaders, lexers, labels and gates, each with SQL that gives the same rows where SQL can.

What the shared tables lack is built from each of their rows, such as source code whose metrics follow from the document's id, so
that SQL can state the result without a lexer. Files go to the folder that driver and executors share.
"""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from gleaner.functions import code, text
from gleaner.operators import agreement, decisions, evaluate, gates, sampling
from gleaner.plans.catalog import ASPECTS, RULES, SEED, decided, docs, labelled, query, rounded, scored
from gleaner.sources import files, loaders, sinks
from gleaner.sources.folders import shared_folder
from gleaner.sources.tables import read_table

TEXT = "coalesce(text, '')"


# ------------------------------------------------------------------ tables and files
@query(f"""SELECT doc_id::VARCHAR AS sample_id, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unknown' END AS quality,
CASE toxic WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unknown' END AS toxic, n_chars::INT AS effective_loc, sha256({TEXT}) AS code_hash FROM labelled""")
def samples_round_trip(spark, d):
    """Samples to Parquet and JSON lines, with labels and metrics as JSON text, and back."""
    metrics = F.struct(F.lit("m/1").alias("metrics_version"), F.col("n_chars").cast("int").alias("effective_loc"))
    given = {"sample_id": F.col("doc_id").cast("string"), "language": F.col("language"), "code": F.coalesce("text", F.lit("")), "labels": F.col("labels"), "static_metrics": metrics}
    names = files.SAMPLE
    rows = labelled(spark, d).select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in names])
    path = shared_folder(spark, "samples")
    sinks.write_samples(rows, path)
    back = files.read_samples(spark, f"{path}/parquet")
    return back.select("sample_id", *[decisions.status("labels", a).alias(a) for a in ASPECTS], "static_metrics.effective_loc", F.sha2("code", 256).alias("code_hash"))


@query("SELECT doc_id::VARCHAR AS sample_id, length(coalesce(text, '')) AS code_chars FROM docs")
def samples_json_lines(spark, d):
    """The JSON lines that lie beside the Parquet file."""
    path = shared_folder(spark, "samples")
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), F.coalesce("text", F.lit("")).alias("code"))
    sinks.write_samples(rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in files.SAMPLE]), path)
    return spark.read.schema(files.SAMPLE).json(f"{path}/jsonl").select("sample_id", F.char_length("code").cast("long").alias("code_chars"))


@query(f"SELECT doc_id::VARCHAR AS doc_id, sha256({TEXT}) AS code_hash, coalesce(language, 'null') AS language FROM docs")
def csv_scan(spark, d):
    """Two of four columns of a CSV file with quotes, line feeds and the word null."""
    path = shared_folder(spark, "csv")
    rows = docs(spark, d).select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("code"), F.coalesce("language", F.lit("null")).alias("language"), "family")
    rows.write.options(header=True, quote='"', escape='"', emptyValue="", nullValue="\0").csv(path)
    kept = files.read_csv(spark, path, "doc_id string, code string, language string, family string", keep=["doc_id", "code", "language"])
    return kept.select("doc_id", F.sha2(F.coalesce("code", F.lit("")), 256).alias("code_hash"), "language")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def semicolon_csv_headers(spark, d):
    """A file of texts with semicolons, whose header is repeated among its rows."""
    path = shared_folder(spark, "csv")
    rows = read_table(spark, d, "customer").select(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    again = spark.range(3).select(*[F.lit(c).alias(c) for c in rows.columns])
    rows.unionByName(again).write.options(header=True, sep=";").csv(path)
    return files.drop_repeated_headers(files.read_csv(spark, path, "c_custkey string, c_name string, c_mktsegment string", sep=";"), "c_custkey")


@query("SELECT doc_id::VARCHAR AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'ann' ELSE 'bob' END AS reviewer, 'toxic' AS aspect, CASE WHEN doc_id % 2 = 0 THEN 'positive' ELSE 'unknown' END AS status, CASE WHEN doc_id % 5 = 0 THEN 0.25::DOUBLE END AS confidence FROM docs WHERE doc_id % 7 <> 0")
def review_sheets(spark, d):
    """Sheets by reviewer and batch, with blank cells, read back to one row a review."""
    path = shared_folder(spark, "sheets")
    status = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 2 == 0, " Positive").otherwise("UNKNOWN ")
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("item_id"), status.alias("toxic"), F.when(F.col("doc_id") % 5 == 0, "0.25").otherwise("").alias("toxic_confidence"), F.when(F.col("doc_id") % 3 == 0, "ann").otherwise("bob").alias("reviewer"), (F.col("doc_id") % 4 + 1).alias("batch"))
    sinks.write_sheets(rows.select("item_id", "toxic", "toxic_confidence", "reviewer", "batch"), path, ["quality", "toxic"])
    columns = "item_id string, toxic string, toxic_confidence string, quality string, quality_confidence string, notes string"
    back = files.read_sheets(spark, f"{path}/reviewer=*/batch=*/*.csv", columns, ["toxic", "quality"])
    return back.select("item_id", "reviewer", "aspect", "status", "confidence")


@query("SELECT doc_id, family, n_chars FROM docs")
def zip_json(spark, d):
    """Archives with a list of JSON objects each, and the rows in them."""

    def packed(it):
        for batch in it:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("data/rows.json", json.dumps(batch.to_dict("records")))
            yield pd.DataFrame({"content": [held.getvalue()]})

    archives = docs(spark, d).select("doc_id", "family", "n_chars").mapInPandas(packed, "content binary")
    return files.zip_records(archives, "data/rows.json", "doc_id long, family string, n_chars long")


TREE = ["'src/main/F' || doc_id || '.java'", "'src/test/F' || doc_id || '.java'", "'.git/x' || doc_id || '.py'", "'a/b' || doc_id || '.py'", "'inc/h' || doc_id || '.hpp'", "'docs/x' || doc_id || '.py'", "'bad' || doc_id || '.py'", "'x' || doc_id || '.txt'"]
TREE_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(TREE)) + " END"


@query(f"SELECT {TREE_SQL} AS file_path, CASE doc_id % 8 WHEN 0 THEN 'java' WHEN 3 THEN 'python' ELSE 'cpp' END AS language, sha256({TEXT}) AS source_hash FROM docs WHERE doc_id % 8 IN (0, 3, 4)")
def source_tree(spark, d):
    """Of a tree's files the sources: no hidden or excluded paths, other endings or bad UTF-8."""
    content = F.when(F.col("doc_id") % 8 == 6, F.unhex(F.lit("FFFE"))).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs(spark, d).select(F.concat(F.lit("root/"), F.expr(TREE_SQL)).alias("path"), F.expr(TREE_SQL).alias("rel"), content.alias("content"))
    return files.source_files(rows).select("file_path", "language", F.sha2("source", 256).alias("source_hash"))


@query("SELECT text_sha1, vec FROM (SELECT sha1(vec_id::VARCHAR) AS text_sha1, round(embedding[1], 6) AS vec FROM embeddings)")
def embedding_cache(spark, d):
    """Vectors that were flushed twice, read once."""
    path = shared_folder(spark, "vectors")
    rows = read_table(spark, d, "embeddings").select(F.sha1(F.col("vec_id").cast("string")).alias("text_sha1"), F.col("embedding").alias("vec"))
    sinks.append_vectors(path, rows)
    sinks.append_vectors(path, rows.where(F.col("text_sha1") < "8"))
    return sinks.read_vectors(spark, path).select("text_sha1", F.round(F.col("vec")[0], 6).alias("vec"))


@query("SELECT coalesce(language, '') AS language, coalesce(aspect, '') AS aspect, n::VARCHAR AS n, tp::VARCHAR AS tp FROM rated")
def metric_table(spark, d):
    """Metrics by slice, written as CSV and read again."""
    path = shared_folder(spark, "metrics")
    found = evaluate.slices(decided(spark, d), (), ("aspect",), ("language",), ("language", "aspect")).select("language", "aspect", "n", "tp")
    sinks.write_table(found.na.fill("", ["language", "aspect"]), path)
    return files.read_csv(spark, path, "language string, aspect string, n string, tp string")


@query("SELECT doc_id, family FROM docs WHERE split = 'test'")
def resumed_stage(spark, d):
    """A stage that is asked for twice and runs once."""
    path, runs = shared_folder(spark, "stage"), []

    def make():
        runs.append(1)
        return docs(spark, d).where("split = 'test'").select("doc_id", "family")

    for _ in range(2):
        out = sinks.stage(spark, path, make)
    return out.where(F.lit(len(runs) == 1))


@query("""SELECT CASE split WHEN 'train' THEN 'train' ELSE 'test' END AS file, count(*) AS rows, sum((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT)::BIGINT AS questions, count(DISTINCT family) AS groups
FROM labelled WHERE split IN ('train', 'val') AND (quality IS NOT NULL OR toxic IS NOT NULL) AND n_chars <= 3000 GROUP BY 1""")
def training_files(spark, d):
    """Rows, questions and groups of the trainer's files, without samples of which a decision was truncated."""
    rows = labelled(spark, d).withColumn("split_group", F.col("family"))
    long = rows.where("n_chars > 3000").select("sample_id")
    return sinks.write_training(decisions.typed_rows(rows).select("sample_id", "split", "split_group", "gold"), long, shared_folder(spark, "training"))


# ------------------------------------------------------------------ loaders
SNIPPET = "CASE doc_id % 5 WHEN 0 THEN '@Foo(x) public class A' || doc_id WHEN 1 THEN 'final  interface X {' WHEN 2 THEN 'classy(' || doc_id % 17 || ')' WHEN 3 THEN 'void  f' || doc_id % 90 || '() { }' ELSE 'int g' || doc_id || ' // c' END"


@query(f"""SELECT 'code:' || doc_id AS sample_id, status FROM (
  SELECT min(doc_id) AS doc_id, CASE WHEN min(label) = 1 THEN 'positive' ELSE 'negative' END AS status
  FROM (SELECT doc_id, (doc_id % 3 = 0)::INT AS label, regexp_replace(regexp_replace({SNIPPET}, ' // c', ''), '\\s+', ' ', 'g') AS norm FROM docs WHERE doc_id % 5 > 1)
  GROUP BY norm HAVING min(label) = max(label) ORDER BY 1 LIMIT 300)""")
def tool_labelled(spark, d):
    """Code with a tool's labels: no classes, no conflicting texts, one row of each text, the first 300."""
    rows = docs(spark, d).select(F.col("doc_id").alias("row"), F.expr(SNIPPET).alias("code"), (F.col("doc_id") % 3 == 0).cast("int").alias("label"), F.col("family").alias("project"))
    return loaders.tool_labelled(rows, "quality", limit=300).select("sample_id", decisions.status("labels", "quality").alias("status"))


VOTED = "(SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS pos FROM events GROUP BY 1)"


@query(f"""SELECT 'review:' || user_id AS sample_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(str_split(text, chr(10))[2:3], chr(10)) END AS code,
CASE WHEN 2 * pos > n THEN 'positive' ELSE 'negative' END AS status, round(greatest(pos, n - pos) / n::DOUBLE, 8) AS confidence FROM {VOTED} LEFT JOIN docs ON doc_id = user_id WHERE 2 * pos <> n""")
def human_reviews(spark, d):
    """Votes of people joined to the lines that they judged; without the file the code is missing."""
    votes = read_table(spark, d, "events").select(F.col("user_id").alias("sample"), (F.col("event_type") == "purchase").alias("positive"), F.col("event_id").alias("review"), F.col("user_id").alias("path"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    sources = docs(spark, d).select(F.col("doc_id").alias("path"), F.col("text").alias("source"))
    kept, missing = loaders.human_reviews(votes, sources, "toxic")
    both = kept.unionByName(missing)
    label = F.col("labels")["toxic"]
    return both.select("sample_id", "code", label["status"].alias("status"), F.round(label["confidence"], 8).alias("confidence"))


@query(f"""SELECT 'fixture:' || doc_id AS sample_id, 'fn_' || substr(sha256('long_' || doc_id % 9), 1, 6) AS symbol,
'def fn_' || substr(sha256('long_' || doc_id % 9), 1, 6) || '(a):' || chr(10) || '    return ' || doc_id AS code, CASE WHEN doc_id % 4 = 0 THEN 'positive' ELSE 'unknown' END AS status FROM docs""")
def synthetic_fixture(spark, d):
    """Functions of files with a banner and telling names; what the truth lists is positive, all else unknown."""
    made = F.concat(F.lit("# Smelly code FOR research\ndef long_"), F.col("doc_id") % 9, F.lit("(a):\n    return "), F.col("doc_id"))
    sources = docs(spark, d).select(F.col("doc_id").alias("file"), F.lit("python").alias("language"), made.alias("source"))
    truth = docs(spark, d).where("doc_id % 4 = 0").select(F.col("doc_id").alias("file"), F.concat(F.lit("long_"), F.col("doc_id") % 9).alias("name"))
    rows = loaders.synthetic_fixture(sources, truth, "quality")
    return rows.select("sample_id", "symbol", "code", decisions.status("labels", "quality").alias("status"))


@query(r"""SELECT doc_id::VARCHAR AS sample_id, 'github.com/own/' || lower(coalesce(family, 'none')) AS repository_family_id, sha256(norm) AS content_hash, CASE WHEN len(toks) >= 40 THEN sha256(array_to_string(abs, ' ')) ELSE '' END AS fingerprint
FROM (SELECT *, list_transform(toks, lambda t: CASE WHEN regexp_matches(t, '^[\pL_$]') AND lower(t) NOT IN (""" + ", ".join(f"'{k}'" for k in text.KEYWORDS) + r""") THEN 'ID' WHEN regexp_matches(t, '^\d') THEN 'NUM' ELSE t END) AS abs
FROM (SELECT *, regexp_extract_all(norm, '""" + text.TOKEN.replace("'", "''") + r"""') AS toks
FROM (SELECT doc_id, family, trim(regexp_replace(regexp_replace(coalesce(text, ''), '#[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]*', '', 'g'), '\s+', ' ', 'g')) AS norm FROM docs)))""")
def made_samples(spark, d):
    """Samples with family, hash and fingerprint, from Python code."""
    url = F.concat(F.lit("https://GitHub.com/Own/"), F.coalesce("family", F.lit("none")), F.lit(".git"))
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), url.alias("repository_url"), F.lit("python").alias("language"), F.coalesce("text", F.lit("")).alias("code"))
    return loaders.make_samples(rows, with_metrics=False).select("sample_id", "repository_family_id", "content_hash", "fingerprint")


# ------------------------------------------------------------------ text and code
@query(f"SELECT doc_id, array_to_string(str_split({TEXT}, chr(10))[2:4], chr(10)) AS lines FROM docs")
def line_slices(spark, d):
    return docs(spark, d).select("doc_id", text.slice_lines(F.coalesce("text", F.lit("")), F.lit(2), F.lit(4)).alias("lines"))


PATHS = ["'src/main/A' || doc_id || '.java'", "'a/tests/x' || doc_id || '.py'", "'vendor/x.go'", "'x_test.go'", "'latest/x' || doc_id || '.py'", "'a.min.js'", "'DOCS/x.py'", "'test_x.py'", "'x.spec.ts'", "'protest/a.py'", "'third-party/b.cc'", "'b_pb2.py'", "family || '/run.py'"]
PATH_SQL = f"CASE doc_id % {len(PATHS)} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PATHS)) + " END"


@query(f"SELECT doc_id, {PATH_SQL} AS path FROM docs WHERE doc_id % {len(PATHS)} IN (0, 4, 9, 12) AND {PATH_SQL} IS NOT NULL")
def excluded_paths(spark, d):
    rows = docs(spark, d).select("doc_id", F.expr(PATH_SQL).alias("path"))
    return rows.where(~F.col("path").rlike(text.EXCLUDED_PATH))


@query("SELECT doc_id, doc_id % 5 <= 1 AS class_like FROM docs")
def class_like(spark, d):
    return docs(spark, d).select("doc_id", text.class_like(F.expr(SNIPPET)).alias("class_like"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'def fn_' || substr(sha256('longPart' || doc_id || '_'), 1, 6) || '(): longPart' || doc_id || '_a; fn_' || substr(sha256('longPart' || doc_id || '_'), 1, 6) ELSE 'def run(): runa; run' END AS code FROM docs")
def leaky_names(spark, d):
    """Names that tell the answer are replaced where they stand as whole words."""
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("longPart"), "doc_id", F.lit("_"))).otherwise("run")
    rows = docs(spark, d).select("doc_id", name.alias("name")).withColumn("code", F.concat(F.lit("def "), "name", F.lit("(): "), "name", F.lit("a; "), "name"))
    fixed = rows.select("doc_id", "name", text.rename_leaky(F.col("code"), F.col("name"), loaders.LEAKY).alias("code"))
    return fixed.select("doc_id", "code")


@query(f"SELECT doc_id, coalesce(array_to_string(list_filter(str_split({TEXT}, chr(10)), lambda x: NOT contains(lower(x), 'the')), chr(10)), '') AS code FROM docs")
def banner_lines(spark, d):
    return docs(spark, d).select("doc_id", text.drop_lines(F.coalesce("text", F.lit("")), "THE").alias("code"))


@query("SELECT page_id, 'https://raw.githubusercontent.com/own/p' || page_id || '/abc/src/A.java' AS raw, 'own/p' || page_id AS slug FROM pages")
def repository_urls(spark, d):
    url = F.concat(F.lit("https://github.com/own/p"), "page_id", F.lit(".git"))
    return read_table(spark, d, "pages").select("page_id", text.raw_url(url, F.lit("abc"), F.lit("/src/A.java")).alias("raw"), text.slug(url).alias("slug"))


NAMES = ["'LICENSE'", "'license-MIT'", "'unlicense'", "'COPYING.txt'", "'LICENSED'", "'README'"]
NAME_SQL = f"CASE doc_id % {len(NAMES)} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(NAMES)) + " END"


@query(f"SELECT (doc_id // 3)::VARCHAR AS repository, min({NAME_SQL}) FILTER (WHERE doc_id % 6 IN (0, 1, 3)) AS license_file FROM docs GROUP BY 1")
def license_files(spark, d):
    rows = docs(spark, d).select(F.floor(F.col("doc_id") / 3).cast("string").alias("repository"), F.expr(NAME_SQL).alias("name"))
    return files.license_file(rows)


@query("SELECT user_id, user_id % 3 = 0 AS machine FROM events")
def machine_reviewers(spark, d):
    who = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("LLM-"), "user_id")).otherwise(F.concat(F.lit("allm"), "user_id"))
    return read_table(spark, d, "events").select("user_id", text.is_machine(who).alias("machine"))


@query("SELECT doc_id, 'a' || doc_id || ' = \"\"; ' || chr(10) || chr(10) || ' b = \"\" + c;' AS stripped FROM docs")
def strip_comments(spark, d):
    """Line and block comments and literals with escapes, by the lexer, of code about each document."""
    word = F.coalesce("family", F.lit("f"))
    made = F.concat(F.lit("a"), "doc_id", F.lit(' = "'), word, F.lit('\\"//"; // '), word, F.lit("\n/* ' "), word, F.lit("\n \" */ b = '\\'/*' + c;"))
    rows = docs(spark, d).select("doc_id", made.alias("code"), F.lit("java").alias("language"))
    return rows.select("doc_id", code.strip_comments_udf("code", "language").alias("stripped"))


METRIC_CODE = r"""CASE doc_id % 4
WHEN 0 THEN concat('int f', doc_id, '(', array_join(transform(slice(sequence(1, 6), 1, cast(doc_id % 6 AS int)), i -> concat('Map<K, V> a', i)), ', '), ') {\n', repeat('if (x) {\n', cast(doc_id % 5 AS int)), '// note {\nreturn 1;\n', repeat('}\n', cast(doc_id % 5 AS int)), '}\n')
WHEN 1 THEN concat('def f', doc_id, '(', array_join(transform(slice(sequence(1, 6), 1, cast(doc_id % 6 AS int)), i -> concat('a', i)), ', '), '):\n', array_join(transform(slice(sequence(1, 5), 1, cast(doc_id % 5 AS int)), j -> concat(repeat('  ', j), 'if x:\n')), ''), repeat('  ', cast(doc_id % 5 + 1 AS int)), 'return 1  # no\n')
WHEN 2 THEN concat('func (r *T) F', doc_id, '(', array_join(transform(slice(sequence(1, 6), 1, cast(doc_id % 6 AS int)), i -> concat('a', i, ' int')), ', '), ') int {\n', repeat('for {\n', cast(doc_id % 5 AS int)), 'return 1\n', repeat('}\n', cast(doc_id % 5 AS int)), '}\n')
ELSE concat('int f', doc_id, '(void) {\n', repeat('while (x) {\n', cast(doc_id % 5 AS int)), 'return 1; /* a\n\n b */\n', repeat('}\n', cast(doc_id % 5 AS int)), '}\n') END"""


@query("""SELECT doc_id, (CASE WHEN doc_id % 4 = 1 THEN doc_id % 5 + 2 ELSE 2 * (doc_id % 5) + 3 END)::INT AS effective_loc,
(CASE WHEN doc_id % 4 = 3 THEN 0 ELSE doc_id % 6 END)::INT AS parameter_count, (doc_id % 5)::INT AS max_nesting, CASE WHEN doc_id % 4 = 1 THEN 'ast' END AS parser FROM docs""")
def code_metrics(spark, d):
    """Metrics of code made for each document, with as many parameters and blocks as its id says."""
    language = F.element_at(F.array(*map(F.lit, ("java", "python", "go", "cpp"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = docs(spark, d).select("doc_id", F.expr(METRIC_CODE).alias("code"), language.alias("language"))
    return rows.withColumn("m", code.metrics_udf("code", "language")).select("doc_id", "m.effective_loc", "m.parameter_count", "m.max_nesting", "m.parser")


@query("""SELECT doc_id, 'g' || i AS name, (CASE WHEN doc_id % 2 = 0 THEN 3 * i - 1 ELSE 3 * i - 2 END)::INT AS start_line, (CASE WHEN doc_id % 2 = 0 THEN 3 * i + 1 ELSE 3 * i - 1 END)::INT AS end_line,
CASE WHEN doc_id % 2 = 0 THEN 'int g' || i || '(int x) {' || chr(10) || '  return x;' || chr(10) || '}' ELSE 'def g' || i || '(x):' || chr(10) || '    return x' END AS code
FROM (SELECT doc_id, unnest(range(1, doc_id % 4 + 1)) AS i FROM docs)""")
def extract_functions(spark, d):
    """Functions of a file made for each document, of which its id tells how many there are."""
    brace = F.concat(F.lit("class A {\n"), F.expr(r"array_join(transform(slice(sequence(1, 4), 1, cast(doc_id % 4 AS int)), i -> concat('int g', i, '(int x) {\n  return x;\n}\n')), '')"), F.lit("}\n"))
    plain = F.expr(r"array_join(transform(slice(sequence(1, 4), 1, cast(doc_id % 4 AS int)), i -> concat('def g', i, '(x):\n    return x\n\n')), '')")
    even = F.col("doc_id") % 2 == 0
    rows = docs(spark, d).select("doc_id", F.when(even, brace).otherwise(plain).alias("source"), F.when(even, "java").otherwise("python").alias("language"))
    return code.extract(rows, "source", "language").select("doc_id", "name", "start_line", "end_line", "code")


# ------------------------------------------------------------------ labels
GOLD = "(doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0)"


def _judged(spark, d):
    """Labels with quality, adjudication and annotators that follow from the id."""
    extra = F.struct(F.when(F.col("doc_id") % 2 == 0, "gold").otherwise("silver").alias("quality"), (F.col("doc_id") % 3 != 0).alias("adjudicated"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("annotators"))
    rows = labelled(spark, d).withColumn("x", extra)
    none = F.lit(None)
    whole = lambda v: F.struct(v["status"].alias("status"), F.col("x.quality").alias("quality"), F.lit("s").alias("source"), none.cast("string").alias("rubric_version"), none.cast("double").alias("confidence"), F.col("x.annotators").alias("annotators"), F.col("x.adjudicated").alias("adjudicated"))
    return rows.withColumn("labels", F.transform_values(F.coalesce("labels", F.create_map().cast("map<string,struct<status:string>>")), lambda _, v: whole(v))).drop("x")


@query(f"SELECT doc_id, coalesce(quality = 0 AND toxic = 0, false) AS clean, quality IS NOT NULL AND {GOLD} AS gold FROM labelled")
def clean_and_gold(spark, d):
    rows = _judged(spark, d)
    return rows.select("doc_id", decisions.is_clean(F.col("labels"), ASPECTS).alias("clean"), F.coalesce(decisions.is_gold(F.col("labels")["quality"]), F.lit(False)).alias("gold"))


@query(f"SELECT doc_id, split, (CASE WHEN split <> 'test' OR {GOLD} THEN (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT ELSE 0 END)::INT AS n_labels FROM labelled")
def gold_on_test(spark, d):
    return decisions.gold_on_test(_judged(spark, d)).select("doc_id", "split", F.size("labels").alias("n_labels"))


@query("SELECT doc_id, CASE WHEN coalesce(quality, (n_chars >= 1500)::INT) = 1 THEN 'positive' ELSE 'negative' END AS quality, CASE WHEN coalesce(toxic, (n_chars >= 3000)::INT) = 1 THEN 'positive' ELSE 'negative' END AS toxic, CASE WHEN quality IS NULL THEN 'rule' ELSE 's' END AS quality_source FROM labelled")
def filled_labels(spark, d):
    rows = decisions.fill_unknown(_judged(spark, d), RULES)
    return rows.select("doc_id", *[decisions.status("labels", a).alias(a) for a in ASPECTS], F.col("labels")["quality"]["source"].alias("quality_source"))


@query("SELECT doc_id, CASE quality WHEN 1 THEN true WHEN 0 THEN false END AS quality, CASE toxic WHEN 1 THEN true WHEN 0 THEN false END AS toxic FROM labelled WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def typed_rows(spark, d):
    return decisions.typed_rows(labelled(spark, d)).select("doc_id", *[F.col("gold")[a].alias(a) for a in ASPECTS])


@query("""SELECT doc_id, '{"language":"' || language || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"context":"c' || doc_id || '"' ELSE '' END || '}' AS state_text FROM docs WHERE language IS NOT NULL""")
def state_texts(spark, d):
    rows = docs(spark, d).where("language IS NOT NULL").withColumn("context", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("c"), "doc_id")).otherwise(""))
    return decisions.state_text(rows, ["language", "context"]).select("doc_id", "state_text")


@query("SELECT doc_id FROM labelled WHERE NOT ((quality IS NOT NULL OR toxic IS NOT NULL) AND n_chars > 2000)")
def without_truncated(spark, d):
    """Samples go as a whole if one of their decisions was truncated."""
    marked = decided(spark, d).select(F.col("doc_id").alias("sample_id"), (F.col("n_chars") > 2000).alias("truncated"))
    return decisions.exclude_truncated(labelled(spark, d), marked).select("doc_id")


@query("SELECT d.decision_id, label, round(p_true, 8) AS p_true FROM decided d JOIN scored USING (decision_id, label)")
def scores_join(spark, d):
    held = scored(spark, d).select("decision_id", "p_true")
    return rounded(decided(spark, d).select("decision_id", "label").join(held, "decision_id"), "p_true")


@query("SELECT 0.0005::DOUBLE AS worst, true AS passed")
def score_parity(spark, d):
    """Two scorers that differ by at most 0.0005."""
    rows = scored(spark, d).select("decision_id", "margin", "doc_id")
    return rounded(decisions.parity(rows, rows.withColumn("margin", F.col("margin") + F.when(F.col("doc_id") % 2 == 0, 0.0005).otherwise(0.0))), "worst", digits=7)


@query("SELECT count(*) AS n FROM decided")
def aligned_decisions(spark, d):
    """Raises unless both systems hold the same decisions."""
    rows = decided(spark, d)
    evaluate.same_decisions(rows, rows.orderBy(F.desc("decision_id")))
    return rows.agg(F.count("*").alias("n"))


@query("SELECT doc_id AS sample_id, language, bool_or(doc_id % 4 = 0) AS double FROM docs GROUP BY 1, 2")
def selection_key(spark, d):
    """The key of a selection, with whether each sample is reviewed twice."""
    rows = docs(spark, d).select(F.col("doc_id").alias("sample_id"), "language")
    assigned = rows.select("sample_id", F.explode(F.when(F.col("sample_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("reviewer"), (F.col("sample_id") % 4 == 0).alias("double"))
    return sampling.with_assignment(rows, assigned)


@query("SELECT row_number() OVER (ORDER BY first) - 1 AS position, text_hash FROM (SELECT min(doc_id) AS first, sha1(text) AS text_hash FROM docs WHERE text IS NOT NULL GROUP BY text ORDER BY 1 LIMIT 200)")
def ordered_distinct(spark, d):
    """The first 200 different texts in order of their first appearance."""
    rows = docs(spark, d).where("text IS NOT NULL").select("doc_id", "text")
    return decisions.ordered_distinct(rows, "text", "doc_id", 200).select("position", F.sha1("text").alias("text_hash"))


@query("SELECT kind, count(*) AS n, count(DISTINCT t) AS texts FROM (SELECT 'state' AS kind, text AS t FROM docs UNION ALL SELECT 'candidate', language FROM docs UNION ALL SELECT 'item', text FROM benchmark) GROUP BY 1")
def concatenated_texts(spark, d):
    rows = docs(spark, d)
    every = rows.select(F.explode(F.array(F.struct(F.lit("state").alias("kind"), F.col("text").alias("t")), F.struct(F.lit("candidate").alias("kind"), F.col("language").alias("t")))).alias("r")).select("r.*")
    every = every.unionByName(read_table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("text").alias("t")))
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("t").alias("texts"))


# ------------------------------------------------------------------ reviews and gates
REVIEWED = "(SELECT doc_id AS item_id, aspect, split, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS ann, CASE WHEN pred = 1 THEN 'positive' ELSE 'negative' END AS bob FROM decided)"


def _two(spark, d):
    side = lambda c: F.when(F.col(c) == 1, "positive").otherwise("negative")
    return decided(spark, d).select(F.col("doc_id").alias("item_id"), "aspect", "split", side("label").alias("ann"), side("pred").alias("bob"))


@query(f"""SELECT split, aspect, n, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 4) AS kappa, round(po, 4) AS agreement FROM (
SELECT split, aspect, count(*) AS n, avg((ann = bob)::INT) AS po, (count(*) FILTER (WHERE ann = 'positive') * count(*) FILTER (WHERE bob = 'positive') + count(*) FILTER (WHERE ann = 'negative') * count(*) FILTER (WHERE bob = 'negative')) / (count(*) * count(*))::DOUBLE AS pe FROM {REVIEWED} GROUP BY 1, 2)""")
def agreement_by_partition(spark, d):
    return agreement.kappa(_two(spark, d), ["split", "aspect"], "ann", "bob")


@query(f"SELECT item_id, aspect, ann, bob, CASE WHEN item_id % 2 = 0 THEN 'positive' ELSE '' END AS adjudicated_status, CASE WHEN item_id % 2 = 0 THEN 'cy' ELSE '' END AS adjudicator, '' AS rationale FROM {REVIEWED} WHERE ann <> bob")
def disagreements(spark, d):
    rows = _two(spark, d).drop("split")
    earlier = rows.where("item_id % 2 = 0").select("item_id", "aspect", F.lit("positive").alias("adjudicated_status"), F.lit("cy").alias("adjudicator"), F.lit(None).cast("string").alias("rationale"))
    return agreement.disagreements(rows, "ann", "bob", earlier)


@query("SELECT doc_id AS item_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM decided)")
def items_without_review(spark, d):
    return agreement.unreviewed(docs(spark, d).select(F.col("doc_id").alias("item_id")), _two(spark, d))


FINAL = f"""(SELECT g.item_id, g.partition, g.aspect, ann,
CASE WHEN ann IS NULL THEN 'unknown' WHEN twice AND ann = bob THEN ann WHEN twice AND item_id % 2 = 0 THEN 'negative' WHEN twice OR g.partition = 'test' THEN 'unknown' ELSE ann END AS status,
CASE WHEN twice AND (ann = bob OR item_id % 2 = 0) THEN 'gold' ELSE 'weak' END AS quality, coalesce(twice AND (ann = bob OR item_id % 2 = 0), false) AS adjudicated,
CASE WHEN ann IS NULL THEN 'unreviewed' WHEN twice AND ann = bob THEN 'annotation/1/agreed' WHEN twice AND item_id % 2 = 0 THEN 'annotation/1/adjudicated:cy' WHEN twice THEN 'annotation/1/disagreement-pending' ELSE 'annotation/1/single-review' END AS source,
CASE WHEN ann IS NULL THEN NULL WHEN twice THEN 0.65 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN ann IS NULL THEN '' WHEN twice THEN 'ann,bob' ELSE 'ann' END AS annotators
FROM (SELECT doc_id AS item_id, split AS partition, unnest(['quality', 'toxic']) AS aspect FROM docs) g LEFT JOIN (SELECT *, item_id % 3 <> 0 AS twice FROM {REVIEWED}) USING (item_id, aspect))"""


def _resolved(spark, d):
    rows = _two(spark, d)
    one = rows.select("item_id", "aspect", F.lit("ann").alias("reviewer"), F.col("ann").alias("status"), F.lit(0.5).alias("confidence"))
    two = rows.where("item_id % 3 <> 0").select("item_id", "aspect", F.lit("bob").alias("reviewer"), F.col("bob").alias("status"), F.lit(0.8).alias("confidence"))
    judged = rows.where("ann <> bob").select("item_id", "aspect", F.when(F.col("item_id") % 2 == 0, " Negative ").otherwise("no idea").alias("adjudicated_status"), F.lit("cy").alias("adjudicator"))
    grid = docs(spark, d).select(F.col("doc_id").alias("item_id"), F.col("split").alias("partition"), F.explode(F.array(*map(F.lit, ASPECTS))).alias("aspect"))
    return agreement.resolve(grid, one.unionByName(two), judged)


@query(f"SELECT item_id, partition, aspect, status, quality, adjudicated, source, round(confidence, 3) AS confidence, annotators FROM {FINAL}")
def finalize_labels(spark, d):
    """Every rule of resolution, with what it says of quality, source, confidence and annotators, from the map that samples carry."""
    maps = agreement.label_map(_resolved(spark, d), "rubric/1")
    rows = maps.select("item_id", "partition", F.explode("labels").alias("aspect", "l"))
    return rows.select("item_id", "partition", "aspect", "l.status", "l.quality", "l.adjudicated", "l.source", F.round("l.confidence", 3).alias("confidence"), F.array_join("l.annotators", ",").alias("annotators"))


@query(f"SELECT partition, quality, status, source = 'unreviewed' AS unreviewed, count(*) AS n FROM {FINAL} GROUP BY 1, 2, 3, 4")
def label_evidence(spark, d):
    return agreement.label_counts(_resolved(spark, d))


@query("SELECT split, aspect, label, count(*) AS n FROM decided GROUP BY 1, 2, 3")
def pilot_counts(spark, d):
    return gates.pilot_counts(decided(spark, d))


@query("SELECT aspect, round(avg(pred), 8) AS recall, count(*) AS support FROM decided WHERE label = 1 AND split = 'test' GROUP BY 1")
def holdout_recall(spark, d):
    return rounded(evaluate.holdout_recall(decided(spark, d).where("label = 1 AND split = 'test'")), "recall")


@query("""SELECT count(*) AS evaluated, count(*) FILTER (WHERE bad) AS not_gold, array_to_string((list(decision_id ORDER BY decision_id) FILTER (WHERE bad))[1:10], ',') AS examples, false AS passed
FROM (SELECT decision_id, doc_id % 7 = 0 AS bad FROM decided WHERE split = 'test')""")
def test_label_audit(spark, d):
    rows = decided(spark, d).where("split = 'test'").withColumn("label_gold", F.when(F.col("doc_id") % 7 != 0, True))
    return gates.test_labels(rows).withColumn("examples", F.array_join("examples", ","))


@query("SELECT count(*) AS repositories, bool_and(s_suppkey % 11 <> 0) AS passed FROM supplier")
def admission(spark, d):
    commit = F.when(F.col("s_suppkey") % 11 == 0, "abc").otherwise(F.sha1(F.col("s_suppkey").cast("string")))
    return gates.admission(read_table(spark, d, "supplier").select(commit.alias("commit"), F.lit("MIT").alias("license"), F.lit("LICENSE").alias("license_file")))


@query("SELECT sha256('[' || string_agg('[\"' || doc_id || '\", \"' || split || '\", \"' || coalesce(family, 'none') || '\"]', ', ' ORDER BY doc_id::VARCHAR) || ']') AS checksum, count(*) AS n FROM docs")
def manifest_checksum(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), "split", F.coalesce("family", F.lit("none")).alias("split_group"))
    known = sampling.manifest(rows, SEED)
    return spark.createDataFrame([(known["checksum"], sum(known["counts"].values()))], "checksum string, n long").where(F.lit(sampling.verify_manifest(rows, known)))


SEEDS = """, tried AS (SELECT s AS seed, aspect, label, pred AS base, (n_chars >= CASE WHEN aspect = 'quality' THEN 1500 ELSE 3000 END * (1 + s / 4.0::DOUBLE))::INT AS mine FROM decided, (SELECT unnest([1, 2, 3]) AS s)),
f AS (SELECT seed, aspect, 2 * sum(label * mine) / nullif(sum(label) + sum(mine), 0)::DOUBLE AS own, 2 * sum(label * base) / nullif(sum(label) + sum(base), 0)::DOUBLE AS rule FROM tried GROUP BY 1, 2),
seeds AS (SELECT seed, sum(coalesce(own, 0)) / 2 AS macro_f1, sum(coalesce(own, 0) - coalesce(rule, 0)) / 2 AS gain, min(coalesce(own, 0) - coalesce(rule, 0)) AS worst FROM f GROUP BY 1) """


@query(SEEDS + "SELECT bool_and(gain >= 0.05 AND gain > 0.02 AND worst >= -0.05) AS passed, round(avg(macro_f1), 8) AS mean_f1, round(stddev_samp(macro_f1), 8) AS sd_f1, count(*) AS seeds FROM seeds")
def success_rule(spark, d):
    """Three systems, by their thresholds on the length, against the rule."""
    limit = F.when(F.col("aspect") == "quality", 1500).otherwise(3000)
    rows = decided(spark, d).withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("mine", (F.col("n_chars") >= limit * (1 + F.col("seed") / 4)).cast("int"))
    f1 = lambda c: evaluate.rates(rows.groupBy("seed", "aspect").agg(*evaluate.counts(pred=c))).select("seed", "aspect", F.col("f1").alias(c))
    both = f1("mine").join(f1("pred"), ["seed", "aspect"]).withColumn("gain", F.col("mine") - F.col("pred"))
    seeds = both.groupBy("seed").agg((F.sum("mine") / 2).alias("macro_f1"), (F.sum("gain") / 2).alias("gain"), (F.sum("gain") / 2 - 0.02).alias("low"), F.min("gain").alias("worst_loss"))
    return rounded(evaluate.success_rule(seeds, True, True), "mean_f1", "sd_f1")
