"""Text expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words that abstraction keeps.
KEYWORDS = """
abstract and as assert async await bool boolean break byte case catch char class const continue def default del
delete do double elif else enum except export extends false final finally float for foreach fun func function go
if implements import in instanceof int interface is lambda let long match namespace new nil none not null or
package pass private protected public raise return self short static struct super switch synchronized this throw
throws true try type typeof using val var void volatile when while with yield
""".split()

#: Fixed value: what is one token.
TOKEN = r'[A-Za-z_$][A-Za-z0-9_$]*|\d+(?:\.\d+)?|""|\S'
#: Paths that mining leaves out, class-like snippets, license files, names that tell the answer.
EXCLUDED_PATH = (
    r"(?i)(^|/)(tests?|testing|spec|__tests__|test_?data|fixtures?|examples?|samples?|docs?|benchmarks?|vendor|third[_-]?party|external|extern|deps|node_modules|build|dist|generated|gen|migrations)(/|$)"
    r"|(_test|Test|Tests|_pb2)\.[a-z]+$|\.min\.|(^|/|[._-])(tests?|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$"
)
CLASS_LIKE = r"^\s*(@\w+(\([^)]*\))?\s+)*((public|private|protected|abstract|final|static)\s+)*(class|interface|enum)\b"
LICENSE_FILE = r"^(?i)(LICEN[CS]E|COPYING)(\.|$|-)"
MIN_FINGERPRINT_TOKENS = 40


def collapse(text: Column) -> Column:
    """White space, in Unicode's sense, to single spaces."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_hash_comments(code: Column) -> Column:
    """Drops ``#`` and what follows on each line, also inside string literals."""
    return F.regexp_replace(code, r"#[^\n\r\x0B\x0C\x1C-\x1E\x85  ]*", "")


def tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(f"(?U){TOKEN}"), F.lit(0))


def abstracted(toks: Column) -> Column:
    """Identifiers to ``ID`` and numbers to ``NUM``; keywords in any case stay.

    Text comes from tokens by two replacements, each over a whole text at once; tokens never hold the separator.
    """
    name = rf"(?<=\n)(?!(?i:{'|'.join(KEYWORDS)})\n)[\p{{IsAlphabetic}}_$][A-Za-z0-9_$]*(?=\n)"
    joined = F.concat(F.lit("\n"), F.array_join(toks, "\n"), F.lit("\n"))
    marked = F.regexp_replace(F.regexp_replace(joined, r"(?U)(?<=\n)\d[^\n]*", "NUM\t"), name, "ID")
    return F.when(F.size(toks) == 0, toks).otherwise(F.split(F.btrim(F.regexp_replace(marked, "\t", ""), F.lit("\n")), "\n"))


def exact_hash(norm: Column) -> Column:
    return F.sha2(norm, 256)


def fingerprint(abstract: Column) -> Column:
    """Hash of the abstracted tokens; empty for short snippets."""
    return F.when(F.size(abstract) >= MIN_FINGERPRINT_TOKENS, F.sha2(F.array_join(abstract, " "), 256)).otherwise("")


def shingles(toks: Column, k: int = 5) -> Column:
    """The set of runs of ``k`` tokens; a shorter text is one run, an empty one none."""
    n = F.size(toks)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(" ", *(F.get(toks, i + j) for j in range(k))))
    return F.when(n >= k, F.array_distinct(runs)).when(n > 0, F.array(F.array_join(toks, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(toks: Column, k: int = 5) -> Column:
    """The hashes of ``shingles``, made without their texts."""
    n = F.size(toks)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(toks, i + j) for j in range(k))))
    short = F.array(F.xxhash64(F.array_join(toks, " "), n))
    return F.when(n >= k, F.array_distinct(runs)).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def family_id(url: Column) -> Column:
    """host/owner/name of a repository address."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^(https?://|git@|ssh://git@)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, ":", "/"), r"\.git$", ""), r"/+$", "")


def map_families(df: DataFrame, mapping: DataFrame, column: str = "family_id") -> DataFrame:
    """Merges forks and mirrors: ``mapping`` has (alias, family)."""
    held = mapping.select(F.col("alias").alias(column), F.col("family").alias("_family"))
    return df.join(held, column, "left").withColumn(column, F.coalesce("_family", column)).drop("_family")


def seeded_hash(*parts: Column | str | int) -> Column:
    """SHA-256 of the parts joined by colons; a null part is the text None."""
    as_text = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *(F.coalesce(p, F.lit("None")) for p in as_text)), 256)


def item_id(seed: int, sample_id: Column) -> Column:
    return F.concat(F.lit("i"), F.substring(seeded_hash(seed, "item", sample_id), 1, 10))


def class_like(code: Column) -> Column:
    return code.rlike(CLASS_LIKE)


def rename_leaky(code: Column, name: Column, leaky: str) -> Column:
    """Replaces a name that matches ``leaky`` by fn_ and six hex digits, as a whole word."""
    new = F.concat(F.lit("fn_"), F.substring(F.sha2(name, 256), 1, 6))
    return F.when(name.rlike(leaky), F.regexp_replace(code, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")), new)).otherwise(code)


def drop_lines(code: Column, phrase: str) -> Column:
    """Without the lines that hold the phrase, in any case."""
    return F.array_join(F.filter(F.split(code, "\n"), lambda line: ~F.lower(line).contains(phrase.lower())), "\n")


def slice_lines(code: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 1 and inclusive."""
    return F.array_join(F.slice(F.split(code, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def raw_url(repository: Column, commit: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), F.substring_index(F.regexp_replace(repository, r"\.git$", ""), "github.com/", -1), commit, F.ltrim(path, F.lit("/")))


def slug(url: Column) -> Column:
    """owner/name of a repository's address."""
    return F.btrim(F.regexp_replace(F.substring_index(url, "github.com/", -1), r"\.git$", ""), F.lit("/"))


def is_machine(reviewer: Column) -> Column:
    return reviewer.rlike("(?i)^llm")
