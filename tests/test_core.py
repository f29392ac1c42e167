"""Literals, invariants and brute-force twins of the engine's operators, on small data."""

import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import code, text
from gleaner.functions.tokens import fingerprints, hashed_tokens
from gleaner.operators import agreement, decisions, dedupe, evaluate, gates, nearpairs, sampling
from gleaner.plans import catalog, records  # noqa: F401
from gleaner.sources import files, loaders, sinks


def test_registry_names_agree():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 90


def test_strip_comments_keeps_lines():
    source = 'a = "x // y"; // gone\n/* b\n c */ d = \'q\\\'r\';\ne = `m\nn`;'
    assert code.strip_comments(source, "javascript") == 'a = ""; \n\n d = "";\ne = ""\n;'
    assert code.strip_comments('"open\nnext', "java") == '""\nnext'


def test_brace_metrics():
    java = "void f(int a, Map<K, V> b, String c) {\n  // note\n  for (int i = 0; i < 3; i++) {\n    if (a > 1) {\n      while (x) { y(); }\n    }\n  }\n}"
    assert code.metrics(java, "java")[1:4] == (7, 3, 3)
    assert code.metrics("int f(void) { return 1; }", "cpp")[2] == 0
    assert code.metrics("func (r *T) Name(a int, b string) { }", "go")[2] == 2
    assert code.metrics("function f(this: X, a, b) { }", "typescript")[2] == 2


def test_python_metrics():
    source = "class A:\n    def m(self, a, *b, c=1, **d):\n        # no\n        if a:\n            for x in b:\n                with x:\n                    pass\n        elif c:\n            def inner():\n                if 1:\n                    pass\n"
    assert code.metrics(source, "python")[1:] == (10, 4, 3, "ast")
    assert code.metrics("def f(self, a:\n  if a:\n    x", "python")[4] == "lexical"
    with pytest.raises(ValueError):
        code.metrics("x", "cobol")


def test_extract_functions():
    java = "class A {\n  int n;\n  int add(int a) {\n    return go(a);\n  }\n  void run() { if (x) { y(); } }\n}"
    assert [f[:3] for f in code.functions(java, "java")] == [("add", 3, 5), ("run", 6, 6)]
    py = "class A:\n    @x\n    def m(self):\n        pass\n\ndef g():\n    return 1\n"
    assert [f[:3] for f in code.functions(py, "python")] == [("m", 2, 4), ("g", 6, 7)]
    assert code.functions("def (", "python") == []


def test_metrics_and_functions_run_on_workers(spark):
    rows = spark.createDataFrame([("b", "python", "class A:\n    def m(self, x, *rest):\n        if x:\n            return 1\n"), ("e", "cpp", "int run(void) { /* none */ return 1; }")], "id string, language string, source string")
    found = rows.withColumn("m", code.metrics_udf("source", "language")).select("id", "m.parameter_count").collect()
    assert {r.id: r.parameter_count for r in found} == {"b": 2, "e": 0}
    assert {(r.id, r.name) for r in code.extract(rows, "source", "language").collect()} == {("b", "m"), ("e", "run")}
    assert dict(code.normalized(rows, "source", "language").select("id", "norm").collect())["e"] == "int run(void) { return 1; }"


def test_functions_of_braces():
    cpp = "int A::get(int a) const {\n  return a;\n}\nstatic int x = call(1);\nif (a) { b(); }\nvoid open(int q) {\n  while (q) { q--; }\n"
    assert [f[:3] for f in code.functions(cpp, "cpp")] == [("get", 1, 3), ("open", 6, 8)]
    js = "const f = (a) => { return a; };\nfunction g(a, b) { return a; }\nx = h(1, function (y) { return y; });"
    assert [f[0] for f in code.functions(js, "javascript")] == ["g"]


def test_greedy_split_equals_one_pass_in_plain_python(spark):
    import hashlib

    rng = random.Random(4)
    rows = [(f"g{i}", s, rng.randrange(1, 9)) for i in range(70) for s in ("rows", "a", "b", "c") if s == "rows" or rng.random() < 0.6]
    got = sampling.assign_splits(spark.createDataFrame(rows, "split_group string, stratum string, n long"), 5)
    groups, total = {}, {}
    for g, s, n in rows:
        groups.setdefault(g, {})[s] = n
        total[s] = total.get(s, 0) + n
    have, want = {x: {} for x in sampling.RATIOS}, {}
    for g in sorted(groups, key=lambda g: (-groups[g]["rows"], hashlib.sha256(f"5:{g}".encode()).hexdigest())):
        gain = {x: sum(n * (share - have[x].get(s, 0) / total[s]) for s, n in groups[g].items()) for x, share in sampling.RATIOS.items()}
        want[g] = max(gain, key=gain.get)
        for s, n in groups[g].items():
            have[want[g]][s] = have[want[g]].get(s, 0) + n
    assert got == want


def test_sheets_refuse_other_statuses(spark, tmp_path):
    (tmp_path / "r_batch1.csv").write_text("item_id,toxic,toxic_confidence,notes\ni1, maybe,,\n")
    rows = files.read_sheets(spark, str(tmp_path / "*_batch*.csv"), "item_id string, toxic string, toxic_confidence string, notes string", ["toxic"])
    with pytest.raises(Exception, match="invalid status"):
        rows.collect()


def test_evidence_config_and_log(spark, tmp_path, capsys):
    assert sinks.read_evidence(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "e.json").write_text('{"pass": true,\n "n": 2}')
    assert sinks.read_evidence(spark, str(tmp_path / "e.json")) == {"pass": True, "n": 2}
    assert sinks.config_hash({"b": 1, "a": 2}) == sinks.config_hash({"a": 2, "b": 1}) and len(sinks.config_hash({})) == 12
    for line in ("one", "two"):
        sinks.append_log(str(tmp_path / "log"), line)
    assert [x.split()[-1] for x in (tmp_path / "log").read_text().splitlines()] == ["one", "two"] and "two" in capsys.readouterr().out


def test_mining_and_pilot_counts(spark):
    source = "\n".join(f"int f{i}(int a) {{\n  return a;\n}}" for i in range(9)) + "\nint short() { return 1; }\n"
    mined = loaders.mine(spark.createDataFrame([("r", "c", "a.cpp", "cpp", source)], "repository string, commit string, file_path string, language string, source string"), cap=5)
    assert mined.count() == 5 and mined.where("name = 'short'").count() == 0
    rows = spark.createDataFrame([("train", "x", 1), ("train", "x", 0), ("val", "x", 1)], "split string, aspect string, label int")
    counts = gates.pilot_counts(rows)
    gates.pilot_counts(rows, counts)
    assert gates.balanced_support(counts, ["train"]) and not gates.balanced_support(counts, ["train", "val"])
    with pytest.raises(RuntimeError):
        gates.pilot_counts(rows.where("label = 1"), counts)


def test_text_functions(spark):
    row = spark.createDataFrame([("https://GitHub.com/Owner/Repo.git",), ("git@github.com:owner/repo.git",), ("http://x/y.git/",)], "u string").select(text.family_id(F.col("u")).alias("f")).collect()
    assert [r.f for r in row] == ["github.com/owner/repo", "github.com/owner/repo", "x/y.git"]
    toks = spark.sql("SELECT 'if (Foo_1 == 2.5) return \"\" ;' AS x").select(text.abstracted(text.tokens(F.col("x"))).alias("t")).first().t
    assert toks == ["if", "(", "ID", "=", "=", "NUM", ")", "return", '""', ";"]
    got = spark.sql("SELECT 'a b c' AS x, 'def alarm(): alarm2; alarm' AS c, 'alarm' AS n").select(text.shingles(F.split("x", " ")).alias("s"), text.rename_leaky(F.col("c"), F.col("n"), "alarm").alias("c"), text.slice_lines(F.lit("1\n2\n3"), F.lit(2), F.lit(3)).alias("l")).first()
    assert got.s == ["a b c"] and "alarm2" in got.c and got.c.count("fn_") == 2 and got.l == "2\n3"


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i in range(30):
        words = [f"w{rng.randrange(40)}" for _ in range(60)]
        docs += [(3 * i, "x", words), (3 * i + 1, "x", words[: 60 - i % 9]), (3 * i + 2, "y", words)]
    df = spark.createDataFrame(docs, "sample_id long, lang string, toks array<string>").withColumn("sh", text.shingles(F.col("toks")))
    sets = {i: (lang, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for i, lang, w in docs}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= 0.8}
    assert {(r.a, r.b) for r in dedupe.near_pairs(df, "sh", "lang").collect()} == want and want
    sig = df.limit(1).select(dedupe.minhash("sh").alias("m")).first().m
    assert len(sig) == 64 and all(0 <= x < (1 << 61) - 1 for x in sig)


def test_near_pairs_store_no_sets_and_lose_none(spark, tmp_path):
    """Copies, a large group of near copies, texts that share a passage only: all pairs, with little written."""
    rng = random.Random(8)
    word = lambda: 0x9E3779B97F4A7C15 * rng.randrange(2000) % (1 << 63)
    base, passage = [word() for _ in range(300)], [word() for _ in range(40)]
    edited = lambda: [word() if rng.random() < 0.02 else x for x in base]
    lists = [edited() for _ in range(300)] + [base] * 80 + [passage + [word() for _ in range(200)] for _ in range(120)] + [passage[:5], passage[:4], []]
    df = spark.createDataFrame([(i, "x", w) for i, w in enumerate(lists)] + [(900, None, base), (901, "y", base), (902, "x", None)], "sample_id long, lang string, toks array<bigint>")
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in lists]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(range(len(lists)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    files_of = lambda pattern: set(folder.rglob(pattern))
    tables, checkpoints = files_of("entries/*.parquet"), files_of("rdd-*")
    got = {(r.a, r.b): r.similarity for r in dedupe.near_pairs(df, "toks", "lang", k=5).collect()}
    assert got == want and len(want) > 20_000
    assert files_of("rdd-*") == checkpoints and sum(p.stat().st_size for p in files_of("entries/*.parquet") - tables) < 8 * sum(map(len, sets)) / 2
    links = dedupe.near_links(df, "toks", "lang", k=5)
    assert {(r.node, r.label) for r in dedupe.components(links).collect()} == {(r.node, r.label) for r in dedupe.components(spark.createDataFrame(list(want), "a long, b long")).collect()}


def test_crossing_pairs_are_those_that_differ_and_are_not_shuffled(spark):
    """Copies and near copies in three parts: the pairs of different parts, with both; no exchange above the joins that make pairs."""
    rng = random.Random(6)
    base = [[rng.randrange(1 << 40) for _ in range(80)] for _ in range(8)]
    lists = [base[i % 8] if i % 3 else [rng.randrange(1 << 40) if rng.random() < 0.01 else x for x in base[i % 8]] for i in range(120)]
    parts = [rng.choice(["test", "train", None]) for _ in lists]
    df = spark.createDataFrame(list(zip(range(120), ["x"] * 120, lists, parts, strict=True)), "sample_id long, lang string, toks array<bigint>, split string")
    near = {(r.a, r.b): r.similarity for r in dedupe.near_pairs(df, "toks", "lang", k=5).collect()}
    got = dedupe.near_pairs(df, "toks", "lang", k=5, crossing="split")
    rows = got.collect()
    assert {(r.a, r.b): (r.similarity, r.split_a, r.split_b) for r in rows} == {(a, b): (v, parts[a], parts[b]) for (a, b), v in near.items() if parts[a] and parts[b] and parts[a] != parts[b]}
    assert len(rows) == len({(r.a, r.b) for r in rows}) > 100
    top = got._jdf.queryExecution().optimizedPlan().treeString().split("Join")[0]
    assert "Union" in top and "Aggregate" not in top and "Repartition" not in top


def test_hashed_tokens_are_those_of_the_expression(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice('aZ_$09\u0663..""\n \t\u00e9\U0001f600\x0b\u3000-') for _ in range(rng.randrange(40))) for _ in range(3000)] + [None]
    got, known = hashed_tokens(pa.array(texts)).to_pylist(), {}
    want = [r.t or [] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.tokens(F.col("t")).alias("t")).collect()]
    for hashes, tokens in zip(got, want, strict=True):
        assert len(hashes) == len(tokens) and all(known.setdefault(t, h) == h for t, h in zip(tokens, hashes, strict=True))
    assert len(set(known.values())) == len(known) > 500


def test_fingerprints_are_those_of_the_expression(spark):
    rng = random.Random(2)
    some = [*text.KEYWORDS, *map(str.upper, text.KEYWORDS), *(k + "x" for k in text.KEYWORDS), *(k + "9" for k in text.KEYWORDS), *(k[:-1] for k in text.KEYWORDS), "a", "_", "$if", "9if", "synchronized" * 17, "1.2.3", "12", "\u0663.4", "\u00e9", "\u6f22", "\U0001f600", '""', '"', ".", "(", "-"]
    texts = ["".join(rng.choice(some) + rng.choice(["", " ", "\n", "\u3000", "\x0b"]) for _ in range(rng.choice((20, 45, 90)))) for _ in range(900)] + ["a " * 39, "a " * 40, " ".join(text.KEYWORDS), "", None]
    got = fingerprints(pa.array(texts)).to_pylist()
    abstract = text.abstracted(text.tokens(text.collapse(F.coalesce("t", F.lit("")))))
    want = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.fingerprint(abstract).alias("f")).collect()]
    assert got == want and len(set(got)) > 300 and [bool(x) for x in got[-5:]] == [False, True, True, False, False]


def test_split_groups_join_renamed_texts(spark, tmp_path):
    body = "def {0}({1}, x): if {1} > {2}: return {0}({1} - {2}) " * 4
    rows = [body.format("f", "a", "1"), body.format("other", "b9", "2.5"), body.format("\u00e9", "c", "7").upper(), body.format("g", "h", "1") + "else", "f(a)", "g(b)", None]
    spark.createDataFrame([(10 + i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.split_group for r in catalog.split_groups(spark, str(tmp_path)).collect()}
    assert got == {i: f"g:{10 if i == 11 else i}" for i in range(10, 17)}


def test_near_pairs_of_texts_store_no_texts(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(("{0}", "{0}.5", '"{0}"', "w{0}", "\u00e9{0}")).format(rng.randrange(900))
    base = [[word() for _ in range(80)] for _ in range(20)]
    rows = [" ".join(word() if rng.random() < 0.01 else x for x in base[i % 20]) for i in range(100)] + ["a b c d e f"] * 2 + [None]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(rows)] + [(900, None, rows[0]), (901, "y", rows[0])], "sample_id long, lang string, t string")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    stored = lambda: set(folder.rglob("entries"))
    before = stored()
    got = {(r.a, r.b): r.similarity for r in dedupe.near_pairs(df, "t", "lang", k=5, least=10).collect()}
    assert stored() == before
    sets = [set(zip(*(t[j:] for j in range(5)), strict=False)) for t in ([x.group() for x in re.finditer(text.TOKEN, r or "")] for r in rows[:100])]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(range(100), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert got == want and len(want) > 50


def test_frequent_hashes_are_counted_over_all_tasks_of_a_worker(monkeypatch):
    monkeypatch.setattr(nearpairs, "SEEN", 1 << 12)
    own = [np.array([7 << 3, (100 + i) << 3], np.uint64) for i in range(5)]
    assert [[x.tolist() for x in nearpairs._frequent("some run", [s])] for s in own] == [[[], []]] * 2 + [[[56], [1]]] * 3
    assert [x.tolist() for x in nearpairs._frequent("another run", own[:2])] == [[], []]


def test_prefix_cells_lose_no_pair_and_list_no_shared_bucket():
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(5, 90)).astype(np.uint64)) for _ in range(12)]
    sets = []
    for i in range(90):
        s = base[i % 12]
        s = s[rng.random(len(s)) > 0.08]
        sets.append(np.unique(np.concatenate((s, rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64)))))
    buckets = [tuple(int(b) for b in rng.integers(-1, 9, 2)) for _ in sets]
    held = [(s[: len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1], len(s), -(1 << 40) + i, *b) for i, (s, b) in enumerate(zip(sets, buckets, strict=True))]
    parts = [nearpairs._opened(*x) for half in (held[::2], held[1::2]) for x in zip(*nearpairs._cells(half, 300).to_pydict().values(), strict=True)]
    got = {(int(v) >> 32, int(v) & 0xFFFFFFFF) for p in nearpairs._meetings(*map(np.concatenate, zip(*parts, strict=True)), 0.8) for v in p}
    alike = lambda i, j: (n := len(np.intersect1d(sets[i], sets[j]))) / (len(sets[i]) + len(sets[j]) - n)
    share = lambda i, j: any(u == v >= 0 for u, v in zip(buckets[i], buckets[j], strict=True))
    near = {(i, j) for i, j in itertools.combinations(range(90), 2) if alike(i, j) >= 0.8}
    assert near - got == {(i, j) for i, j in near if share(i, j)} and near & got
    assert not any(share(i, j) for i, j in got)
    # Sets that share only what is far behind in one of them can't be similar.
    assert [*nearpairs._meetings(*map(np.array, ([3, 3], [0, 15], [100, 100], [1, 2], [-1, -1], [-1, -1])), 0.8)] in ([], [[]])


def test_prefixes_take_few_bytes():
    rng = np.random.default_rng(3)
    held = [(np.sort(rng.integers(0, 1 << 63, 60)).astype(np.uint64), 300, int(rng.integers(0, 1 << 62)), -1, -1) for _ in range(2000)]
    assert sum(map(len, nearpairs._cells(held, 128).column("packed").to_pylist())) < 10 * 60 * 2000


def test_components_keep_one_round_on_disk(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: {p.parent for p in folder.rglob("*.parquet")} | set(folder.rglob("rdd-*"))
    before = held()
    labels = dedupe.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert len(held() - before) == 1 and {(r.node, r.label) for r in labels.collect()} == {(i, 0) for i in range(41)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in dedupe.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert dedupe.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedupe_exact(spark):
    rows = [("a", "h1", "p"), ("b", "h1", "p"), ("c", "h2", "p"), ("d", "h2", "n"), ("e", "h3", None)]
    kept, gone = dedupe.dedupe_exact(spark.createDataFrame(rows, "sample_id string, h string, k string"), "h", "k")
    assert sorted(r.sample_id for r in kept.collect()) == ["a", "e"]
    assert sorted((r.sample_id, r.reason, r.kept) for r in gone.collect()) == [("b", "exact_duplicate", "a"), ("c", "conflicting_labels", None), ("d", "conflicting_labels", None)]


def test_thresholds_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(a, rng.choice([-2.0, -1.0, 0.5, 1.0, 2.0, 3.0]), rng.randrange(2)) for a in "pqr" for _ in range(12)]
    got = {r.aspect: (r.threshold, r.val_f1) for r in evaluate.select_thresholds(spark.createDataFrame(rows, "aspect string, margin double, label int")).collect()}

    def f1(part, t):
        tp = sum(y for s, y in part if s > t)
        return 2 * tp / max(1, sum(s > t for s, _ in part) + sum(y for _, y in part)) if tp else 0.0

    for a in "pqr":
        part = [(s, y) for x, s, y in rows if x == a]
        u = sorted({s for s, _ in part})
        cands = [0.0, *((x + y) / 2 for x, y in zip(u, u[1:], strict=False)), u[0] - 1e-6]
        best = max(f1(part, t) for t in cands)
        assert got[a][1] == pytest.approx(best) and abs(got[a][0]) == min(abs(t) for t in cands if abs(f1(part, t) - best) < 1e-12)


def test_metrics(spark):
    df = spark.createDataFrame([("x", "en", 1, 1, 3.0, 1), ("x", "en", 0, 1, 2.0, 2), ("x", "en", 1, 0, 1.0, 3), ("x", "en", 0, 0, 0.0, 4)], "aspect string, language string, label int, pred int, margin double, id int")
    r = evaluate.slices(df, ()).first()
    assert (r.precision, r.recall, r.f1, r.n) == (0.5, 0.5, 0.5, 4)
    assert evaluate.average_precision(df, ["aspect"], "margin", "id").first().average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert evaluate.macro_f1(df, ["x", "missing"]).first().macro_f1 == 0.25
    assert evaluate.calibration(df.withColumn("p_true", F.lit(1.0))).count() == 10


def test_bootstrap_of_equal_systems_is_zero(spark):
    df = spark.createDataFrame([(f"f{i % 4}", "x", i % 2, (i // 2) % 2) for i in range(40)], "family string, aspect string, label int, pred int")
    per = evaluate.cluster_counts(df, "family", {"a": "pred", "b": "pred"})
    draws = evaluate.hashed_draws(per.select("family").distinct(), "family", 20, 1)
    assert {r.n for r in draws.groupBy("rep").agg(F.sum("times").alias("n")).collect()} == {4}
    assert {r.value for r in evaluate.bootstrap(per, draws, "family", ["x"], "a", "b").collect()} == {0.0}
    seeds = spark.createDataFrame([(1, 0.8, 0.1, 0.02, 0.0), (2, 0.7, 0.1, -0.01, 0.0)], "seed int, macro_f1 double, gain double, low double, worst_loss double")
    assert not evaluate.success_rule(seeds, True, True).first().passed and evaluate.success_rule(seeds.where("seed = 1"), True, True).first().passed


def test_kappa_and_votes(spark):
    pairs = spark.createDataFrame([("x", a, b) for a, b in zip("PPNN", "PNNN", strict=True)] + [("y", "P", "P")], "aspect string, a string, b string")
    assert {r.aspect: r.kappa for r in agreement.kappa(pairs, ["aspect"], "a", "b").collect()} == {"x": 0.5, "y": 1.0}
    assert agreement.kappa(pairs.limit(0), ["aspect"], "a", "b").count() == 0
    votes = spark.createDataFrame([(1, True, 1), (1, True, 2), (1, False, 3), (2, True, 1), (2, False, 2)], "k int, p boolean, o int")
    assert [(r.k, r.label, round(r.confidence, 3)) for r in agreement.majority_vote(votes, "k", "p", "o").collect()] == [(1, 1, 0.667)]


def test_reservation_and_assignment_do_not_depend_on_order(spark):
    rows = [("a", f"f{i}") for i in range(8)] + [("b", f"g{i}") for i in range(3)] + [("c", "h")]
    one = sampling.reserve_families(spark.createDataFrame(rows, "language string, family string"), "language", "family", 7, 0.25)
    two = sampling.reserve_families(spark.createDataFrame(rows[::-1], "language string, family string"), "language", "family", 7, 0.25)
    assert sorted(one.collect()) == sorted(two.collect())
    assert {r.language: r["count"] for r in one.groupBy("language").count().collect()} == {"a": 2, "b": 2}
    strata = spark.createDataFrame([(f"g{i}", "rows", 1 + i % 5) for i in range(60)], "split_group string, stratum string, n long")
    where = sampling.assign_splits(strata, 3)
    assert set(where.values()) == {"train", "val", "test"} and where == sampling.assign_splits(strata.orderBy(F.desc("split_group")), 3)
    assert sampling.assign_splits(strata, 3, pinned={"g1"})["g1"] == "test"
    frame = spark.createDataFrame([("s1", "train", "g1"), ("s2", "test", "g2")], "sample_id string, split string, split_group string")
    known = sampling.manifest(frame, 3)
    assert sampling.verify_manifest(frame.orderBy(F.desc("sample_id")), known) and known["counts"] == {"test": 1, "train": 1}


def test_excluded_paths(spark):
    bad = ["src/test/A.java", "a/tests/x.py", "vendor/x.go", "x_test.go", "a.min.js", "docs/x.py", "test_x.py", "x.spec.ts"]
    rows = spark.createDataFrame([(p,) for p in [*bad, "src/main/A.java", "latest/x.py"]], "p string").where(~F.col("p").rlike(text.EXCLUDED_PATH)).collect()
    assert [r.p for r in rows] == ["src/main/A.java", "latest/x.py"]


def test_round_trip_and_stage(spark, tmp_path):
    rows = [{"sample_id": "s1", "language": "java", "code": "x", "labels": {"quality": {"status": "positive", "quality": "gold", "adjudicated": True, "annotators": ["a", "b"]}}, "static_metrics": {"effective_loc": 3}}]
    sinks.write_samples(files.samples_frame(spark, rows), str(tmp_path / "s"))
    back = files.read_samples(spark, str(tmp_path / "s/parquet"))
    r = back.select(decisions.status("labels", "quality").alias("q"), decisions.status("labels", "toxic").alias("t"), decisions.is_gold(F.col("labels")["quality"]).alias("g"), decisions.is_clean(F.col("labels"), ["toxic"]).alias("c"), "static_metrics.effective_loc").first()
    assert (r.q, r.t, r.g, r.c, r.effective_loc) == ("positive", "unknown", True, False, 3)
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_samples(back, str(tmp_path / "s"))
    made = []
    for _ in range(2):
        sinks.stage(spark, str(tmp_path / "stage"), lambda: made.append(1) or back.select("sample_id"))
    assert len(made) == 1


def test_sources(spark, tmp_path):
    (tmp_path / "r_batch1.csv").write_text("item_id,toxic,toxic_confidence,notes\ni1,positive,0.5,\ni2,,,null\n")
    rows = files.read_sheets(spark, str(tmp_path / "*_batch*.csv"), "item_id string, toxic string, toxic_confidence string, notes string", ["toxic"]).collect()
    assert [(r.item_id, r.reviewer, r.status, r.confidence) for r in rows] == [("i1", "r", "positive", 0.5)]
    root = tmp_path / "tree"
    for p, b in (("a/x.py", b"def f(): pass"), ("a/tests/y.py", b"x"), (".git/z.py", b"x"), ("a/bad.py", b"\xff\xfe")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b)
    assert [(r.file_path, r.language) for r in files.read_tree(spark, str(root)).collect()] == [("a/x.py", "python")]


def test_gates():
    agreed = {"rubric_version": "r", "machine_reviewers": [], "test_kappa": {"x": 0.7}}
    assert gates.agreement_status(agreed, "r", ["x"])["passed"] and not gates.agreement_status(agreed | {"machine_reviewers": ["llm1"]}, "r", ["x"])["passed"]
    assert not gates.admission_status(None)["passed"]
    assert gates.test_gate(False, {"passed": True}, {"passed": True}, True, primary=False) == ["labels"]
    with pytest.raises(RuntimeError):
        gates.test_gate(False, {"passed": True}, {"passed": True}, True)


def test_stream_dedupe(spark, tmp_path):
    from gleaner.streaming.dedupe import dedupe_stream

    schema = "id long, h string"
    for i, rows in enumerate([[(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        dedupe_stream(stream, "h", "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.id, r.h) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (3, "b"), (5, "c")]
