"""Edge cases, brute force and exact round trips of the corpus operators, on small data."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import decontam, fingerprints, languages, licenses, linededup, mixing, neardup, quality, rangecoder, tokenids, toxicity
from gleaner.llm.common import WordHashes, fold

EDGES = [(1, None, None), (2, "", "a"), (3, "  \n ", "a"), (4, "one two", "b"), (4, "one two", "b"), (5, "word " * 3000, None), (6, "x" * 30000, "a"), (7, "ü 漢字 🙂", "b")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, 9) for r in EDGES], SCHEMA + ", score int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_quality(spark, edges, empty):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "stone", "cloud", "green", "walk"]) for _ in range(40)) for _ in range(30)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "###"]) for _ in range(40)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    model = quality.learn_quality(docs, labels, fold("doc_id", 5) != 0)
    scored = quality.score_quality(docs, model).where(fold("doc_id", 5) == 0).collect()
    assert scored and all((r.score >= 0.5) == (r.doc_id < 30) for r in scored)
    rows = quality.score_quality(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    assert quality.score_quality(empty, model).count() == 0
    none = quality.learn_quality(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score_quality(edges.where("doc_id = 4"), none).collect()} == {0.5}


def test_range_coder_returns_all_ids_and_notices_damage(spark):
    rng = np.random.default_rng(3)
    blocks = [np.array([], "<u4"), np.array([7], "<u4"), rng.integers(0, 50, 3000), np.repeat(9, 5000), np.array([70000, 5, 131072, 2**31 - 1, 0, 0]), rng.zipf(1.3, 20000) % 2**31, rng.integers(0, 2**31, 4000)]
    rangecoder.register(spark)
    rows = spark.createDataFrame([(i, b.astype("<u4").tobytes()) for i, b in enumerate(blocks)], "i long, ids binary").withColumn("docs", F.lit(b""))
    coded = rows.selectExpr("i", f"{rangecoder.PACK}(ids, docs, i) AS p").collect()
    size = {r.i: len(r.p) for r in coded}
    assert size[3] < 100 and size[2] < 3000 and size[6] < 4 * 4000 + 600
    packed = spark.createDataFrame(coded, "i long, p binary")
    back = {r.i: np.frombuffer(r.x, "<u4") for r in packed.selectExpr("i", f"{rangecoder.UNPACK}(p) AS x").collect()}
    assert all((back[i] == b).all() and len(back[i]) == len(b) for i, b in enumerate(blocks))
    alone = rows.where("i = 5").selectExpr(f"{rangecoder.PACK}(ids, docs, i) AS p").first().p
    assert alone == next(r.p for r in coded if r.i == 5)  # blocks don't depend on one another
    for at in (9, 30, size[2] - 1):
        bad = bytearray(next(r.p for r in coded if r.i == 2))
        bad[at] ^= 1
        with pytest.raises(Exception, match="damaged"):
            spark.createDataFrame([(bytes(bad),)], "p binary").selectExpr(f"{rangecoder.UNPACK}(p)").collect()
    too_large = spark.createDataFrame([(np.array([2**31], "<u4").tobytes(),)], "ids binary")
    with pytest.raises(Exception, match="below 2"):
        too_large.selectExpr(f"{rangecoder.PACK}(ids, binary(''), 0L)").collect()


def test_token_files(spark, edges, empty, tmp_path):
    tokenids.write_blocks(edges.withColumn("part", F.lit("x")), str(tmp_path / "ids"), tokenizer())
    rows = sorted(tokenids.read_documents(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    plain, start = Tokenizer.from_file(tokenizer()), 0
    for r, (i, text, _) in zip(rows, sorted(EDGES, key=lambda x: x[0]), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tokenids.write_blocks(empty, str(tmp_path / "none"), tokenizer())
    assert tokenids.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_starts_go_on_over_blocks_and_parts(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(rng.choice([0, 3, 2000, 9000]))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenids.write_blocks(docs, str(tmp_path / "ids"), tokenizer(), part_bytes=200_000)
    files = spark.read.parquet(str(tmp_path / "ids"))
    assert files.select("part").distinct().count() > 2 and files.count() > files.select("part").distinct().count()
    rows = sorted(tokenids.read_documents(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(40)]


def test_word_cache_equals_whole_texts(monkeypatch):
    monkeypatch.setattr(tokenids, "WORDS", 40)
    coder, rng, plain = tokenids.Encoder(tokenizer()), random.Random(4), Tokenizer.from_file(tokenizer())
    parts = ["a", "Bc", " ", "\n", "\t", ".", "'s", "12", "é", "漢", "  ", "<|endoftext|>", "\r", "\x1c", "\u00a0", "\n ", " \n", "\n\n", ",", "$$", "_", '"', "\u0301", "²"]
    for some in (parts, [p for p in parts if p not in ("\t", "  ", "\r", "\x1c", "\u00a0", "<|endoftext|>")]):
        for _ in range(40):
            texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(20)]
            got = coder.encode(pa.array([None, *texts], pa.string()))
            want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
            assert got == [b"", *want], texts


def test_signatures_estimate_weighted_jaccard():
    rng, sets, cache = random.Random(2), [], WordHashes()
    for n in (6, 80, 900):
        for _ in range(12):
            words = [f"w{rng.randrange(400)}" for _ in range(n)]
            sets += [neardup.weighted_shingles(" ".join(words), cache), neardup.weighted_shingles(" ".join(words[: max(5, int(n * 0.85))]), cache)]
    heavy = ["a"] * 300 + [f"h{i}" for i in range(60)]
    sets += [neardup.weighted_shingles(" ".join(heavy), cache), neardup.weighted_shingles(" ".join(heavy[60:]), cache)]
    sig = neardup.signatures(sets)
    off = [neardup.similarity(sets[i], sets[i + 1]) - (sig[i] == sig[i + 1]).mean() for i in range(0, len(sets), 2)]
    assert abs(np.mean(off)) < 0.03 and max(map(abs, off)) < 0.2


def test_near_duplicates_equal_brute_force(spark, edges, empty):
    rng, texts = random.Random(6), []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 120, 250]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other).upper())
        texts.append(texts[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = neardup.near_duplicates(docs)
    got = {r.id: r.class_id for r in classes.collect()}
    cache = WordHashes()
    sets = [neardup.weighted_shingles(t, cache) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if neardup.similarity(sets[i], sets[j]) >= 0.8:
                    want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want)) and all(r.similarity >= 0.8 for r in links.collect())
    kept = neardup.keep_one(docs.unionByName(docs.limit(1)), classes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    rows = {r.id: r.class_id for r in neardup.near_duplicates(edges)[0].collect()}
    assert rows == {i: i for i, _, _ in EDGES} and neardup.near_duplicates(empty)[0].count() == 0


def test_a_loosely_linked_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 8)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):
        other = list(base)
        for _ in range(i % 9):
            other[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(other))
    rows = [(f"d{i:03}", t, 1) for i, t in enumerate(texts)] + [(None, texts[5], 1), (None, "nobody else has this", 1), ("e", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, class_id int")
    got = {r.id: r.class_id for r in neardup.near_duplicates(docs)[0].collect() if r.id}
    cache = WordHashes()
    sets = [neardup.weighted_shingles(t, cache) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if neardup.similarity(sets[i], sets[j]) >= 0.8:
                    want[i] = want[j] = min(want[i], want[j])
    assert got == {f"d{i:03}": f"d{w:03}" for i, w in enumerate(want)} | {"e": "e"} and len(set(want)) > 1
    classes = neardup.near_duplicates(docs)[0]
    assert neardup.keep_one(docs, classes).columns == docs.columns and neardup.keep_one(docs, classes).where("doc_id IS NULL").count() == 2


def test_mix(spark, edges, empty):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix_sources(docs)
    by = mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("source_size").alias("s"), F.max("copies").alias("c")).collect()
    assert all(abs(r.taken - r.t) < 30 and r.c <= 3 and r.t <= 3 * r.s for r in by)
    assert sum(r.t for r in by) == pytest.approx(sum(r.s for r in by))
    assert sorted(mixed.collect(), key=str) == sorted(mixing.mix_sources(docs.repartition(3)).collect(), key=str)
    assert mixing.mix_sources(edges).count() == len(EDGES) and mixing.mix_sources(empty).count() == 0
    assert mixing.apply_mix(edges).columns == edges.columns


def test_languages(spark, edges, empty):
    rng = random.Random(4)
    words = {"xx": ["brelo", "kanti", "sufor"], "yy": ["zwyq", "hxtr", "qqpl"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(12)), x) for i, x in enumerate(["xx", "yy"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.learn_languages(docs, fold("doc_id", 4) != 2)
    assert all(r.lang_best == r.lang for r in languages.identify(docs, model).collect())
    found = {r.doc_id: (r.lang_best, r.lang_score) for r in languages.identify(edges, model).collect()}
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 3)) and found[4][0] in words
    assert languages.identify(empty, model).count() == 0 and {r.lang_best for r in languages.identify(edges, {}).collect()} == {"und"}


def test_wand_equals_brute_force():
    rng = random.Random(5)
    items = [(i, " ".join(f"w{min(rng.randrange(200), rng.randrange(200))}" for _ in range(rng.randrange(3, 30)))) for i in range(150)]
    index = decontam.build_index(items)
    for _ in range(100):
        terms = {w for w in (f"w{rng.randrange(200)}" for _ in range(25)) if w in index.terms}
        sums = {}
        for w in terms:
            for i, x in zip(index.terms[w].items, index.terms[w].impacts, strict=True):
                sums[i] = sums.get(i, 0) + x
        for t in (0.2, 0.5):
            assert [i for i, _ in decontam.block_max_wand([index.terms[w] for w in sorted(terms)], t)] == sorted(i for i, s in sums.items() if s >= t - 1e-9)


def test_leaks(spark, edges, empty):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    items = [(i, f"{prose(20)}. {prose(6)}.") for i in range(20)] + [(90, "the of and. the of."), (91, None), (92, "")]
    docs = [(i, prose(300)) for i in range(10)] + [(100 + i, f"{prose(150)} {items[i][1]} {prose(90)}") for i in range(10)] + [(200, items[0][1][:60])]
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.id, r.item) for r in found.collect()} == {(100 + i, i) for i in range(10)}
    small = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard=7)
    assert {(r.id, r.item) for r in small.collect()} == {(100 + i, i) for i in range(10)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.without_leaks(edges, bench).count() == len(EDGES) and decontam.without_leaks(empty, bench).count() == 0
    assert decontam.without_leaks(edges, bench.limit(0)).count() == len(EDGES)


def test_segments_are_all_the_maximal_ones():
    rng = random.Random(8)

    def search(scores, low, high):  # the best segment, then those on both sides of it
        best = max(((sum(scores[i:j]), i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0))
        return search(scores, low, best[1]) + [best[1:]] + search(scores, best[2], high) if best[0] > 0 else []

    for _ in range(150):
        scores = [rng.choice([-1, -1, 1]) * rng.random() for _ in range(rng.randrange(0, 18))]
        found = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in found] == search(scores, 0, len(scores))
        assert all(abs(x - sum(scores[a:b])) < 1e-9 for a, b, x in found)


def test_votes_equal_a_plain_search(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)], 20)) for _ in range(60)]
    sample = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "label int, text string")
    m = quality.fit(sample, dims=8, k=5)
    counts = np.stack([quality.features(t, quality._Words()) for t in texts[:20]])
    for vector, got in zip(m.embed(counts), m.score(counts), strict=True):
        cosines = [round(float(c), 5) for c in m.vectors @ vector]
        near = sorted(range(60), key=lambda i: (-cosines[i], i))[:5]
        votes = [max(cosines[i], 1e-6) ** 3 * m.weights[i] for i in near]
        assert got == pytest.approx(sum(v * m.labels[i] for v, i in zip(votes, near, strict=True)) / sum(votes), abs=0.02)


def test_repeated_lines_equal_a_plain_search(spark):
    rng, passages = random.Random(9), []
    for n in (5, 8, 14):
        passages.append([" ".join(f"p{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 13))) for _ in range(n)])
    texts = []
    for i in range(24):
        own = [" ".join(f"d{i}x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))) for _ in range(12)]
        at = rng.randrange(12)
        texts.append("\n".join(own[:at] + (passages[i % 4] if i % 4 < 3 else []) + own[at:]))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, _id int, removed string")
    out = {r.doc_id: r for r in linededup.remove_repeated(docs).collect()}
    assert all(r._id == 1 for r in out.values())
    seen = set()
    for i, t in enumerate(texts):
        lines, passage = t.split("\n"), passages[i % 4] if i % 4 < 3 else []
        words = sum(len(x.split()) for x in passage)
        want = [x for x in lines if x not in passage] if passage and i % 4 in seen and words >= 50 else lines
        if not passage or i % 4 not in seen or words >= 50:
            assert out[i].clean_text.split("\n") == want
        seen.add(i % 4)


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 9, "a", 777, 778, "p") for i in range(6)], "doc_id long, text string, source string, size long, target long, _p string")
    mixed = mixing.apply_mix(docs).collect()
    assert mixed and all((r["size"], r["target"], r["_p"]) == (777, 778, "p") for r in mixed)
    printed = fingerprints.fingerprint(docs.withColumn("fingerprint", F.lit("old"))).collect()
    assert all(r["_p"] == "p" and r.fingerprint != "old" for r in printed)


def test_the_pipeline_stage_by_stage(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    good, bad = [f"river{i}" for i in range(40)], ["BUY!!", "NOW!!", "###", "$$$"]
    item = " ".join(f"question{i}" for i in range(20)) + ". " + " ".join(f"answer{i}" for i in range(8)) + "."
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(60)), "en", f"s{i % 3}", None) for i in range(80)]
    rows += [(100, rows[1][1], "en", "s1", 1), (101, rows[2][1] + " more", "en", "s1", 1), (102, rows[5][1] + " " + item, "en", "s0", 1), (103, None, "en", None, None), (104, "", "en", "s0", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text, docs, kept = {r[0]: r[1] for r in rows}, spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r.doc_id for r in docs.collect())
    assert {i for i in range(80) if i % 4} <= set(kept["quality"]) and not {i for i in range(80) if i % 4 == 0} & set(kept["quality"])
    cache = WordHashes()
    sets = {i: neardup.weighted_shingles(text[i], cache) for i in kept["quality"]}
    alike = [(i, j) for i in sets for j in sets if i < j and neardup.similarity(sets[i], sets[j]) >= 0.8]
    assert {(1, 100), (2, 101)} <= set(alike) and set(kept["near_dedup"]) == set(sets) - {j for _, j in alike}
    assert kept["decontaminate"] == [i for i in kept["near_dedup"] if item not in (text[i] or "")] and 102 in kept["near_dedup"]
    assert set(kept["mix"]) <= set(kept["decontaminate"]) and max(kept["mix"].count(i) for i in kept["mix"]) <= 3
    blocks = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    blocks.write.parquet(str(tmp_path / "ids"))
    read = tokenids.read_documents(spark, str(tmp_path / "ids")).collect()
    plain = Tokenizer.from_file(tokenizer())
    want = sorted((i, zlib.crc32(np.array([*plain.encode(text[i] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i in kept["mix"])
    assert sorted((r.doc_id, r.ids_crc32) for r in read) == want


def test_toxicity(spark, edges, empty):
    rng = random.Random(9)
    prose = lambda n: [f"v{rng.randrange(50)}" for _ in range(n)]
    rows = []
    for i in range(300):
        words = prose(30)
        if i % 3 == 0:
            words[5:5] = ["grumble", "vile"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels, fold("doc_id", 4) != 2)
    held = toxicity.score_toxicity(docs, model).where(fold("doc_id", 4) == 2).collect()
    assert held and all((r.toxicity >= 0.3) == (r.doc_id % 3 == 0) for r in held)
    assert all([(p.start, p.end) for p in r.passages] == [(5, 7)] for r in held if r.doc_id % 3 == 0)
    rows = toxicity.score_toxicity(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.toxicity < 0.3 for r in rows) and toxicity.score_toxicity(empty, model).count() == 0


def test_licenses(spark, edges, empty):
    rows = [(1, "x y. Licensed under the Apache License, Version 2.0. z"), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "the license of the version"), (5, " ".join(f"w{i}" for i in range(400)) + " " + licenses.TEMPLATES["MIT"][2].replace("restriction", "limits") + " more words")]
    got = {r.doc_id: [x.name for x in r.licenses] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["CC-BY-NC-4.0"], 3: ["GPL-3.0"], 4: [], 5: ["MIT"]}
    assert all(not r.licenses for r in licenses.scan_licenses(edges).collect()) and licenses.scan_licenses(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.index_templates({"x": ["too short"]})


def test_fingerprints(spark, edges, empty):
    rows = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(edges).collect()}
    assert rows[1] == rows[2] == rows[3] == "-" * 6 * fingerprints.BUCKETS and rows[4] != rows[5]
    assert fingerprints.fingerprint(empty).count() == 0
    rng = random.Random(1)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = [words, words[:390] + ["new"] * 10, words[200:] + words[:200], rng.sample(words, 400), words]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    arrays = fingerprints.fingerprint_array(df, "text", "f").select("doc_id", "f")
    one = arrays.where("doc_id = 0").select(F.col("f").alias("g"))
    like = {r.doc_id: r.x for r in arrays.crossJoin(one).select("doc_id", fingerprints.likeness(F.col("f"), F.col("g")).alias("x")).collect()}
    assert like[0] == like[4] == 1 and like[1] > 0.75 and like[3] < 0.1 and like[1] > like[2] > like[3]


def test_next_document(spark):
    ids = random.Random(2).sample(range(10**6), 500)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, df.select("doc_id"), "doc_id", ["text"]).collect()}
    ids.sort()
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_line_dedup(spark, edges, empty):
    rng = random.Random(3)
    line = lambda: " ".join(f"v{rng.randrange(9000)}" for _ in range(rng.randrange(3, 30)))
    shared = [line() + " and some more words here" * 3 for _ in range(6)]
    docs = [(i, "\n".join([*[line() for _ in range(5)], *(shared if i % 3 == 0 else []), *[line() for _ in range(4)]])) for i in range(12)] + [(50, "a\nb"), (51, "a\nb")]
    rows = {r.doc_id: r for r in linededup.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        want = [x for k, x in enumerate(text.split("\n")) if not (0 < i < 50 and i % 3 == 0 and x in shared)]
        assert rows[i].clean_text == "\n".join(want)
    back = {(r.doc_id, r.clean_text) for r in linededup.remove_repeated(edges).collect()}
    assert back == {(i, t) for i, t, _ in EDGES} and linededup.remove_repeated(empty).count() == 0


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    docs, want = [], {}
    for k in range(40):
        sizes = [3 + k % 7] * (51 // (3 + k % 7) + 1) if k < 28 else rng.choices(range(1, 30), k=10) + [25]
        passage = [x for n in sizes for x in ([line(n), "", ""] if k % 3 == 0 else [line(n)])]
        while not passage[-1]:
            passage.pop()
        for i in (2 * k, 2 * k + 1):
            before, after = [line(9) for _ in range(rng.randrange(4))], [line(9) for _ in range(rng.randrange(4))]
            docs.append((i, "\n".join(before + passage + after)))
            want[i] = docs[-1][1] if i == 2 * k else "\n".join(before + after)
    rows = linededup.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.clean_text for r in rows} == want


def test_leaks_of_long_items():
    rng = random.Random(11)
    prose = lambda n: " ".join(f"v{rng.randrange(50000)}" for _ in range(n))
    items = [(n, f"{prose(n - 10)}. {prose(10)}.") for n in (15, 59, 64, 65, 97, 161, 300, 1000)]
    index = decontam.build_index(items)
    for n, text in items:
        words = decontam.words_of(text)
        assert len(words) == n
        for before in (0, 7, 31, 150):
            assert [h[0] for h in decontam.hits(prose(before).split() + words + prose(40).split(), index, 0.6, 0.6)] == [n]
        if n > 64:
            assert not decontam.hits(prose(50).split() + words[: n // 3] + prose(50).split(), index, 0.6, 0.6)
    assert len(index.owner) > len(index.ids) and decontam.build_index(items[:3]).owner == [0, 1, 2]


def test_leaks_do_not_depend_on_shards(spark):
    rng = random.Random(13)
    topic = [f"t{i}" for i in range(12)]
    words = lambda n: [rng.choice(topic) if rng.random() < 0.5 else f"v{rng.randrange(300)}" for _ in range(n)]
    items = [(i, f"{' '.join(words(14))}. {' '.join(words(8))}.") for i in range(30)] + [(30 + i, " ".join(f"o{rng.randrange(300)}" for _ in range(20))) for i in range(60)]
    docs = []
    for i, text in items * 4:
        held = [w if rng.random() < 0.75 else "other" for w in decontam.words_of(text)]
        docs.append((len(docs), " ".join(["x"] * 50 + held + ["y"] * 50)))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [{(r.id, r.item, r.word, round(r.score, 9)) for r in decontam.find_leaks(docs, items, overlap=0.4, shard=n).collect()} for n in (1000, 45, 30)]
    assert found[0] and found[0] == found[1] == found[2]


def test_dictionaries_hold_whole_sample(spark):
    rng = random.Random(14)
    header = " ".join("common" for _ in range(400))
    rows = [(i, f"{header} {' '.join(f'{chr(97 + i % 26)}{chr(97 + i // 26)}tail' for _ in range(600))}", "xx") for i in range(200)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = languages.learn_languages(docs, F.lit(True))["xx"]
    assert len(held) <= 112 << 10 and all(f"{chr(97 + i % 26)}{chr(97 + i // 26)}tail".encode() in held for i in range(200))
    assert languages._fill([b"ab", b"c" * 50, b""], 1000) == b"ab " + b"c" * 50 + b" "
