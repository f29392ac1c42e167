"""Exact near pairs with little on disk: sets are never stored, only made anew, from texts or from the entries that they hold.

Of texts nothing is stored: each step reads them and cuts them into hashed tokens. Other entries (hashes of words) are written
once; all later steps read them and make the sets of runs anew. Equal sets make one class. Two classes that share the least hash of their sets, by one of two orders, meet in
a bucket, where all overlaps are counted; large buckets are cut into blocks, and each pair of blocks is a unit of its own. All
other pairs are found by prefix filtering: with the hashes of each set ordered from the rarest, two similar sets share one of the
first n - ceil(threshold * n) + 1, and after the first that they share both have enough left. These hashes are sent in cells: for each, 32 bits
that its cell doesn't tell and its place; for each set, 32 bits of its class, its size and those of its buckets that others share. Such short
values may only add pairs. Sets meet only if parities of the hashes, a bit for about two of them, don't rule it out.
Shuffles of a step that is written are removed with it. The counts by which hashes are ordered are approximate and only settle the cost: any order gives the same pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.tokens import hashed_tokens
from gleaner.sources.folders import shared_folder, written

#: A hash is put behind others from so many occurrences, from the third on that a worker sees; at most so many are known.
OFTEN, KNOWN = 4, 1 << 19
#: Counts are sent from so many occurrences on.
SENT = 8
#: Bytes of a worker's sketch of hashes seen.
SEEN = 1 << 26
#: Classes of a block, most bits of the filter by ids, values that are counted at once.
BLOCK, BITS, AT_ONCE = 512, 1 << 26, 1 << 22
#: Cells of prefixes at least, so that a set has about one hash in each on small tables, too; hashes of a cell at most, about.
CELLS, CELL = 128, 1 << 21
#: zstandard level of texts and entries that are sent.
LEVEL = 9
_LOW = np.uint64(0xFFFFFFFF)
_META = "id {id}, c long, g long, n int, bits binary, h long, times long"
_UNIT = "level int, u long, i int, j int, block int, c long, g long, packed binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(lists: pa.ListArray, seeds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the runs of ``k`` entries of each list; those of other blocks, which have other seeds, differ."""
    ends, x = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
    ends = (ends - ends[0]).tolist()
    h = np.zeros(max(0, len(x) - k + 1), np.uint64)
    for j in range(k):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + x[j : len(x) - k + 1 + j])
    for a, b, seed in zip(ends, ends[1:], seeds.astype(np.int64).view(np.uint64), strict=False):
        own = _mixed(h[a : max(a, b - k + 1)] ^ seed)
        own.sort()
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _named(s: np.ndarray) -> tuple[int, int]:
    """The class of a set and its two buckets, of 32 bits each."""
    c = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
    return c, _signed(int(s[0] & _LOW) << 32 | int(_mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).min() & _LOW))


def _parities(s: np.ndarray) -> bytes:
    wide = 1 << max(8, (len(s) // 2).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(8)).astype(np.int64) & (wide - 1), minlength=wide) & 1).astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of the hashes in one set only: the bits in which the parities differ, folded to the same width."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y[: len(y) // 2] ^ y[len(y) // 2 :]) if len(x) < len(y) else (x[: len(x) // 2] ^ x[len(x) // 2 :], y)
    return int(np.bitwise_count(x ^ y).sum())


def _packed(e: pa.Scalar, seed: int) -> bytes:
    """A text or list of entries with its seed."""
    own = e.as_py().encode() if pa.types.is_string(e.type) else np.asarray(e.values).astype(np.int64).tobytes()
    raw = seed.to_bytes(8, "little", signed=True) + own
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def _unpacked(data: bytes, k: int, is_text: bool) -> np.ndarray:
    raw = pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    own = np.frombuffer(raw, np.int64) if not is_text else None
    lists = hashed_tokens(pa.array([raw[8:].decode()])) if is_text else pa.ListArray.from_arrays(pa.array([0, len(own) - 1], pa.int32()), pa.array(own[1:]))
    return next(_sets(lists, np.frombuffer(raw[:8], np.int64), k))


@lru_cache(1)
def _sketch(run: str) -> tuple[np.ndarray, list[int]]:
    """How often hashes came, for all tasks of a worker in a run, and how many came."""
    return np.zeros(SEEN, np.uint8), [0]


def _frequent(run: str, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sets that the worker has seen three times or more, and their number in these sets; some may be others."""
    seen, many = _sketch(run)
    h, n = np.unique(np.concatenate(sets), return_counts=True)
    many[0] += len(h)
    if many[0] > SEEN:
        seen[:], many[0] = 0, len(h)
    spot = (h & np.uint64(SEEN - 1)).astype(np.int64)
    times = np.minimum(seen[spot] + n, 255)
    seen[spot] = times
    return h[times > 2].view(np.int64), n[times > 2]


def _cells(sets: list[tuple[np.ndarray, int, int, int, int]], cells: int) -> pa.RecordBatch:
    """(cell, packed) of prefixes, each with its set's size, class and two buckets, where a bucket is -1 if no other set shares it."""
    h = np.concatenate([s[0] for s in sets])
    size = np.array([len(s[0]) for s in sets])
    of = np.array([s[1:] for s in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), size)
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    cell = ((h & np.uint64(0xFFFFFF)) * np.uint64(cells) >> np.uint64(24)).astype(np.int64)
    by = np.argsort(cell.astype(np.int16) if cells < 1 << 15 else cell, kind="stable")
    short = (h >> np.uint64(24)).astype(np.uint32)
    ends, codec, out = np.searchsorted(cell[by], np.arange(cells + 1)), pa.Codec("zstd", compression_level=1), []
    for i in np.flatnonzero(np.diff(ends)).tolist():
        rows = by[ends[i] : ends[i + 1]]
        own, many = np.unique(who[rows], return_counts=True)
        n, c, *buckets = of[own].T
        shared = [u[u >= 0] for u in buckets]
        parts = [short[rows], place[rows], many, n, c & 0xFFFFFFFF, *shared]
        raw = [np.array([len(rows), len(own), *map(len, shared)], "<u4").tobytes(), *(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in parts), *(np.packbits(u >= 0).tobytes() for u in buckets)]
        out.append((i, len(raw := b"".join(raw)).to_bytes(4, "little") + codec.compress(raw, asbytes=True)))
    return _batch({"cell": ([x[0] for x in out], pa.int32()), "packed": ([x[1] for x in out], pa.binary())})


def _opened(cell: int, data: bytes) -> list[np.ndarray]:
    """Of each hash that ``_cells`` has packed: its key, place, set's size, short class and buckets."""
    raw = np.frombuffer(pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), np.uint8)
    rows, own, *some = raw[:16].view("<u4").tolist()
    at, parts = 16, []
    for size in (rows, rows, own, own, own, *some):
        parts.append(np.ascontiguousarray(raw[at : at + 4 * size].reshape(4, -1).T).view("<u4").ravel().astype(np.int64))
        at += 4 * size
    short, place, many, n, c, *shared = parts
    buckets = []
    for u in shared:
        whole = np.full(own, -1, np.int64)
        whole[np.unpackbits(raw[at : at + (own + 7) // 8], count=own).astype(bool)] = u
        at += (own + 7) // 8
        buckets.append(whole)
    return [short.view(np.uint64) | np.uint64(cell << 32), place, *(np.repeat(x, many) for x in (n, c, *buckets))]


def _meetings(key: np.ndarray, place: np.ndarray, n: np.ndarray, c: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of short classes, each in one number, whose sets share a key, no bucket, and can still be similar if it is the first they share."""
    by = np.argsort(key, kind="stable")
    key, n, c, first, second, rest = (x[by] for x in (key, n, c, first, second, n - place))
    out, used = [], 0
    for x, y in _equal_runs(key):
        near = np.minimum(rest[x], rest[y]) >= (n[x] + n[y]) * (threshold / (1 + threshold)) - 1e-6
        for u in (first, second):
            near &= (u[x] != u[y]) | (u[x] < 0)
        x, y = c[x[near]], c[y[near]]
        out.append(np.minimum(x, y) << 32 | np.maximum(x, y))
        used += len(x)
        if used > AT_ONCE // 4:
            yield np.unique(np.concatenate(out))
            out, used = [], 0
    if used:
        yield np.unique(np.concatenate(out))


def _batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _slices(it: Iterator[pa.RecordBatch], most: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k in range(0, len(batch), most):
            yield batch.slice(k, most)


def _equal_runs(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal values in a sorted array, by their distance."""
    d, at = 1, np.flatnonzero(h[1:] == h[:-1])
    while len(at):
        yield at, at + d
        d += 1
        at = at[at + d < len(h)]
        at = at[h[at] == h[at + d]]


def near_classes(df: DataFrame, entries, block: str, id_col: str, threshold: float, k: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, class) of each row with a set, and (a, b, similarity) of all near pairs of different classes, each once.

    ``entries`` is a text, whose tokens count, or an array of longs; rows with less than ``least`` or ``k`` of them have no set.
    """
    spark, base = df.sparkSession, shared_folder(df.sparkSession, "near")
    at = lambda name: f"{base}/{name}"
    kind = df.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    put = lambda rows, name: written(rows, at(name))
    least = max(least, k)
    rows = df.where(F.col(block).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(block).alias("seed"), entries.alias("e"))
    is_text = rows.schema["e"].dataType.simpleString() == "string"
    if is_text:
        rows = rows.where(F.length("e") >= least)
    else:
        rows.where(F.size("e") >= least).write.option("compression", "zstd").parquet(at("entries"))
        rows = spark.read.schema(f"id {kind}, seed long, e array<bigint>").parquet(at("entries"))

    def opened(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.ListArray, np.ndarray]]:
        """Rows with enough entries, these, and seeds."""
        for batch in _slices(it):
            lists = batch.column("e")
            if is_text and len(batch):
                lists = hashed_tokens(lists)
                enough = pa.array(np.diff(np.asarray(lists.offsets)) >= least)
                batch, lists = batch.filter(enough), lists.filter(enough)
            if len(batch):
                yield batch, lists, np.asarray(batch.column("seed"))

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = [], 0

        def counted() -> pa.RecordBatch:
            h, n = _frequent(base, held)
            keep = _sketch(base)[0][h & (SEEN - 1)] >= SENT
            h, n = h[keep], n[keep]
            none = pa.nulls(len(h))
            return _batch({"id": (none.cast(id_type), id_type), "c": (none, pa.int64()), "g": (none, pa.int64()), "n": (none, pa.int32()), "bits": (none, pa.binary()), "h": (h, pa.int64()), "times": (n, pa.int64())})

        for batch, lists, seeds in opened(it):
            sets = list(_sets(lists, seeds, k))
            c, g = zip(*map(_named, sets), strict=True)
            none = [None] * len(sets)
            yield _batch({"id": (batch.column("id"), id_type), "c": (c, pa.int64()), "g": (g, pa.int64()), "n": (list(map(len, sets)), pa.int32()), "bits": (list(map(_parities, sets)), pa.binary()), "h": (none, pa.int64()), "times": (none, pa.int64())})
            held += sets
            used += sum(map(len, sets))
            if used > AT_ONCE:
                yield counted()
                held, used = [], 0
        if held:
            yield counted()

    described = put(rows.mapInArrow(describe, _META.format(id=kind)), "described")
    members = described.where("h IS NULL").select("id", F.col("c").alias("class"))
    classes = put(described.where("h IS NULL").groupBy("c").agg(F.min("id").alias("id"), F.first("g").alias("g"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    often = described.where("h IS NOT NULL").groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN)
    often = often.orderBy(F.desc("times"), "h").limit(KNOWN).toArrow()
    by = np.argsort(common := np.asarray(often.column("h")).astype(np.int64).view(np.uint64))
    common, times = common[by], np.asarray(often.column("times")).astype(np.int64)[by]

    many, hashes = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wide = min(BITS, max(1 << 15, 1 << (16 * many).bit_length()))

    def filter_of(ids: DataFrame) -> np.ndarray:
        """Bits of the ids' hashes; other ids may pass."""
        spot = ids.select((F.pmod(F.xxhash64("id"), F.lit(wide)) + 1).alias("x"))  # bitmaps count from 1
        maps = spot.groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m")).collect()
        bits = np.zeros(wide // 8, np.uint8)
        for r in maps:
            bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
        return bits

    spotted = rows.select("id", "seed", "e", F.pmod(F.xxhash64("id"), F.lit(wide)).alias("x"))
    passes = lambda x, bits: (bits[x >> 3] >> (x & 7) & 1).astype(bool)

    def only(it: Iterator[pa.RecordBatch], *bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows that one of the filters lets pass."""
        for batch in it:
            x = np.asarray(batch.column("x"))
            yield batch.filter(pa.array(np.logical_or.reduce([passes(x, b) for b in bits])))

    # ---- pairs that share a bucket
    both = classes.select("id", "c", F.shiftrightunsigned("g", 32).alias("first"), F.explode(F.array(*[F.struct(F.lit(v).alias("level"), u.alias("u")) for v, u in ((1, F.shiftrightunsigned("g", 32)), (2, F.col("g").bitwiseAND(0xFFFFFFFF)))])).alias("b")).select("id", "c", "first", "b.*")
    # A second bucket only settles pairs whose first ones differ.
    shared = both.groupBy("level", "u").agg(F.count("*").alias("times"), (F.min("first") < F.max("first")).alias("apart"))
    shared = put(shared.where("times > 1 AND (level = 1 OR apart)").drop("apart"), "buckets")
    large = {(r.level, r.u): -(-r.times // BLOCK) for r in shared.where(F.col("times") > BLOCK).toLocalIterator()}
    meets = {v: filter_of(both.where(F.col("level") == v).join(shared, ["level", "u"], "left_semi")) for v in (1, 2)}

    def units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lists, seeds in opened(only(it, *meets.values())):
            x, out = np.asarray(batch.column("x")), []
            sent, texts = {v: passes(x, meets[v]) for v in (1, 2)}, batch.column("e")
            for at_row, s in enumerate(_sets(lists, seeds, k)):
                c, g = _named(s)
                data = _packed(texts[at_row], int(seeds[at_row]))
                for level, u in ((1, g >> 32 & 0xFFFFFFFF), (2, g & 0xFFFFFFFF)):
                    if not sent[level][at_row]:
                        continue
                    n = large.get((level, u), 1)
                    own = c % n
                    out += [(level, u, min(own, i), max(own, i), own, c, g, data) for i in range(n)]
            if out:
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in _UNIT.split(", ")])

    def overlaps(unit: pa.Table) -> pa.Table:
        one = dict(zip(unit.column("c").to_pylist(), zip(*(unit.column(x).to_pylist() for x in ("block", "g", "packed")), strict=True), strict=True))
        names, level = np.array(list(one), np.int64), unit.column("level")[0].as_py()
        across = unit.column("i")[0].as_py() != unit.column("j")[0].as_py()
        m, found = len(names), ([], [], [])
        if m > 1:
            sets = [_unpacked(v[2], k, is_text) for v in one.values()]
            blocks, first = np.array([v[0] for v in one.values()]), np.array([v[1] for v in one.values()], np.int64) >> 32
            size = np.array(list(map(len, sets)))
            h, who = np.concatenate(sets), np.repeat(np.arange(m), size)
            by = np.argsort(h, kind="stable")
            h, who = h[by], who[by]
            total, held, used = np.zeros(m * m, np.int64), [], 0
            for x, y in _equal_runs(h):
                held.append(who[x] * m + who[y])
                used += len(x)
                if used > AT_ONCE:
                    total += np.bincount(np.concatenate(held), minlength=m * m)
                    held, used = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=m * m)
            x, y = np.divmod(np.flatnonzero(total), m)
            n = total[x * m + y]
            alike = n / (size[x] + size[y] - n)
            keep = (alike >= threshold) & ((blocks[x] != blocks[y]) | (not across)) & ((level == 1) | (first[x] != first[y]))
            found = names[x[keep]], names[y[keep]], alike[keep]
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "similarity": pa.array(found[2], pa.float64())})

    pair = "a long, b long, similarity double"
    inside = put(spotted.mapInArrow(units, _UNIT).groupBy("level", "u", "i", "j").applyInArrow(overlaps, pair), "inside")

    # ---- pairs that share none
    own = filter_of(classes.select("id"))

    cells = max(CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((1 - threshold) * hashes / CELL))

    def prefixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = [], 0
        for batch, lists, seeds in opened(only(it, own)):
            sent = [passes(np.asarray(batch.column("x")), meets[v]) for v in (1, 2)]
            for at_row, s in enumerate(_sets(lists, seeds, k)):
                c, g = _named(s)
                n = len(s)
                first = n - math.ceil(n * threshold - 1e-9) + 1
                if len(common):
                    spot = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[spot] == s, times[spot], 0)
                    s = s[np.argsort(rank, kind="stable")[:first]] if rank.any() else s
                held.append((s[:first], n, c, g >> 32 & 0xFFFFFFFF if sent[0][at_row] else -1, g & 0xFFFFFFFF if sent[1][at_row] else -1))
                used += first
                if used > AT_ONCE // 4:
                    yield _cells(held, cells)
                    held, used = [], 0
        if held:
            yield _cells(held, cells)

    def candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_opened(*x) for batch in it for x in zip(*(batch.column(v).to_pylist() for v in ("cell", "packed")), strict=True)]
        if parts:
            for ab in _meetings(*map(np.concatenate, zip(*parts, strict=True)), threshold):
                yield _batch({"ab": (ab, pa.int64())})

    def possible(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, m, x, y = (batch.column(v).to_pylist() for v in ("n", "m", "x", "y"))
            keep = [_apart(p, q) <= (i + j) * (1 - threshold) / (1 + threshold) + 1e-6 for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    meeting = spotted.mapInArrow(prefixes, "cell int, packed binary").repartitionById(cells, "cell").mapInArrow(candidates, "ab long").distinct()
    meeting = meeting.select(F.shiftrightunsigned("ab", 32).alias("p"), F.col("ab").bitwiseAND(0xFFFFFFFF).alias("q"))
    of = lambda *names: classes.select(F.col("c").bitwiseAND(0xFFFFFFFF), "c", "g", "n", "bits").toDF(*names)
    named = meeting.join(of("p", "a", "g", "n", "x"), "p").join(of("q", "b", "o", "m", "y"), "q").where("p < q OR a < b")
    apart = (F.shiftrightunsigned("g", 32) != F.shiftrightunsigned("o", 32)) & (F.col("g").bitwiseAND(0xFFFFFFFF) != F.col("o").bitwiseAND(0xFFFFFFFF))
    left = put(named.where(apart).select("a", "b", "n", "m", "x", "y").mapInArrow(possible, "a long, b long"), "possible")
    wanted = filter_of(classes.join(left.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi").select("id"))

    def fetched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lists, seeds in opened(only(it, wanted)):
            yield _batch({"id": (batch.column("id"), id_type), "c": ([_named(s)[0] for s in _sets(lists, seeds, k)], pa.int64()), "packed": ([_packed(x, int(s)) for x, s in zip(batch.column("e"), seeds, strict=True)], pa.binary())})

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            alike, last = [], (None, None)
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                last = last if last[0] == y else (y, _unpacked(y, k, is_text))
                s, t = _unpacked(x, k, is_text), last[1]
                n = len(np.intersect1d(s, t, assume_unique=True))
                alike.append(n / (len(s) + len(t) - n))
            yield _batch({"a": (batch.column("a"), pa.int64()), "b": (batch.column("b"), pa.int64()), "similarity": (alike, pa.float64())})

    sets = spotted.mapInArrow(fetched, f"id {kind}, c long, packed binary").join(classes.select("id", "c"), ["id", "c"], "left_semi").select("c", "packed")
    sets = put(sets, "sets")
    held = left.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    across = put(held.mapInArrow(compared, pair).where(F.col("similarity") >= threshold), "across")
    return members, inside.unionByName(across)
