"""Operator 8: license scans by MinHash bands over overlapping text windows.

A template of n words belongs to the largest window length of ``LENGTHS`` that it reaches, and each of its windows of that
length is indexed; documents are read with windows of every length at every word. Windows are sets of five-word shingles
with ``BANDS`` bands of ``ROWS`` minima each: a document window equal to a template's is retrieved for certain, and one of
similarity 0.8 with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.9997. Each retrieved place is then verified: the share of the
template's shingles that occur in the words about that place must reach ``threshold``.

The templates are a parameter; their index is broadcast, and more than ``MOST_WORDS`` words of them are refused (scan with parts of them,
one after the other). Templates of under five words are refused too, as they have no shingle.

Edge cases: null, empty and wordless texts have no license; repeated rows get equal results; several places of one
template are one result with its first place and best containment; of overlapping places the best stays, or all if equal; further columns
pass through, a column named licenses is replaced. Whole texts are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import WordHashes, batches, extended, map_arrow, mix, shingle_hashes, word_array, words_of
from gleaner.sources.tables import read_table

K, BANDS, ROWS, LENGTHS, MOST_WORDS = 5, 8, 2, (5, 8, 16, 32), 200_000

#: Wordings of well-known license notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


def _windows(h: np.ndarray, m: int) -> np.ndarray:
    """Minima of all runs of ``m`` hashes."""
    wide = 1
    while 2 * wide <= m:
        h, wide = np.minimum(h[:-wide], h[wide:]) if len(h) > wide else h[:0], 2 * wide
    rest = m - wide
    return (np.minimum(h[:-rest], h[rest:]) if len(h) > rest else h[:0]) if rest else h


def band_keys(shingles: np.ndarray, m: int) -> list[np.ndarray]:
    """For each band, a key for every window of ``m`` shingles."""
    keys = []
    for b in range(BANDS):
        key = None
        for r in range(ROWS):
            low = _windows(mix(shingles ^ np.uint64(0x9E3779B97F4A7C15 * (b * ROWS + r + 1) & (1 << 64) - 1)), m)
            key = mix(low + np.uint64(b)) if key is None else mix(key * np.uint64(0xD1B54A32D192ED03) + low)
        keys.append(key)
    return keys


@dataclass
class Templates:
    names: list[str]
    lengths: list[int]
    shingles: list[np.ndarray]
    places: list[dict[int, list[tuple[int, int]]]]  # for each length: key -> (template, offset)
    sieves: list[np.ndarray]


def index_templates(templates: dict[str, list[str]]) -> Templates:
    cache, out = WordHashes(), Templates([], [], [], [{} for _ in LENGTHS], [np.zeros(1 << 18, bool) for _ in LENGTHS])
    for name, texts in sorted(templates.items()):
        for text in texts:
            words = word_array(words_of(text), cache)
            if len(words) < K:
                raise ValueError(f"a template of {name} has fewer than {K} words")
            at = max(i for i, n in enumerate(LENGTHS) if n <= len(words))
            shingles = shingle_hashes(words, K)
            for keys in band_keys(shingles, LENGTHS[at] - K + 1):
                for offset, key in enumerate(keys.tolist()):
                    out.places[at].setdefault(key, []).append((len(out.names), offset))
                    out.sieves[at][key & (1 << 18) - 1] = True
            out.names.append(name), out.lengths.append(len(words)), out.shingles.append(np.unique(shingles))
    if sum(out.lengths) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words of templates")
    return out


def _best(places: list[tuple[float, int, int, str]]) -> list[dict]:
    """By name, the first place and best containment, without places that overlap a better one by half their words."""
    kept: dict[str, tuple[int, float]] = {}
    for share, start, end, name in places:
        if not any(s > share and 2 * (min(e, end) - max(b, start)) >= end - start for s, b, e, _ in places):
            word, best = kept.get(name, (start, 0.0))
            kept[name] = (min(word, start), max(best, share))
    return [{"name": n, "word": w, "containment": c} for n, (w, c) in sorted(kept.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8, text_col: str = "text") -> DataFrame:
    """``docs`` with licenses: name, first word and containment of each license found, by name."""
    shared = docs.sparkSession.sparkContext.broadcast(index_templates(templates))
    docs, schema = extended(docs, licenses="array<struct<name:string,word:int,containment:double>>")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, t = WordHashes(), shared.value
        for batch, texts in batches(it, text_col):
            words = [word_array(words_of(x), cache) for x in texts]
            sizes = np.array([max(len(w) - K + 1, 0) for w in words])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            shingles = np.concatenate([shingle_hashes(w, K) if len(w) >= K else np.zeros(0, np.uint64) for w in words]) if words else np.zeros(0, np.uint64)
            found: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
            checked = set()
            for i, length in enumerate(LENGTHS):
                if not t.places[i]:
                    continue
                m = length - K + 1
                for keys in band_keys(shingles, m):
                    for at in np.flatnonzero(t.sieves[i][(keys & np.uint64((1 << 18) - 1)).astype(np.int64)]).tolist():
                        for which, offset in t.places[i].get(int(keys[at]), ()):
                            doc = int(np.searchsorted(starts, at, side="right")) - 1
                            if at + m > starts[doc + 1] or (at - offset, which) in checked:
                                continue
                            checked.add((at - offset, which))
                            first = at - offset - int(starts[doc])
                            low, high = max(first - K, 0), first + t.lengths[which] + K
                            near = shingles[starts[doc] + low : min(starts[doc] + high, starts[doc + 1])]
                            share = float(np.isin(t.shingles[which], near).mean())
                            if share >= threshold:
                                found[doc].append((share, max(first, 0), first + t.lengths[which], t.names[which]))
            kind = pa.list_(pa.struct([("name", pa.string()), ("word", pa.int32()), ("containment", pa.float64())]))
            rows = pa.array([_best(f) for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], [*batch.schema.names, "licenses"])

    return map_arrow(docs, run, schema)


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: x["name"]), ",").alias("licenses"), F.array_min(F.transform("licenses", lambda x: x["word"])).alias("first_word"))
