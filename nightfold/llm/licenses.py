"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are lower-cased without outer punctuation, shingles have five of them. Window lengths double from BASE shingles, and
windows of a length overlap by half, so a passage of at most half a length lies whole in one of them. A template of n
shingles is looked for at the shortest length of at least 2.5 n: a copy with up to a quarter more words, and a
CONTAINMENT of 0.8, then has a Jaccard similarity of at least 0.8 / 5.2 with some window (shorter templates than
BASE / 2.5 shingles: 0.8 / BASE). A band is one minimum; with BANDS = 96 bands such a window shares one with the
template with a probability over 0.9999. What the bands retrieve is verified on the words themselves.

Templates are handled in blocks of bounded size, each one pass over the documents, which are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BASE = 8
BANDS = 96
BLOCK_CHARS = 2_000_000
SEED = 5
SLICE = 1 << 12  # shingles that are looked at together
BATCH = 1 << 20  # characters of texts that are looked at together

#: Public license notices (fixed values).
TEMPLATES = [
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mit-line", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]

_OUTER = b".,;:!?\"'()[]{}<>*"


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def words_of(text: str | None) -> list[bytes]:
    words = [w.strip(_OUTER) for w in (text or "").lower().encode("utf-8", "replace").split()]
    return [w for w in words if w]


_rng = np.random.default_rng(SEED)
_MIX = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_TURN = (_rng.integers(1, 1 << 32, BANDS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, BANDS, dtype=np.uint32)[:, None]


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A 32-bit hash of every five words in a row."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out += (h[i : i + n] ^ h[i : i + n] >> np.uint64(31)) * _MIX[i]
    return (out >> np.uint64(32)).astype(np.uint32)


def windows(shingles: int) -> int:
    """The window length, in shingles, at which a template is looked for."""
    length = BASE
    while length < 2.5 * shingles:
        length *= 2
    return length


class Scanner:
    """The templates of one block, and the search for them."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names: list[str] = []
        self.sets: list[set[tuple[bytes, ...]]] = []
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = {}  # length -> (band, minimum) -> templates
        for name, text in templates:
            words = words_of(text)
            h = shingle_hashes(words)
            if not len(h):
                continue
            t = len(self.names)
            self.names.append(name)
            self.sets.append({tuple(words[i : i + SHINGLE]) for i in range(len(h))})
            bands = self.bands.setdefault(windows(len(h)), defaultdict(list))
            for b, low in enumerate((h[None, :] * _TURN + _ADD).min(axis=1).tolist()):
                bands[b, low].append(t)
        self.lengths = sorted(self.bands)
        self.filters = {}  # length -> whether a band has a minimum with these first 16 bits
        for w in self.lengths:
            table = np.zeros(BANDS << 16, dtype=bool)
            table[[b << 16 | low >> 16 for b, low in self.bands[w]]] = True
            self.filters[w] = table

    def retrieve(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, end) of the windows over `h` that share a band with a template."""
        out: set[tuple[int, int, int]] = set()
        n = len(h)
        if not n or not self.lengths:
            return out
        longest = self.lengths[-1]
        size = max(SLICE, longest)
        row = (np.arange(BANDS, dtype=np.uint32) << np.uint32(16))[:, None]
        for lo in range(0, n, size):  # slices overlap by the longest window
            part = h[lo : lo + size + longest]
            half = BASE // 2
            part = np.concatenate([part, np.repeat(part[-1:], -len(part) % half)])
            low = part[None, :] * _TURN
            low += _ADD
            for _ in range(half.bit_length() - 1):
                low = np.minimum(low[:, 0::2], low[:, 1::2])  # at the end of half the shortest windows
            for length in self.lengths:
                while half < length // 2:
                    even = low[:, 0::2].copy()
                    np.minimum(even[:, : low.shape[1] // 2], low[:, 1::2], out=even[:, : low.shape[1] // 2])
                    low, half = even, half * 2
                both = np.minimum(low, np.concatenate([low[:, 1:], low[:, -1:]], axis=1))
                for band, at in np.argwhere(self.filters[length].take(both >> np.uint32(16) | row)).tolist():
                    for t in self.bands[length].get((band, int(both[band, at])), ()):
                        out.add((t, lo + at * half, min(n, lo + at * half + length)))
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text (license, containment, first word, words) of the templates whose shingles are in one of the
        retrieved windows to CONTAINMENT at least; the best window, the first of equals."""
        words = [words_of(t) for t in texts]
        hashes = [shingle_hashes(w) for w in words]
        ends = np.cumsum([0, *map(len, hashes)])
        spans: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for t, a, b in self.retrieve(np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)):  # all texts in a row
            for d in range(int(np.searchsorted(ends, a, side="right")) - 1, int(np.searchsorted(ends, b, side="left"))):
                if ends[d] < ends[d + 1]:
                    spans[d, t].add((max(0, a - int(ends[d])), min(len(hashes[d]), b - int(ends[d]))))
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        for (d, t), where in sorted(spans.items()):
            best = None
            for a, b in sorted(where):
                shingles = [tuple(words[d][i : i + SHINGLE]) for i in range(a, b)]
                places = [a + i for i, x in enumerate(shingles) if x in self.sets[t]]
                share = len({x for x in shingles if x in self.sets[t]}) / len(self.sets[t])
                if share >= CONTAINMENT and (best is None or share > best[0]):
                    best = share, places[0], places[-1] + SHINGLE - places[0]
            if best:
                out[d].append((self.names[t], *best))
        return out


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, license, containment, first_word, words) per document and template (license, text) that it holds.

    Null and empty texts, and texts and templates of fewer than five words, match nothing. Repeated documents and
    templates each give their rows; null ids are kept. Other columns are not read. Words are counted after
    those that are punctuation alone are left out.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    out = None
    for block in _blocks(templates, block_chars):
        found = slim.select("doc_id", F.explode(_finder(spark, block)("_t")).alias("h")).select("doc_id", "h.*")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, license string, containment double, first_word int, words int")


def _finder(spark: SparkSession, block: list[tuple[str, str]]):
    sent = spark.sparkContext.broadcast(block)

    @F.pandas_udf("array<struct<license:string,containment:double,first_word:int,words:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(sent.value)
        for texts in batches:
            out, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size > BATCH:
                    out += scanner.find(held)
                    held, size = [], 0
            out += scanner.find(held)
            yield pd.Series([[dict(zip(("license", "containment", "first_word", "words"), x)) for x in found] for found in out], dtype=object)

    return run


def _blocks(templates: DataFrame, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    for r in templates.select("license", "text").where("text is not null").toLocalIterator():
        if held and size + len(r.text) > block_chars:
            yield held
            held, size = [], 0
        held.append((r.license, r.text))
        size += len(r.text)
    if held:
        yield held
