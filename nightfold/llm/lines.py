"""Line dedup by pairwise alignment.

Every line of every document is hashed. A line that sets documents apart (at least ANCHOR_WORDS words, or in at most
RARE documents) pairs each later document that holds it with the first one that does: one pair per document and
line, never all pairs of a line's holders. Shorter lines in more documents do so by runs of adjacent ones that have
ANCHOR_WORDS words together. A pair is aligned by patience diff over line hashes; runs of aligned
lines that contain such a line or run are deleted from the later document, and so are further copies of them in it. Documents with equal lines are one class: its
first document is aligned, the others lose all lines; only copies of a single short line in more than RARE documents stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightfold.llm.common import stored

ANCHOR_WORDS = 8
RARE = 50


def line_hash(line: str) -> int:
    """63 bits of a line without outer white space, and whether it has ANCHOR_WORDS words in the lowest bit; 0 if blank."""
    words = line.split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "replace")) | 1
    if len(words) < ANCHOR_WORDS:
        h ^= 1
    return (h or 2) - (1 << 64 if h >= 1 << 63 else 0)


def runs(lines: list[int], words: list[int], among: set[int] | None = None) -> list[tuple[int, int, int]]:
    """(first, last, hash) of the shortest runs of short lines, adjacent up to blank ones, from each line on that have
    ANCHOR_WORDS words; words: of each line; among: the lines that count as short, or else all such."""
    out, places = [], [i for i, h in enumerate(lines) if h]
    for a, first in enumerate(places):
        total = 0
        for b in range(a, min(len(places), a + ANCHOR_WORDS)):
            h = lines[places[b]]
            if h & 1 or among is not None and h not in among:
                break
            total += words[places[b]]
            if total >= ANCHOR_WORDS:
                key = xxhash.xxh64_intdigest(np.array([lines[p] for p in places[a : b + 1]], dtype="<i8").tobytes())
                out.append((first, places[b], key - (1 << 64 if key >= 1 << 63 else 0)))
                break
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both: equal beginnings and ends, then lines that occur once on either
    side in their longest common order, then the same between those; where no line occurs once on either side, the first
    occurrences of a line meet, the second ones, and so on. Blank lines (0) never align."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            if a[i]:
                out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            if a[j]:
                out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        at = {h: p for p, h in enumerate(b[k:m], k) if cb[h] == 1}
        once = [(p, at[h]) for p, h in enumerate(a[i:j], i) if h and ca[h] == 1 and h in at]
        if not once:
            places: dict[int, list[int]] = {}
            for q in range(m - 1, k - 1, -1):
                places.setdefault(b[q], []).append(q)
            once = [(p, places[h].pop()) for p, h in enumerate(a[i:j], i) if h and places.get(h)]
        piles: list[int] = []  # the smallest end of a rising run of each length
        tops: list[int] = []
        back = [-1] * len(once)
        for n, (_, q) in enumerate(once):
            x = bisect_left(piles, q)
            back[n] = tops[x - 1] if x else -1
            if x == len(piles):
                piles.append(q)
                tops.append(n)
            else:
                piles[x], tops[x] = q, n
        if not tops:
            continue
        chain, n = [], tops[-1]
        while n >= 0:
            chain.append(once[n])
            n = back[n]
        last = (i, k)
        for p, q in reversed(chain):
            out.append((p, q))
            todo.append((last[0], p, last[1], q))
            last = (p + 1, q + 1)
        todo.append((last[0], j, last[1], m))
    return sorted(out)


def common_blocks(later: list[int], earlier: list[int], anchors: set[int], words: tuple[list[int], list[int]] | None = None) -> list[int]:
    """Places in `later` of the runs of aligned lines, adjacent on both sides up to blank ones, that hold an anchor (a
    line, or with the words of either side's lines a run); then of anchors that are still there, with the equal lines around
    them."""
    wanted, known = ([(p, p, h) for p, h in enumerate(side) if h in anchors] for side in (later, earlier))
    if words:
        wanted += [r for r in runs(later, words[0]) if r[2] in anchors]
        known += [r for r in runs(earlier, words[1]) if r[2] in anchors]
    ends: dict[int, list[int]] = {}
    for first, last, _ in wanted:
        ends.setdefault(first, []).append(last)
    gone, run, prev = [], [], None
    blank = lambda lines, lo, hi: not any(lines[lo:hi])
    for p, q in [*patience(later, earlier), (None, None)]:
        if prev and (p is None or not blank(later, prev[0] + 1, p) or not blank(earlier, prev[1] + 1, q)):
            own = set(run)
            if any(last in own for x in run for last in ends.get(x, ())):
                gone += run
            run = []
        if p is not None:
            run.append(p)
            prev = (p, q)
    return sorted(gone + _further(later, earlier, wanted, known, set(gone)))


def _further(later: list[int], earlier: list[int], wanted: list[tuple[int, int, int]], known: list[tuple[int, int, int]], gone: set[int]) -> list[int]:
    """Places outside `gone` of the passages (first, last, key) of `later` that `earlier` has at its first passage of that
    key, and of equal lines before and after."""
    at: dict[int, tuple[int, int]] = {}
    for first, last, key in known:
        at.setdefault(key, (first, last))
    out: set[int] = set()
    for first, last, key in wanted:
        own = [p for p in range(first, last + 1) if later[p]]
        if key not in at or any(p in gone or p in out for p in own):
            continue
        out.update(own)
        for step, p, q in ((-1, first - 1, at[key][0] - 1), (1, last + 1, at[key][1] + 1)):
            while True:
                while 0 <= p < len(later) and not later[p]:
                    p += step
                while 0 <= q < len(earlier) and not earlier[q]:
                    q += step
                if not (0 <= p < len(later) and 0 <= q < len(earlier)) or later[p] != earlier[q] or p in gone or p in out:
                    break
                out.add(p)
                p, q = p + step, q + step
    return list(out)


def _key(id_col: str, text: Column) -> Column:
    """One number that orders documents: by id, null ids last, then by a hash of the text."""
    wide = F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (wide * F.lit(str(1 << 56)).cast("decimal(18,0)") + F.xxhash64(text).bitwiseAND(F.lit((1 << 56) - 1))).cast("decimal(38,0)")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, removed, partners): for each document that loses lines, their places and the ids of the documents that
    had them before."""

    @F.pandas_udf("struct<lines:array<long>,words:array<tinyint>>")
    def hashes(texts: pd.Series) -> pd.DataFrame:
        split = [(t or "").split("\n") for t in texts]
        return pd.DataFrame({"lines": [[line_hash(x) for x in own] for own in split], "words": [[min(len(x.split()), ANCHOR_WORDS) for x in own] for own in split]})

    @F.pandas_udf("array<long>")
    def run_hashes(lines: pd.Series, words: pd.Series, among: pd.Series) -> pd.Series:
        return pd.Series([list({r[2] for r in runs(a.tolist(), w.tolist(), set(x))}) for a, w, x in zip(lines, words, among)], dtype=object)

    @F.pandas_udf("array<int>")
    def aligned(later: pd.Series, earlier: pd.Series, anchors: pd.Series, words: pd.Series, words_before: pd.Series) -> pd.Series:
        return pd.Series([common_blocks(a.tolist(), b.tolist(), set(x), (v.tolist(), w.tolist())) for a, b, x, v, w in zip(later, earlier, anchors, words, words_before)], dtype=object)

    text = F.col(text_col)
    lines = docs.select(_key(id_col, text).alias("key"), F.col(id_col).cast("long").alias("id"), hashes(text).alias("h")).select("key", "id", "h.lines", "h.words")
    lines = stored(lines.where(F.exists("lines", lambda h: h != 0)).withColumn("same", F.xxhash64("lines")), "lines")
    first = stored(lines.groupBy("same").agg(F.min("key").alias("key"), F.countDistinct("key").alias("n")), "classes")
    heads = stored(lines.join(first, ["same", "key"]).select("same", "key", "n", "id", "lines", "words").distinct(), "heads")
    held = stored(heads.select("key", "n", F.explode(F.array_distinct("lines")).alias("h")).where("h != 0"), "held")
    shared = stored(held.groupBy("h").agg(F.min("key").alias("owner"), F.sum("n").alias("n")).where("n > 1"), "shared")
    apart_alone = (F.col("h").bitwiseAND(F.lit(1)) == 1) | (F.col("n") <= RARE)
    short = held.join(shared.where(~apart_alone).select("h"), "h").groupBy("key").agg(F.collect_set("h").alias("among"))
    in_runs = stored(heads.join(short, "key").select("key", "n", F.explode(run_hashes("lines", "words", "among")).alias("h")), "runs")
    shared_runs = stored(in_runs.groupBy("h").agg(F.min("key").alias("owner"), F.sum("n").alias("n")).where("n > 1"), "shared-runs")
    pairs = held.join(shared.where(apart_alone).select("h", "owner"), "h").select("key", "owner", "h")
    pairs = stored(pairs.unionAll(in_runs.join(shared_runs.select("h", "owner"), "h").select("key", "owner", "h")), "pairs")
    wanted = stored(pairs.where("key != owner").groupBy("key", "owner").agg(F.collect_set("h").alias("anchors")), "wanted")  # at most a document's lines
    owners = heads.select(F.col("key").alias("owner"), F.col("id").alias("partner"), F.col("lines").alias("before"), F.col("words").alias("words_before"))
    work = wanted.join(owners, "owner").join(heads.select("key", "lines", "words"), "key")
    found = work.select("key", "partner", aligned("lines", "before", "anchors", "words", "words_before").alias("removed")).where(F.size("removed") > 0)
    found = found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"), F.array_sort(F.collect_set("partner")).alias("partners"))
    # Further documents of a class lose every line, if one of them or a run sets it apart, or there are several.
    several = heads.where((F.col("n") > 1) & (F.size(F.filter("lines", lambda h: h != 0)) > 1)).select("key")
    apart = stored(pairs.select("key").unionAll(several).distinct(), "apart")
    heads_apart = stored(heads.where("n > 1").join(apart, "key").select("same", F.col("key").alias("head"), F.col("id").alias("partner")), "heads-apart")
    whole = lines.join(heads_apart, "same").where("key != head").select("key", "partner", "lines").distinct()
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get(F.col("lines"), i) != 0)
    return stored(found.unionAll(whole.select("key", places.alias("removed"), F.array_compact(F.array("partner")).alias("partners"))), "removed")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, removed (places of deleted lines, from 0), partners (ids of the
    earlier documents that hold them), text (what is left).

    Earlier is the smaller id, null ids last, then the smaller hash of the text. Rows equal in id and text are one
    document and get the same result. Blank lines are neither matched nor deleted, but a text whose other lines
    are all deleted becomes empty. Null texts stay null with no line. Other columns are not read; an empty table
    gives an empty result.
    """

    @F.pandas_udf("string")
    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(texts, removed):
            if t is not None and gone is not None:
                lost = set(gone.tolist())
                kept = [x for i, x in enumerate(t.split("\n")) if i not in lost]
                t = "\n".join(kept) if any(x.strip() for x in kept) else ""
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = docs.select(_key(id_col, F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    n_lines = F.coalesce(F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines")
    out = rows.join(removals(docs, id_col, text_col), "key", "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return out.select("doc_id", n_lines, none("removed", "array<int>"), none("partners", "array<long>"), without("_t", "removed").alias("text"))
