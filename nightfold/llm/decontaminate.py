"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece then
occurs exactly, near its own place. All pieces of a block of items are found in one pass of an Aho-Corasick
automaton over the text; each hit names a stretch of the text, stretches of one item that meet are joined, and
Myers' bit-parallel distance decides whether the item ends there within k edits.

Items are handled in blocks of at most `block_chars` characters, so an automaton has a fixed size however large
the benchmark is; each block is one more pass over the documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.05
BLOCK_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate + 1e-9)


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """k + 1 stretches (start, end) that cover the item, of equal length up to one."""
    cuts = [length * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:]))


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of `pattern` in `text` with at most k edits, the first of equals."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    vp, vn, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hp = vn | ~(vp | d0) & full
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score <= k and (best is None or score < best[0]):
            best = score, at + 1
        hp = hp << 1 & full  # a match may begin anywhere, so no one is carried in
        hn = hn << 1 & full
        vp = hn | ~(d0 | hp) & full
        vn = hp & d0
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for row, (_, t, k) in enumerate(self.items):
            for a, b in pieces(len(t), k):
                owners[t[a:b]].append((row, b))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, own)
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, edits, end in the normalised text) for each item that occurs, its best occurrence."""
        if self.empty or not text:
            return []
        t = normalise(text)
        near: dict[int, list[list[int]]] = defaultdict(list)
        for last, owners in self.automaton.iter(t):
            for row, end in owners:
                _, item, k = self.items[row]
                start = last + 1 - end
                lo, hi = max(0, start - k), start + len(item) + k
                held = near[row]
                if held and held[-1][0] <= lo <= held[-1][1]:
                    held[-1][1] = max(hi, held[-1][1])
                elif not any(a <= lo and hi <= b for a, b in held[-2:]):
                    held.append([lo, hi])
        out = []
        for row, held in near.items():
            i, item, k = self.items[row]
            best = None
            held.sort()
            joined = [held[0]]
            for a, b in held[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            for a, b in joined:
                at = t.find(item, a, b)
                found = (0, at - a + len(item)) if at >= 0 else myers(item, t[a:b], k)
                if found and (best is None or found[0] < best[0]):
                    best = found[0], a + found[1]
            if best:
                out.append((i, *best))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size, read through one partition at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(f"{text_col} is not null").toLocalIterator():
        t = normalise(r[1])
        if not t:
            continue
        if held and size + len(t) > block_chars:
            yield held
            held, size = [], 0
        held.append((r[0], t))
        size += len(t)
    if held:
        yield held


FOUND = "array<struct<item_id:bigint,edits:int,end:bigint>>"


def _finder(spark, items: list[tuple[int, str]], rate: float):
    """A column function that lists the matches of a text; the items go out as one broadcast of bounded size."""
    sent = spark.sparkContext.broadcast(items)
    cache: dict[str, Matcher] = {}

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "m" not in cache:
            cache["m"] = Matcher(sent.value, rate)
        for texts in batches:
            yield texts.map(lambda t: [{"item_id": i, "edits": e, "end": x} for i, e, x in cache["m"].find(t)])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id, edits, end) per document and benchmark item that it holds with at most
    floor(rate * length) edits, both lower-cased with white space runs as one space; the best occurrence counts.

    Null and empty texts and items match nothing. Repeated documents and items each give their rows; null ids
    are kept. Other columns are not read. Without any item the result is empty.
    """
    out = None
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    for items in blocks(benchmark, block_chars=block_chars):
        hits = slim.select("doc_id", F.explode(_finder(docs.sparkSession, items, rate)("_t")).alias("h")).select("doc_id", "h.item_id", "h.edits", "h.end")
        out = hits if out is None else out.unionAll(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, end long")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` (all columns) that hold no benchmark item; null and empty texts stay."""
    for items in blocks(benchmark, block_chars=block_chars):
        docs = docs.where(F.size(_finder(docs.sparkSession, items, rate)(F.col(text_col))) == 0)
    return docs
