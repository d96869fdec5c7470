"""SimHash near-duplicates by anchor-point covering.

A fingerprint has two halves of 32 bits. Of two fingerprints that differ in at most `bits` = 4 bits, one half
differs in at most 2, so in that half some point lies within 1 of both. The anchors of a half are the words of
a covering code of radius 2 (two Hamming(15,11) blocks of radius 1, and two free bits): that midpoint has an
anchor within 2, which then lies within 3 of both ends. Hence each fingerprint is replicated to every anchor
within 3 (covering radius plus half of the half's threshold: about twenty per half), and comparing inside
anchors finds every pair: the search is exact.

Equal fingerprints are one node, however many documents share them. A cell with more than `cell_rows` rows is
dealt into blocks, and each pair of blocks is compared by itself, so no task holds a hot cell. Cells send out
spanning links (at most one per row), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightfold.llm.common import shuffle_partitions, stored
from nightfold.llm.graph import components

BITS = 4  # the covering below is proved for this threshold
CELL_ROWS = 2048


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, as a signed long; no words (or null) gives 0."""
    if not text:
        return 0
    w = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text_col: str, out: str, words: int = 4) -> DataFrame:
    """`df` with the fingerprint of `text_col` as a long column `out`."""

    @F.pandas_udf("long")
    def run(texts):
        return texts.map(lambda t: fingerprint(t, words))

    return df.withColumn(out, run(F.col(text_col)))


def _patterns() -> list[np.ndarray]:
    """For each pair of block syndromes (16 x 16), the error words of weight at most 3 that lead to an anchor."""
    by: list[dict[int, list[int]]] = [{} for _ in range(16)]  # syndrome -> weight -> 15-bit error words
    for weight in range(4):
        for places in combinations(range(1, 16), weight):
            s, e = 0, 0
            for p in places:
                s, e = s ^ p, e | 1 << (p - 1)
            by[s].setdefault(weight, []).append(e)
    free = {0: [0], 1: [1 << 30, 1 << 31], 2: [3 << 30]}
    out = []
    for s1 in range(16):
        for s2 in range(16):
            out.append(np.array([a | b << 15 | f for wa, xs in by[s1].items() for wb, ys in by[s2].items() for wf, fs in free.items() if wa + wb + wf <= 3 for a in xs for b in ys for f in fs], dtype=np.uint64))
    return out


def _syndromes() -> np.ndarray:
    x = np.arange(1 << 15)
    s = np.zeros(1 << 15, dtype=np.uint8)
    for p in range(1, 16):
        s ^= np.where(x >> (p - 1) & 1, p, 0).astype(np.uint8)
    return s


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every anchor within 3 of each half of each fingerprint; cell = half, then the anchor."""
    table, patterns = _syndromes(), _patterns()
    u = fps.astype(np.int64).view(np.uint64)
    rows, cells = [], []
    for half in (0, 1):
        x = u >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        kind = table[(x & np.uint64(0x7FFF)).astype(np.int64)].astype(np.int64) * 16 + table[(x >> np.uint64(15) & np.uint64(0x7FFF)).astype(np.int64)]
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(257))
        for k in range(256):
            own = order[ends[k] : ends[k + 1]]
            if len(own):
                cells.append((x[own, None] ^ patterns[k][None, :] | np.uint64(half << 32)).ravel())
                rows.append(np.repeat(own, len(patterns[k])))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(fps), 4096):
            part = fps[lo : lo + 4096]
            rows, cells = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part[rows])], names=["cell", "fp"])


def _relabel(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the ends of each link (u, v); a label is the smallest row of its group."""
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def local_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key; for each row of a key that is linked (through others of its key), one link to the
    smallest row of its group: the same components as all pairs, with at most one link a row."""
    n = len(keys)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    size = np.repeat(np.diff(np.r_[starts, n]), np.diff(np.r_[starts, n]))
    left = np.repeat(starts, np.diff(np.r_[starts, n])) + size - 1 - np.arange(n)  # rows of the key after this one
    us, vs, held = [], [], 0
    live, s = np.flatnonzero(left >= 1), 1
    u = fps.astype(np.int64).view(np.uint64)
    while len(live):
        near = (np.bitwise_count(u[live] ^ u[live + s]) <= bits) & (label[live] != label[live + s])  # what is joined already adds nothing
        if near.any():
            us.append(live[near])
            vs.append(live[near] + s)
            held += len(us[-1])
        if held > 1 << 20:
            label = _relabel(label, np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
        s += 1
        live = live[left[live] >= s]
    if us:
        label = _relabel(label, np.concatenate(us), np.concatenate(vs))
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def out(parts, last: bool):
            cell, blk, fp = (np.concatenate([p[i] for p in parts]) for i in range(3))
            key = np.cumsum(np.r_[True, (cell[1:] != cell[:-1]) | (blk[1:] != blk[:-1])])
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            a, b = local_links(key[:cut], fp[:cut], bits)
            return (cell[cut:], blk[cut:], fp[cut:]), pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            rows += b.num_rows
            if rows >= 1 << 17:
                rest, links = out(held, False)
                held, rows = [rest], len(rest[0])
                yield links
        if rows:
            yield out(held, True)[1]

    return run


def link_components(fps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(fp, root) for each fingerprint of `fps` (distinct longs, column fp) that is linked to another one."""
    spark = fps.sparkSession
    cells = stored(fps.mapInArrow(_spread, "cell long, fp long"), "cells")
    hot = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows), "hot")
    plain = cells.join(hot.select("cell"), "cell", "left_anti").withColumn("blk", F.lit(0))
    k = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    split = cells.join(hot, "cell").withColumn("k", k).withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    split = split.select("cell", "fp", (F.greatest("i", "j") * 65536 + F.least("i", "j") + 1).alias("blk"))
    rows = plain.unionByName(split).select("cell", "blk", "fp")
    rows = rows.repartition(shuffle_partitions(spark), "cell", "blk").sortWithinPartitions("cell", "blk")
    links = rows.mapInArrow(_compare(BITS), "u long, v long")
    return components(links).withColumnsRenamed({"node": "fp"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of at most BITS differing bits, its own included.
    Null and empty texts have fingerprint zero and link like any other; null ids take part but name no
    component unless all ids of it are null (component_id is then null). Repeated rows each give a row; other
    columns of `docs` are not read. An empty table gives an empty result.
    """
    rows = with_fingerprint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")), "_t", "fp", words).select("doc_id", "fp")
    rows = stored(rows, "fingerprints")
    groups = groups_of(rows, "doc_id")
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def groups_of(rows: DataFrame, id_col: str) -> DataFrame:
    """(fp, root, component_id) for every distinct `fp` of rows (fp, id); root names the component by a fingerprint."""
    nodes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("low")), "nodes")
    found = stored(link_components(nodes.select("fp")), "roots")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    return stored(rooted.select("fp", "root").join(lows, "root").select("fp", "root", "component_id"), "groups")
