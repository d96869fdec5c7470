"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and completed by one more coordinate to unit length, so that the largest
inner product with a query is the smallest distance to it. A table has m projections on Gaussian directions, cut
into cells of width WIDTH; a bucket is one cell of each. Given a query's projection u, that of a vector with cosine
c to it is normal with mean c * u and variance 1 - c^2; so each cell, and each bucket, has an estimated chance to
hold a wanted neighbour. A query visits its own bucket and perturbed ones in falling order of that chance, until they sum up to
SUCCESS, in each of TABLES tables; what the tables find is merged and ranked by exact products in double precision.
c is the SAMPLE_QUANTILE quantile of the cosine of the k-th neighbour over SAMPLE queries, found exactly.

m grows with the logarithm of the number of vectors, so that buckets keep their mean size. Equal vectors are one
vector with its k + 1 smallest ids: no more of them can be among the k nearest of anything. A bucket with more than
SPLIT vectors (and more than a share of 1 / HOT of all: so at most TABLES * HOT buckets) is cut into pieces that lie in
different parts, each of which the bucket's queries visit. A query that found fewer
than k vectors (few or strange data) is repeated against all buckets.

Vectors are dealt by a hash into levels, the first of BASE vectors, all up to any next one GROWTH times as many.
Levels are searched one after another; from the second on a query takes along the score of the k + 1st vector that
it has found, and parts answer with vectors of at least that score only. As levels are random, these are some
(GROWTH - 1) * (k + 1) vectors a level, however many parts there are: answers grow with the queries and the number
of levels, not with queries times parts. What is found in the end is the same as without levels. The number of parts
follows from the vectors alone; a level of few parts is copied for groups of queries, so that each level has work for
all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.llm.common import stored

TABLES = 3
WIDTH = 1.5
SUCCESS = 0.62
BUCKET = 64  # vectors in a bucket, about
SAMPLE = 32
SAMPLE_QUANTILE = 0.25
PART_ROWS = 50_000  # hashed vectors that a task holds
LEAST_PARTS = 16
BASE = 16_384
GROWTH = 8
DEALT = 1 << 40
SPLIT = 256
HOT = 10_000
SEED = 20_240_607


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return np.interp(x, _GRID, _CDF)


_GRID = np.linspace(-9, 9, 9001)
_CDF = np.array([0.5 * (1 + erf(v / 2**0.5)) for v in _GRID])


class Hashing:
    """The tables' directions; everything derives from a seed, so each task makes its own."""

    def __init__(self, dim: int, m: int, scale: float, cosine: float):
        self.dim, self.m, self.scale = dim, m, scale
        self.cosine = min(max(cosine, 0.0), 0.999)
        rng = np.random.default_rng(SEED)
        self.a = rng.standard_normal((TABLES, dim + 1, m))
        self.b = rng.random((TABLES, m)) * WIDTH

    def _projected(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.stack([x @ a[:-1] + extra[:, None] * a[-1] for a in self.a])

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        """One long per row of cells."""
        k = np.full(len(cells), table + 1, dtype=np.uint64)
        for j in range(self.m):
            k = (k ^ cells[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        return k.view(np.int64)

    def buckets(self, x: np.ndarray) -> list[np.ndarray]:
        """For each table the bucket of each vector."""
        y = x / self.scale
        extra = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", y, y)))
        p = self._projected(y, extra)
        return [self.keys(np.floor((p[t] + self.b[t]) / WIDTH), t) for t in range(TABLES)]

    def probes(self, q: np.ndarray) -> list[np.ndarray]:
        """For each query the buckets to visit, of all tables, the likeliest of a table first."""
        unit = q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
        p = self._projected(unit, np.zeros(len(q)))
        spread = (1 - self.cosine**2) ** 0.5
        reach = ceil(3.2 * spread / WIDTH) + 1
        out = []
        for i in range(len(q)):
            found = []
            for t in range(TABLES):
                own = np.floor((p[t, i] + self.b[t]) / WIDTH)
                at = np.floor((self.cosine * p[t, i] + self.b[t]) / WIDTH)
                cells = at[:, None] + np.arange(-reach, reach + 1)
                low = (cells * WIDTH - self.b[t][:, None] - self.cosine * p[t, i][:, None]) / spread
                chance = _normal(low + WIDTH / spread) - _normal(low)
                kept, held = np.zeros((1, 0)), np.ones(1)
                for j in range(self.m):  # the likeliest combinations, one more projection at a time
                    both = (held[:, None] * chance[j]).ravel()
                    order = np.argsort(-both, kind="stable")
                    order = order[: int(np.searchsorted(np.cumsum(both[order]), (SUCCESS + 3) / 4 if j + 1 < self.m else SUCCESS)) + 1]
                    kept = np.c_[kept[order // cells.shape[1]], cells[j][order % cells.shape[1]]]
                    held = both[order]
                found.append(self.keys(np.r_[own[None, :], kept], t))
            out.append(np.unique(np.concatenate(found)))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


ROW = "part int, kind int, bucket long, buckets array<long>, cid long, low long, v array<double>, least double"


def _placed(part: np.ndarray, kind: int, bucket: np.ndarray, buckets: pa.Array, cid, low, v, least=None) -> pa.RecordBatch:
    n = len(part)
    least = pa.nulls(n, pa.float64()) if least is None else least
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(n, kind), pa.int32()), pa.array(bucket, pa.int64()), buckets, cid, low, v, least], names=["part", "kind", "bucket", "buckets", "cid", "low", "v", "least"])


class Places:
    """Which part holds a bucket, or a piece of one that is cut; each group of queries has all parts for itself."""

    def __init__(self, parts: int, groups: int, pieces: dict[int, int]):
        order = sorted(pieces)
        self.groups, self.parts, self.cut = groups, parts, np.array(order, dtype=np.int64)
        self.counts = np.array([pieces[b] for b in order], dtype=np.int64)

    def pieces(self, keys: np.ndarray) -> np.ndarray:
        """In how many pieces each bucket is."""
        out = np.ones(len(keys), dtype=np.int64)
        if len(self.cut):
            at = np.minimum(np.searchsorted(self.cut, keys), len(self.cut) - 1)
            out = np.where(self.cut[at] == keys, self.counts[at], out)
        return out

    def part(self, keys: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) + piece.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(7)) % np.uint64(self.parts)).astype(np.int64)


def _bucket_rows(hashing: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashing.buckets(_matrix(b.column(0)))))], names=["bucket"])

    return run


def _index_rows(hashing: Hashing, places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                spread = b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for key in hashing.buckets(_matrix(b.column(2))):
                    piece = spread % places.pieces(key).astype(np.uint64)
                    part = places.part(key, piece)
                    for group in range(places.groups):
                        yield _placed(part + group * places.parts, 0, key, pa.nulls(len(key), pa.list_(pa.int64())), *b.columns)

    return run


def _query_rows(hashing: Hashing, places: Places, everywhere: bool):
    """A query goes once to each part that has buckets of its, with those buckets (none: all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                group = some.column(0).to_numpy().view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)
                group = (group % np.uint64(places.groups)).astype(np.int64) * places.parts
                row, part, lists = [], [], []
                if everywhere:
                    row, part = np.repeat(np.arange(some.num_rows), places.parts), np.tile(np.arange(places.parts), some.num_rows)
                    lists = [np.zeros(0, np.int64)] * len(row)
                else:
                    for i, keys in enumerate(hashing.probes(_matrix(some.column(2)))):
                        n = places.pieces(keys)
                        keys = np.repeat(keys, n)
                        at = places.part(keys, np.arange(len(keys)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n))
                        order = np.lexsort((keys, at))
                        fresh = np.r_[True, (at[order][1:] != at[order][:-1]) | (keys[order][1:] != keys[order][:-1])]
                        order = order[fresh]  # pieces of a bucket may share a part
                        own, first = np.unique(at[order], return_index=True)
                        lists += np.split(keys[order], first[1:])
                        part += own.tolist()
                        row += [i] * len(own)
                take = pa.array(row, pa.int64())
                part = np.asarray(part, np.int64) + group[row]
                yield _placed(part, 1, np.zeros(len(row), np.int64), _lists(lists), *(some.column(i).take(take) for i in range(4)))

    return run


def _search(keep: int):
    """Rows of a part, vectors before queries, vectors by bucket: each query's `keep` best vectors of the part, of at
    least its least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, index = None, None

        def built():
            t = pa.Table.from_batches(held).combine_chunks().to_batches()
            if not held or not t:
                return None
            bucket = t[0].column(2).to_numpy()
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            return bucket[start], np.r_[start, len(bucket)], t[0].column(4).to_numpy(), t[0].column(5).to_numpy(), _matrix(t[0].column(6))

        def answer(b: pa.RecordBatch):
            keys, start, cid, low, x = index
            queries, least = _matrix(b.column(6)), b.column(7).to_numpy()
            out = [[], [], [], []]
            for i in range(b.num_rows):
                wanted = b.column(3)[i].values.to_numpy()
                if len(wanted):
                    at = np.searchsorted(keys, wanted)
                    at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)]
                    if not len(at):
                        continue
                    rows = np.concatenate([np.arange(start[a], start[a + 1]) for a in at])
                else:
                    rows = np.arange(len(cid))
                score = np.einsum("ij,j->i", x[rows], queries[i])
                at_least = least[i]
                if len(score) > keep * TABLES:  # ties included
                    at_least = max(at_least, -np.partition(-score, keep * TABLES - 1)[keep * TABLES - 1])
                fit = score >= at_least
                rows, score = rows[fit], score[fit]
                if not len(rows):
                    continue
                best = np.lexsort((low[rows], -score))
                _, new = np.unique(cid[rows[best[: keep * TABLES]]], return_index=True)  # a vector may come from each table
                best = best[np.sort(new)[:keep]]
                for o, v in zip(out, (np.full(len(best), b.column(4)[i].as_py()), cid[rows[best]], low[rows[best]], score[best])):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["qid", "cid", "low", "score"])

        for b in batches:
            while b.num_rows:
                parts, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
                same = (parts == parts[0]) & (kinds == kinds[0])
                n = b.num_rows if same.all() else int(np.argmin(same))
                head, b = b.slice(0, n), b.slice(n)
                if parts[0] != now:
                    now, index, held = parts[0], None, []
                if kinds[0] == 0:
                    held.append(head)
                else:
                    if held:
                        index, held = built(), []
                    if index is not None:
                        for lo in range(0, n, 512):
                            yield from answer(head.slice(lo, 512))

    return run


def _kth_cosine(vectors: DataFrame, scale: float, k: int) -> float:
    """The k-th neighbour's cosine in the completed space, by an exact search for SAMPLE queries of lowest hash."""
    qs = np.array([r.v for r in vectors.orderBy(F.xxhash64("low", F.lit("q")), "cid").limit(SAMPLE).select("v").collect()])
    norms = np.sqrt((qs * qs).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(qs), 0), -np.inf)
        for b in batches:
            if b.num_rows:
                best = -np.sort(-np.c_[best, qs @ _matrix(b.column(0)).T], axis=1)[:, : k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(qs)), best.shape[1])), pa.array(best.ravel())], names=["q", "s"])

    rows = vectors.select("v").mapInArrow(run, "q long, s double")
    last = rows.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") <= k + 1).groupBy("q").agg(F.min("s").alias("s")).collect()
    return float(np.quantile([r.s / norms[r.q] / scale for r in last], SAMPLE_QUANTILE)) if last else 0.0


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every`, the k other rows found of largest inner product.

    Rank counts from 1, ties go to the smaller id; score is the product of the original vectors in double precision.
    Null ids and vectors that are null, empty, zero, hold null or non-finite numbers, or have another length than most
    (the shorter of equally common lengths) take no part. Rows that agree in id and vector count once. Fewer than k
    others: all of them. Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", finite)).where(F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    rows = rows.where(F.size("v") == lengths.d).distinct().withColumn("h", F.xxhash64("v"))
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = ranked.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most k + 1
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), F.element_at("ids", 1).alias("low"), "ids", "h", "v"), "classes")
    asked = stored(rows.where(F.col("id") % every == 0).join(classes.select("cid", "h", "v"), ["h", "v"]).select("id", "cid"), "asked")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top"), F.sum(F.size("ids")).alias("ids")).first()
    scale = float(facts.top) ** 0.5 * (1 + 1e-12)
    slim = classes.select("cid", "low", "v")
    m = max(3, round(log(max(2.0, facts.n / BUCKET)) / log(3.2)))
    hashing = Hashing(lengths.d, m, scale, _kth_cosine(slim, scale, min(k, facts.n - 1)))
    most = max(SPLIT, facts.n // HOT)
    full = slim.select("v").mapInArrow(_bucket_rows(hashing), "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most)
    full = {r.bucket: r.n for r in full.collect()}  # at most TABLES * HOT
    wanted = stored(slim.join(asked.select("cid").distinct(), "cid", "left_semi"), "queries")
    tasks = max(LEAST_PARTS, ceil(TABLES * facts.n / PART_ROWS))
    levels = []  # (first and last dealt number, places)
    while not levels or levels[-1][1] < DEALT:
        share = min(1.0, BASE * GROWTH ** len(levels) / facts.n)
        lo, hi = levels[-1][1] if levels else 0, DEALT if share == 1 else int(share * DEALT)
        share = (hi - lo) / DEALT
        parts = max(LEAST_PARTS, ceil(TABLES * facts.n * share / PART_ROWS))
        pieces = {bucket: ceil(n * share / most) for bucket, n in full.items()}
        levels.append((lo, hi, Places(parts, max(1, tasks // parts), {bucket: n for bucket, n in pieces.items() if n > 1})))
    dealt = F.pmod(F.xxhash64("cid", F.lit("level")), F.lit(DEALT))

    def best_of(rows: DataFrame) -> DataFrame:
        """The k + 1 best vectors of each query, each once."""
        best = rows.groupBy("qid", "cid").agg(F.max("score").alias("score"), F.min("low").alias("low"))
        return best.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "low"))).where(F.col("r") <= k + 1)

    def found(queries: DataFrame, everywhere: bool) -> DataFrame:
        """(qid, vec_id, score): the k + 1 best ids for each queried vector."""
        best, none = None, F.lit(float("-inf"))
        for lo, hi, places in levels:
            bound = queries.withColumn("least", none)
            if best is not None:
                best = stored(best, "best")
                kth = best.where(F.col("r") == k + 1).select(F.col("qid").alias("cid"), F.col("score").alias("least"))
                bound = queries.join(kth, "cid", "left").withColumn("least", F.coalesce("least", none))
            index = slim.where((dealt >= lo) & (dealt < hi)).mapInArrow(_index_rows(hashing, places), ROW)
            both = index.unionAll(bound.select("cid", "low", "v", "least").mapInArrow(_query_rows(hashing, places, everywhere), ROW))
            both = both.repartitionById(places.parts * places.groups, F.col("part")).sortWithinPartitions("part", "kind", "bucket")
            rows = both.mapInArrow(_search(k + 1), "qid long, cid long, low long, score double")
            best = best_of(rows if best is None else rows.unionByName(best.drop("r")))
        ids = best.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id")).distinct()
        return ids.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")

    hits = stored(found(wanted, False), "hits")
    few = stored(wanted.join(hits.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > k).select(F.col("qid").alias("cid")), "cid", "left_anti"), "few")
    if not few.isEmpty():
        again = found(few, True)
        hits = stored(hits.join(few.select(F.col("cid").alias("qid")), "qid", "left_anti").unionByName(again), "hits")
    lists = stored(hits.groupBy("qid").agg(F.collect_list(F.struct(F.negate("score").alias("s"), "vec_id")).alias("all")).select(F.col("qid").alias("cid"), F.array_sort("all").alias("all")), "lists")
    out = asked.join(lists, "cid").select(F.col("id").alias("query_id"), F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.negate("x.s").alias("score"))
