"""Text quality: random-indexing word vectors pooled per document, then a two-layer network.

Each text gives two sequences: its words (lower case, outer punctuation off) and their shapes ("Aa," or "AA!"). Either
item hashes into one of BUCKETS, and each bucket has a sparse random index vector. A bucket's vector is the sum of
the index vectors of its neighbours in all documents of the corpus; tasks add up matrices of fixed size, and only
those are combined. A document is the mean and the spread of its items' unit vectors, how alike adjacent items are,
and its length. The network is trained in numpy on a bounded sample of labelled rows; a temperature, fitted on
rows that the training did not see, calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightfold.llm.common import stored
from nightfold.llm.labelled import held_out, training_sample

BUCKETS = 1 << 14
DIM = 32
NONZERO = 4  # entries of an index vector
REACH = 2  # neighbours on either side
SAMPLE = 8192  # labelled rows at most
HIDDEN = 48
EPOCHS = 60
SEED = 11
THRESHOLD = 0.3
SLICE = 1 << 16  # items that are looked at together
CACHE = 400_000  # distinct words kept in a worker

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile("[A-Z]+"), re.compile(r"\d+")
_OUTER = ".,;:!?\"'()[]{}%$&*#|"


class _Items(dict):
    """word -> bucket of the word, and that of its shape in the upper bits."""

    def __missing__(self, word: str) -> int:
        core = word.strip(_OUTER).lower()
        shape = _LOWER.sub("a", _UPPER.sub("A", _DIGIT.sub("0", word)))[:8]
        both = zlib.crc32(b"w" + core.encode("utf-8", "replace")) % BUCKETS | zlib.crc32(b"s" + shape.encode("utf-8", "replace")) % BUCKETS << 16
        if len(word) <= 40:
            if len(self) >= CACHE:
                self.clear()
            self[word] = both
        return both


_items = _Items()  # of this worker


def sequences(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words and of their shapes."""
    words = (text or "").split()
    both = np.fromiter(map(_items.__getitem__, words), dtype=np.int64, count=len(words))
    return (both & 0xFFFF).astype(np.uint16), (both >> 16).astype(np.uint16)


def index_vectors() -> np.ndarray:
    """Sparse random +1 / -1 vectors, one a bucket; the last row, nothing, is zero."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + 1, DIM), dtype=np.int8)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] = rng.choice(np.array([-1, 1], dtype=np.int8), BUCKETS)
    return out


def add_contexts(total: np.ndarray, items: np.ndarray, vectors: np.ndarray) -> None:
    """Adds to each item's row the index vectors of its neighbours within REACH; BUCKETS separates sequences."""
    for lo in range(0, len(items), SLICE):
        a, b = max(0, lo - REACH), min(len(items), lo + SLICE + REACH)
        near = vectors[items[a:b]]
        own = items[lo : lo + SLICE]
        context = np.zeros((len(own), DIM), dtype=np.int8)
        for d in range(-REACH, REACH + 1):
            if d:
                s, e = max(lo + d, a), min(lo + len(own) + d, b)
                if e > s:
                    context[s - d - lo : e - d - lo] += near[s - a : e - a]
        order = np.argsort(own, kind="stable")
        new = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        total[own[order][new]] += np.add.reduceat(context[order], new, axis=0, dtype=np.int32)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all buckets (float32, BUCKETS x DIM) from every text of `docs`; unseen buckets are zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total = index_vectors(), np.zeros((BUCKETS + 1, DIM), dtype=np.int64)
        gap = np.full(REACH, BUCKETS, dtype=np.uint16)
        for b in batches:
            held, size = [], 0
            for t in b.column(0):
                words, shapes = sequences(t.as_py())
                held += [words, gap, shapes, gap]
                size += 2 * len(words)
                if size > SLICE:
                    add_contexts(total, np.concatenate(held), vectors)
                    held, size = [], 0
            if held:
                add_contexts(total, np.concatenate(held), vectors)
        used = np.flatnonzero(total[:BUCKETS].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, d]) for d in range(DIM))], names=["bucket", *(f"d{d}" for d in range(DIM))])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"d{d} long" for d in range(DIM)))
    sums = rows.groupBy("bucket").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)])
    out = np.zeros((BUCKETS, DIM))
    for r in sums.toLocalIterator():  # BUCKETS rows at most
        out[r[0]] = r[1:]
    seen = out.any(axis=1)
    out[seen] /= np.linalg.norm(out[seen], axis=1, keepdims=True)
    if seen.any():  # what all words have in common tells nothing
        out[seen] -= out[seen].mean(axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)
    return out.astype(np.float32)


WIDTH = 4 * DIM + 3


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """A text's WIDTH features; those of a text without words are zero."""
    out = np.zeros(WIDTH)
    both = sequences(text)
    n = len(both[0])
    if not n:
        return out
    for k, items in enumerate(both):
        total, square, alike = np.zeros(DIM), np.zeros(DIM), 0.0
        for lo in range(0, n, SLICE):
            v = vectors[items[lo : lo + SLICE + 1]]  # one more, for the last pair
            own = v[:SLICE]
            total += own.sum(axis=0, dtype=np.float64)
            square += np.einsum("ij,ij->j", own, own, dtype=np.float64)
            alike += float(np.einsum("ij,ij->", v[:-1], v[1:], dtype=np.float64))
        mean = total / n
        out[2 * k * DIM : (2 * k + 1) * DIM] = mean
        out[(2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(0.0, square / n - mean * mean))
        out[4 * DIM + k] = alike / max(1, n - 1)
    out[4 * DIM + 2] = np.log1p(n) / 10
    return out


class Network:
    """Two layers with a temperature; features are standardised with the training rows' mean and spread."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.fitted = len(y) >= 10 and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        check, train = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.sd = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
        z = (x - self.mean) / self.sd
        p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(EPOCHS):
            for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                h = np.maximum(0.0, z[rows] @ p[0] + p[1])
                d = (_logistic(h @ p[2] + p[3]) - y[rows]) / len(rows)
                back = np.outer(d, p[2]) * (h > 0)
                step += 1
                rate = 3e-3 * (1 - epoch / EPOCHS)
                for i, g in enumerate([z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, best = self.logits(x[check]), np.inf
        for t in np.exp(np.linspace(-1.5, 2.5, 161)):
            q = np.clip(_logistic(logits / t), 1e-12, 1 - 1e-12)
            loss = -np.mean(y[check] * np.log(q) + (1 - y[check]) * np.log(1 - q))
            if loss < best:
                best, self.temperature = loss, float(t)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (x - self.mean) / self.sd @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x) / self.temperature) if self.fitted else np.full(len(x), self.rate)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= threshold).

    The word vectors come from all texts; the network learns from at most `sample_rows` labelled rows, none held out.
    Whole texts are scored; null and empty texts are scored as a text without words. Repeated rows each give a row;
    null ids are kept. Other columns are not read. With fewer than ten labels, or one class only, every score is
    the smoothed rate of the label (a half without any).
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pooled(t, vectors.value))

    sample = stored(training_sample(docs, labels, "quality", sample_rows, id_col, text_col).select("doc_id", "y", features("text").alias("x")), "quality-sample")
    rows = sorted({(r.doc_id, r.y, tuple(r.x)) for r in sample.collect()})
    network = Network(np.array([r[2] for r in rows]).reshape(-1, WIDTH), np.array([float(r[1]) for r in rows]))
    sent = spark.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([pooled(t, vectors.value) for t in texts]).reshape(-1, WIDTH)
        return pd.Series(sent.value.probability(x))

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(text_col)).alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
