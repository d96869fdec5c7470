"""Toxicity by nearest labelled examples.

Features are lower-cased words and word beginnings of three to five letters that set toxic and other examples
apart in both halves of a bounded sample of labelled rows: they speak for toxicity, being in few other examples. Their document frequencies come from the whole corpus. A text's
neighbours are the K examples of largest TF-IDF cosine, found exactly in an inverted index whose postings are cut
into blocks of examples with the largest weight of each feature in a block: blocks are opened in order of their
upper bound and no more of them once the bound falls below the K-th similarity. Neighbours vote with weights that
fall with their distance; the vote is calibrated on the examples themselves, each left out in its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightfold.llm.common import stored
from nightfold.llm.labelled import held_out, training_sample

SAMPLE = 8192  # labelled rows at most
FEATURES = 1024  # features at most
MIN_CHI2 = 8.0  # in either half of the sample
PREFIXES = (3, 4, 5)
K = 16
BLOCK = 64
EVIDENCE = 3
THRESHOLD = 0.5

_WORD = re.compile(r"\w+")


def terms(text: str | None) -> Counter:
    """Words and word beginnings ('begin*') of a text with their counts."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for p in PREFIXES:
            if len(w) > p:
                out[w[:p] + "*"] += n
    return out


class Vocabulary:
    """The chosen features by number."""

    def __init__(self, chosen: list[str]):
        self.words = {t: i for i, t in enumerate(chosen) if t[-1] != "*"}
        self.begins = {t[:-1]: i for i, t in enumerate(chosen) if t[-1] == "*"}
        self.size = len(chosen)

    def featurise(self, text: str | None) -> tuple[list[int], list[int]]:
        """(feature ids rising, counts) of a text."""
        found: dict[int, int] = {}
        words, begins = self.words, self.begins
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            if w in words:
                found[words[w]] = found.get(words[w], 0) + n
            for p in PREFIXES:
                if len(w) > p and w[:p] in begins:
                    f = begins[w[:p]]
                    found[f] = found.get(f, 0) + n
        ids = sorted(found)
        return ids, [found[i] for i in ids]


def choose_features(sample: DataFrame, features: int = FEATURES) -> list[str]:
    """The terms whose presence goes with the label, by chi-squared over (doc_id, y, text); at most `features`."""

    @F.pandas_udf("array<string>")
    def present(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(terms(t)))

    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int").alias("half")  # copies of a text are in one half
    sides = {r.half: r for r in sample.groupBy(half).agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}
    if len(sides) < 2 or not all(0 < r.pos < r.n for r in sides.values()):
        return []
    seen = sample.select("y", half, F.explode(present("text")).alias("term"))
    aggs = []
    for h in (0, 1):
        aggs += [F.count_if(F.col("half") == h).alias(f"c{h}"), F.sum(F.when(F.col("half") == h, F.col("y")).otherwise(0)).alias(f"a{h}")]
    ranked = seen.groupBy("term").agg(*aggs)
    gap = lambda h: F.col(f"a{h}") * sides[h].n - F.col(f"c{h}") * sides[h].pos
    strong = lambda h: 2 * F.col(f"a{h}") / F.col(f"c{h}") >= 1 + F.lit(sides[h].pos / sides[h].n)  # noqa: E731  at least halfway from the usual rate to 1
    for h in (0, 1):
        n, pos, c = sides[h].n, sides[h].pos, F.col(f"c{h}")
        ranked = ranked.where((c >= 2) & (c < n)).withColumn(f"x{h}", gap(h).cast("double") * gap(h) * n / (c * (n - c) * F.lit(float(pos * (n - pos)))))
    ranked = ranked.where((F.col("x0") >= MIN_CHI2) & (F.col("x1") >= MIN_CHI2) & strong(0) & strong(1)).withColumn("chi2", F.col("x0") + F.col("x1"))
    return [r.term for r in ranked.orderBy(F.desc("chi2"), "term").limit(features).collect()]


def _vector(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1.0 + np.log(counts)) * idf[ids]
    return w / np.sqrt(w @ w)


class BlockMaxIndex:
    """Postings of unit vectors in blocks of BLOCK examples, with the largest weight of a feature in a block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], features: int):
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        row = np.repeat(np.arange(self.size), [len(i) for i, _ in vectors]) if vectors else np.zeros(0, np.int64)
        f = np.concatenate([i for i, _ in vectors]) if vectors else np.zeros(0, np.int64)
        w = np.concatenate([x for _, x in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((row, f))
        self.row, self.weight = row[order], w[order]
        key = f[order] * max(1, self.blocks) + self.row // BLOCK  # (feature, block), rising
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.start = np.r_[start, len(key)]
        self.block = key[start] % max(1, self.blocks)
        self.top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.of = np.searchsorted(key[start] // max(1, self.blocks), np.arange(features + 1))  # a feature's first list

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the k most similar examples with a similarity over 0, ties to the smaller row."""
        bound = np.zeros(self.blocks)
        lists: dict[int, list[tuple[int, float]]] = {}
        for f, q in zip(ids, weights):
            for p in range(self.of[f], self.of[f + 1]):
                b = int(self.block[p])
                bound[b] += q * self.top[p]
                lists.setdefault(b, []).append((p, q))
        rows, sims = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(rows) == k and bound[b] < sims[-1] - 1e-12:
                break
            score = np.zeros(BLOCK)
            for p, q in lists[int(b)]:
                s = slice(self.start[p], self.start[p + 1])
                score[self.row[s] - b * BLOCK] += q * self.weight[s]
            if skip // BLOCK == b:
                score[skip - b * BLOCK] = 0.0
            own = np.flatnonzero(score > 0)
            rows, sims = np.r_[rows, own + b * BLOCK], np.r_[sims, score[own]]
            best = np.lexsort((rows, -np.round(sims, 12)))[:k]
            rows, sims = rows[best], sims[best]
        return rows, sims


class Model:
    """A fitted scorer; its size is bounded by SAMPLE and FEATURES."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int]]]):
        """examples: (doc_id, y, feature ids, counts) of every sampled row."""
        self.vocabulary = vocabulary
        self.idf = idf
        blank = [y for _, y, ids, _ in examples if not ids]
        rate = (sum(y for _, y, _, _ in examples) + 0.5) / (len(examples) + 1.0)
        self.blank = (sum(blank) + rate) / (len(blank) + 1.0)  # a text without any feature, and an empty one
        kept = [(d, y, *self._sparse(i, c)) for d, y, i, c in examples if i]
        kept.sort(key=lambda e: (int(e[2][np.argmax(e[3])]), e[0]))  # alike examples share blocks; labels have no part in the order
        self.ids = np.array([e[0] for e in kept], dtype=np.int64)
        self.y = np.array([e[1] for e in kept], dtype=np.float64)
        self.index = BlockMaxIndex([(i, w) for _, _, i, w in kept], vocabulary.size)
        votes = [self.vote(*self.index.nearest(i, w, K, skip=r)) for r, (_, _, i, w) in enumerate(kept)]
        self.a, self.b = _platt(np.array(votes), self.y) if len(kept) else (0.0, 0.0)
        self.seen: dict[tuple, tuple] = {}

    def _sparse(self, ids, counts) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(ids, dtype=np.int64)
        return ids, _vector(ids, np.asarray(counts, dtype=np.float64), self.idf)

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Logit of the neighbours' weighted share of toxic examples, one doubtful vote added to either side."""
        w = 1.0 / (1.05 - np.minimum(sims, 1.0))
        yes = float(w @ self.y[rows]) if len(rows) else 0.0
        return float(np.log((yes + 0.5) / (float(w.sum()) - yes + 0.5)))

    def score(self, ids: list[int], counts: list[int]) -> tuple[float, list[int], list[float]]:
        """(score, evidence ids, their similarities)."""
        if not len(ids) or not self.index.size:
            return self.blank, [], []
        key = (tuple(ids), tuple(counts))
        if key not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            rows, sims = self.index.nearest(*self._sparse(ids, counts), K)
            p = 1.0 / (1.0 + np.exp(-(self.a * self.vote(rows, sims) + self.b)))
            self.seen[key] = float(p), self.ids[rows[:EVIDENCE]].tolist(), [round(float(s), 9) for s in sims[:EVIDENCE]]
        return self.seen[key]


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with softened targets and a slight penalty, by Newton's method."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([1.0, 0.0])
    z = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        g = z.T @ (p - t) + 1e-3 * (theta - [1.0, 0.0])
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def _features(df: DataFrame, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """`df` with struct column _f (ids, counts) of its text's features."""

    @F.pandas_udf("struct<ids:array<int>,counts:array<int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vocabulary.featurise(t) for t in texts], columns=["ids", "counts"])

    return df.withColumn("_f", run(F.col(text_col)))


def fit(featured: DataFrame, sample: DataFrame, vocabulary: Vocabulary) -> Model:
    """featured: (_f) of the whole corpus, for document frequencies; sample: (doc_id, y, _f)."""
    df = np.zeros(vocabulary.size)
    for r in featured.select(F.explode("_f.ids").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect():
        df[r.f] = r.n
    idf = np.log((1.0 + featured.count()) / (1.0 + df)) + 1.0
    rows = sample.select("doc_id", "y", "_f.ids", "_f.counts").collect()
    examples = sorted({(r.doc_id, r.y, tuple(r.ids), tuple(r.counts)) for r in rows})
    return Model(vocabulary, idf, [(d, y, list(i), list(c)) for d, y, i, c in examples])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (ids of the nearest examples), similarity.

    Learns from at most `sample_rows` labelled rows, none held out. Every whole text is scored; null and empty
    texts, and texts without any feature, get the rate of toxic examples without features. Repeated rows each
    give a row; null ids are kept. Other columns are not read. Without labels, or with one class only, every
    score is the smoothed rate of that label (a half without any).
    """
    spark = docs.sparkSession
    sample = stored(training_sample(docs, labels, "toxic", sample_rows, id_col, text_col), "toxic-sample")
    vocabulary = Vocabulary(choose_features(sample))
    featured = stored(_features(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")), "_t", vocabulary).select("doc_id", "_f"), "toxic-features")
    sent = spark.sparkContext.broadcast(fit(featured, _features(sample, "text", vocabulary), vocabulary))

    @F.pandas_udf("struct<score:double,evidence:array<long>,similarity:array<double>>")
    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([sent.value.score(i, c) for i, c in zip(map(list, f["ids"]), map(list, f["counts"]))], columns=["score", "evidence", "similarity"])

    out = featured.select("doc_id", run("_f").alias("s"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "s.score", F.when(F.col("s.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "s.evidence", "s.similarity")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` (all columns) whose score is below `threshold`."""
    spark = docs.sparkSession
    sample = stored(training_sample(docs, labels, "toxic", sample_rows, id_col, text_col), "toxic-sample")
    vocabulary = Vocabulary(choose_features(sample))
    featured = stored(_features(docs.select(F.col(text_col).alias("_t")), "_t", vocabulary).select("_f"), "toxic-features")
    sent = spark.sparkContext.broadcast(fit(featured, _features(sample, "text", vocabulary), vocabulary))

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for texts in batches:
            yield texts.map(lambda t: m.score(*m.vocabulary.featurise(t))[0] < threshold)

    return docs.where(keep(F.col(text_col)))
