"""Multiprobe search: recall against brute force, ties, copies and odd vectors."""

from __future__ import annotations

import numpy as np

from nightfold.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k, every):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in range(len(rows)):
        if ids[q] % every == 0:
            s = np.einsum("ij,j->i", x, x[q])
            order = [r for r in np.lexsort((ids, -s)) if r != q][:k]
            out[int(ids[q])] = [(int(ids[r]), float(s[r])) for r in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_hard_and_uneven_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 48)).astype(np.float32)
    for scale in (np.ones(6000), rng.lognormal(0, 0.3, 6000)):
        y = (x / np.linalg.norm(x, axis=1, keepdims=True) * scale[:, None]).astype(np.float32)
        rows = [(i, v.tolist()) for i, v in enumerate(y)]
        got = answers(ann.search(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)))
        want = brute(rows, 20, 20)
        assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
        for q, v in got.items():
            assert v == sorted(v, key=lambda t: (-t[1], t[0]))
            assert np.allclose([s for _, s in v], [y[i].astype(float) @ y[q].astype(float) for i, _ in v], rtol=1e-12)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    hot = [1.0, 0.0, 0.0, 0.5]
    rows = [(i, hot) for i in range(0, 300)] + [(1000 + i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]
    rows = [(i, v) for i, v in rows if any(v)]
    nan, inf = float("nan"), float("inf")
    odd = [(20, None), (40, [0.0] * 4), (60, [nan, 1.0, 1.0, 1.0]), (80, [inf, 1.0, 1.0, 1.0]), (100, []), (120, [1.0, 2.0]), (None, hot), (140, [None, 1.0, 1.0, 1.0])]
    keep = [r for r in rows if r[0] not in {i for i, _ in odd}]
    df = spark.createDataFrame([(i, v, 1) for i, v in keep + keep[:50] + odd], SCHEMA)
    got, want = answers(ann.search(df)), brute(keep, 20, 20)
    assert got.keys() == want.keys()
    for q in range(0, 300, 20):
        if q in want:
            assert got[q][0][1] >= want[q][0][1] - 1e-9
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9


def test_a_full_bucket_is_cut_and_nothing_lost(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ann, "SPLIT", 40)
    near = np.array([1.0, 2.0, -1.0, 0.5]) + rng.normal(0, 1e-3, (700, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[near, rng.standard_normal((300, 4))].astype(np.float32).astype(float))]
    got, want = answers(ann.search(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA))), brute(rows, 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_answers_of_the_search_do_not_grow_with_parts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 48))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA).repartition(4).cache()
    search = ann._search
    before, shuffle = answers(ann.search(df)), spark.conf.get("spark.sql.shuffle.partitions")

    made = []

    def counted(keep):
        found, total = search(keep), spark.sparkContext.accumulator(0)
        made.append(total)

        def run(batches):
            for b in found(batches):
                total.add(b.num_rows)
                yield b

        return run

    for name, value in {"_search": counted, "BASE": 500, "GROWTH": 2, "PART_ROWS": 100}.items():
        monkeypatch.setattr(ann, name, value)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert answers(ann.search(df)) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    first, *later = [m.value for m in made]
    assert len(later) == 2 and first <= 100 * 16 * 21  # parts follow from the vectors, not from the setting
    assert max(later) <= 3 * 100 * 21 < first  # as many more vectors in as many parts or more, but with a bound


def test_few_vectors_and_none(spark):
    rows = [(i, [1.0 + i, 2.0, -1.0 * i]) for i in range(0, 120, 10)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    assert answers(ann.search(df)) == brute(rows, 20, 20)
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(spark.createDataFrame([(20, [1.0, 2.0], 1)], SCHEMA)).count() == 0
