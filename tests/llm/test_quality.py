"""Quality: context sums against a loop, pooling, held-out accuracy, odd rows."""

from __future__ import annotations

import random

import numpy as np

from nightfold.llm import quality


def test_context_sums_equal_a_loop(monkeypatch):
    rng = np.random.default_rng(0)
    vectors = quality.index_vectors()
    assert not vectors[-1].any() and (np.abs(vectors).sum(axis=1) <= quality.NONZERO).all()
    items = rng.integers(0, 30, 500).astype(np.uint16)
    items[[50, 51, 200, 201]] = quality.BUCKETS
    want = np.zeros((quality.BUCKETS + 1, quality.DIM), dtype=np.int64)
    for i, w in enumerate(items):
        for j in range(max(0, i - 2), min(len(items), i + 3)):
            if j != i:
                want[w] += vectors[items[j]]
    for size in (1 << 16, 7):
        monkeypatch.setattr(quality, "SLICE", size)
        got = np.zeros_like(want)
        quality.add_contexts(got, items, vectors)
        assert (got == want).all()


def test_pooling_does_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((quality.BUCKETS, quality.DIM)).astype(np.float32)
    text = " ".join(rng.choice(["Ab", "cd,", "EF!!", "12"], 300))
    whole = quality.pooled(text, vectors)
    monkeypatch.setattr(quality, "SLICE", 11)
    assert np.allclose(quality.pooled(text, vectors), whole, atol=1e-6)
    v = vectors[quality.sequences(text)[0]]
    assert np.allclose(whole[: quality.DIM], v.mean(axis=0), atol=1e-5) and np.allclose(whole[quality.DIM : 2 * quality.DIM], v.std(axis=0), atol=1e-4)
    assert not quality.pooled(None, vectors).any() and not quality.pooled(" \n", vectors).any()


def corpus(n=700):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        if not good:
            t = rng.choice([[w + "%%%" for w in t], [t[0]] * 60, [w.upper() + "!!" for w in t]])
        docs.append((i, " ".join(t), "s"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "null id", None), (5000, None, None), (5001, "", None), (5002, "plain " * 100_000, None), docs[3]]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5001, None, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    out = quality.score(d, lab)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: y for i, y, _ in labels}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[5000] == by[5001]
    again = {r.doc_id: r.score for r in quality.score(d.repartition(5), lab).collect()}
    assert all(abs(again[k] - v) < 1e-6 for k, v in by.items())


def test_no_labels_one_class_and_no_rows(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(d, lab.limit(0)).collect()} == {0.5}
    assert all(r.score > 0.9 for r in quality.score(d, lab.where("quality = 1")).collect())
    assert quality.score(d.limit(0), lab).count() == 0
