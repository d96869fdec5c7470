"""Toxicity: the block-max index against all similarities, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from nightfold.llm import toxicity


def test_index_equals_all_similarities():
    rng = np.random.default_rng(0)
    vecs = []
    for _ in range(500):
        ids = np.sort(rng.choice(40, size=rng.integers(1, 6), replace=False))
        w = rng.integers(1, 4, size=len(ids)).astype(float)
        vecs.append((ids, w / np.linalg.norm(w)))
    dense = np.zeros((500, 40))
    for r, (i, w) in enumerate(vecs):
        dense[r, i] = w
    index = toxicity.BlockMaxIndex(vecs, 40)
    for r in range(0, 500, 7):
        for skip in (-1, r):
            sims = np.round(dense @ dense[r], 12)
            if skip >= 0:
                sims[skip] = 0
            want = [x for x in np.lexsort((np.arange(500), -sims)) if sims[x] > 0][:16]
            rows, got = index.nearest(*vecs[r], 16, skip)
            assert rows.tolist() == want and np.allclose(got, sims[want])


def test_empty_index():
    rows, sims = toxicity.BlockMaxIndex([], 5).nearest(np.array([1]), np.array([1.0]), 4)
    assert len(rows) == len(sims) == 0


def test_features_of_a_text():
    v = toxicity.Vocabulary(["idiot", "idi*", "lowei*"])
    assert v.featurise("IDIOT, loweischaft loweibe idiot!") == ([0, 1, 2], [2, 2, 2])
    assert v.featurise(None) == v.featurise("") == ([], [])


def corpus(n=900):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(["Vile", "nasty,", "rotten"])
        docs.append((i, " ".join(t), "s"))
        labels.append((i, int(bad), 1))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "Vile words", None), (5000, None, None), (5001, "", None), (5002, "plain " * 50_000 + "nasty", None), (3, docs[3][1], "s")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5001, None, 1), (4, 0, None)], "doc_id long, toxic int, quality int")
    out = toxicity.score(d, lab)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "evidence", "similarity"]
    got = out.collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: y for i, y, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.5 and by[5000].evidence == []
    assert by[None].predicted == 1 and by[5002].predicted == 1 and all(truth[e] == 1 for e in by[None].evidence)
    left = toxicity.without_toxic(d, lab)
    assert left.columns == d.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_no_labels_one_class_and_no_rows(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity.score(d, lab.limit(0)).collect()} == {0.5}
    assert all(r.score < 0.1 for r in toxicity.score(d, lab.where("toxic = 0")).collect())
    assert toxicity.score(d.limit(0), lab).count() == 0
