"""The pipeline, stage by stage, against plain versions on a small corpus with planted cases."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from nightfold.llm import mixing

from test_sharding import slow_jump

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(35) for _ in range(8)]
    docs, labels = [], []
    for i in range(500):
        t, toxic = say(rng.randint(15, 120)), i % 5 == 0
        if toxic:
            w = t.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty", "rotten"])
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, 1, int(toxic)))
    leaks = [(600 + i, f"{say(20)} {x.upper()} {say(9)}") for i, x in enumerate(items)]
    leaks += [(700 + i, f"{say(20)} {x[:60]}q{x[61:]} {say(9)}") for i, x in enumerate(items)]
    near = docs[7][1].split()
    copies = [(800 + k, docs[1][1]) for k in range(30)] + [(900 + k, docs[2][1] + " end") for k in range(3)]
    copies += [(940 + k, " ".join(near[: 9 * k] + ["changed"] + near[9 * k + 1 :])) for k in range(4)]
    odd = [(None, say(40)), (1000, None), (1001, ""), (1002, say(9000)), (1003, docs[3][1]), docs[3]]
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), None) for i, t in docs + leaks + copies + odd]
    return rows, labels, items


def shingles(text):
    """The set of five-word shingles (fewer words: the whole sequence), letters A to Z lowered."""
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_groups(texts):
    """{set of shingles: number of its group}: components of all pairs of sets with a Jaccard similarity of 0.8 or more."""
    sets = sorted({shingles(t) for t in texts}, key=repr)
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return dict(zip(sets, group))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels, items = corpus()
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_every_stage(spark, sf_dir):
    rows, labels, items = corpus()
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        results[name] = docs.collect()
        docs = spark.createDataFrame(results[name], docs.schema)
        assert docs.columns[:5] == COLUMNS and (name == "sharding" or len(docs.columns) == 5)

    key = lambda r: (r[0], r[1])
    bad = {"vile", "nasty", "rotten"}
    clean = [r for r in rows if not bad & set((r[1] or "").split())]
    assert Counter(map(key, results["toxicity"])) == Counter(map(key, clean))

    group = jaccard_groups([r[1] for r in clean])
    best = {}
    for r in clean:
        g = group[shingles(r[1])]
        if g not in best or (r[0] is not None and (best[g] is None or r[0] < best[g])):
            best[g] = r[0]
    kept = results["near_dedup"]
    assert len(kept) == len(best)
    assert {group[shingles(r.text)]: r.doc_id for r in kept} == best

    left = [r for r in kept if not 600 <= (r.doc_id or 0) < 800]
    assert Counter(map(key, results["decontamination"])) == Counter(map(key, left))

    share = mixing.rates(spark.createDataFrame(results["decontamination"], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    want = Counter({(r.doc_id, r.source): r.copies for r in share if r.copies})
    assert Counter((r.doc_id, r.source) for r in results["mixing"]) == want and max(want.values()) <= 3

    out = results["sharding"]
    assert Counter(map(key, out)) == Counter(map(key, results["mixing"]))
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.shard == slow_jump(r.doc_id or 0, 16) for r in out)


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).columns == [*COLUMNS, "shard", "slot"]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
