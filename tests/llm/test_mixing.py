"""Entropy balancing: targets, multipliers and rounding against plain Python, and odd inputs."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from nightfold.llm import mixing


def slow_targets(sizes):
    """{source: target} by the words of the contract: share, stop, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def corpus(seed, n=500):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "é", "z", "B"]
    rows = []
    for i in range(n):
        size = int(rng.lognormvariate(4, 1.3))
        rows.append((i, " ".join(["w"] * size), rng.choices(names, [1, 2, 40, 9, 5, 3, 2])[0]))
    return rows


def test_targets_by_the_contract(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {s: rng.choice([0, 1, 5, 100, 3000]) for s in [None, "", "a", "b", "c", "é", "z"][: 3 + seed]}
        df = spark.createDataFrame([("1" if s is None else "0" + s, v) for s, v in sizes.items()], "src string, source_size long")
        got = {None if r.src == "1" else r.src[1:]: r.target for r in mixing.targets(df).collect()}
        want = slow_targets(sizes)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9) for s in want)


def test_multipliers_solve_the_dual(spark):
    hist = [("a", 10, 50), ("a", 300, 4), ("b", 5, 3), ("b", 2000, 1), ("c", 7, 9)]
    goals = [("a", 1700, 2500.0), ("b", 2015, 40.0), ("c", 63, 189.0)]
    got = {r.src: r for r in mixing.multipliers(spark.createDataFrame(hist, "src string, size long, n long"), spark.createDataFrame(goals, "src string, source_size long, target double")).collect()}
    assert set(got) == {"a", "b"}
    for src, _, target in goals[:2]:
        r = got[src]
        assert sum(n * s * min(3.0, math.exp(r.l * s / r.scale)) for x, s, n in hist if x == src) == pytest.approx(target, rel=1e-8)


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = corpus(1) + [(9000 + i, "same words here", "a") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.rates(df).collect()
    assert [c for c in mixing.rates(df).columns][:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    want = slow_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= max(5, 0.02 * target[s])
    assert sum(r.taken for r in got) == pytest.approx(sum(sizes.values()), rel=0.01)
    again = mixing.rates(df.repartition(9)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixed_rows_follow_the_rates(spark):
    rows = [(i, t, s, "x") for i, t, s in corpus(2, 200)] + [(7, None, None, "y"), (None, "null id", "a", None), (3, "", "b", None)] + [(5, "twin", "a", "t")] * 4 + [(6, "w " * 50_000, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = Counter((r.doc_id, len((r.text or "").split())) for r in mixing.mixed(df).collect())
    want = Counter()
    for r in mixing.rates(df).collect():
        if r.copies:
            want[r.doc_id, r["size"]] += r.copies
    assert got == want
    assert mixing.mixed(df).columns == df.columns
    assert mixing.rates(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.taken, r.target) for r in mixing.rates(empty).collect()] == [(0, 0, 0.0)] * 2
