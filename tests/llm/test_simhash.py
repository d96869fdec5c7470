"""SimHash: fingerprints, the exactness of the covering, components, and odd inputs."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from nightfold.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    """{fp: set of linked fps}, by all pairs."""
    left, out = set(fps), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if (a ^ b).bit_count() <= 4}
            left -= near
            todo += near
        out |= dict.fromkeys(group, group)
    return out


def test_fingerprint_by_the_letter():
    for t in [None, "", " \n\t", "one", "One TWO three", "a b c d", "A b\tc\nd e f a b c d", "É ß à b c d e", "x " * 300]:
        assert simhash.fingerprint(t) % 2**64 == slow_fingerprint(t)


def test_every_close_pair_shares_an_anchor():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for p in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << p
        rows, cells = simhash.anchors(np.array([a, b], dtype=np.uint64).view(np.int64))
        assert set(cells[rows == 0]) & set(cells[rows == 1])
    rows, _ = simhash.anchors(np.arange(4096, dtype=np.int64) * 7919 * 104729 * 65537)
    assert np.bincount(rows).mean() < 90


def planted(seed=3, n=1200):
    rng = random.Random(seed)
    fps = [0, 1, 2**64 - 1]
    while len(fps) < n:
        a = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(fps)
        for p in rng.sample(range(64), rng.randint(0, 6)):
            a ^= 1 << p
        fps.append(a)
    return sorted(set(fps))


def test_components_equal_brute_force_with_and_without_hot_cells(spark):
    fps = planted()
    want = slow_components(fps)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for cell_rows in (2048, 8):
        got = {r.fp % 2**64: r.root for r in simhash.link_components(df, cell_rows=cell_rows).collect()}
        assert set(got) == {f for f in fps if len(want[f]) > 1}
        assert all(got[f] == min(map(signed, want[f])) for f in got)


def test_whole_operator_and_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, "a b c d e f g h", "x", "y"), (3, "A B C D E F G H", None, "y"), (9, None, None, None), (7, "", "x", None), (8, long, None, None), (2, long, None, None), (2, long, None, None), (None, "a b c d e f g h", None, None), (11, "lonely words here", None, None)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()), key=repr)
    hexed = lambda t: f"{slow_fingerprint(t):016x}"
    assert got == sorted([(5, hexed(rows[0][1]), 3), (3, hexed(rows[1][1]), 3), (None, hexed(rows[0][1]), 3), (9, "0" * 16, 7), (7, "0" * 16, 7), (8, hexed(long), 2), (2, hexed(long), 2), (2, hexed(long), 2), (11, hexed("lonely words here"), 11)], key=repr)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_copies_and_all_near(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(50)] + [(100 + i, " ".join(base[:i] + ["zz"] + base[i + 1 :])) for i in range(150)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = slow_components({slow_fingerprint(t) for _, t in rows})
    low = {}
    for i, t in rows:
        low.setdefault(min(want[slow_fingerprint(t)]), []).append(i)
    assert {r.doc_id: r.component_id for r in got} == {i: min(ids) for ids in low.values() for i in ids}
