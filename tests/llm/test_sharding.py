"""Jump hashing against the loop as published, and the shard table."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from nightfold.llm import sharding


def slow_jump(key, n):
    b, j = -1, 0
    key %= 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop():
    keys = [0, 1, 2, -1, 2**63 - 1, -(2**63), *range(1000, 3000, 7)]
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(np.array(keys, dtype=np.int64), n).tolist() == [slow_jump(k, n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20_000)
    before, after = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(after[before != after]) == {16}
    assert abs((before != after).mean() - 1 / 17) < 0.01
    assert max(Counter(before.tolist()).values()) < 1.15 * 20_000 / 16


def test_shards_of_odd_rows(spark):
    rows = [(i, f"text ß {i % 3}", "x") for i in range(400)] + [(5, "text ß 2", "y")] * 30 + [(None, None, None), (7, "", None), (8, "x" * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard(df)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    data = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(data(t)) + 1, zlib.crc32(data(t))) for i, t, _ in rows)
    for r in got:
        assert r.law == "key" and r.shard == slow_jump(r.doc_id or 0, 16) and r.grown_shard == slow_jump(r.doc_id or 0, 17)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, sharding.shard(df.repartition(7)).collect()), key=repr)
    assert sharding.shard(df.limit(0)).count() == 0
