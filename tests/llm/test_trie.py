from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from nightfold.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every node by its whole sequence of turns."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((-1 if t is None else t, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    members, ends, length = defaultdict(set), defaultdict(list), {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].append(c)
    children = defaultdict(set)
    for s in members:
        if s:
            children[s[:-1]].add(s)
    out = []
    for s, m in members.items():
        below = [x for x in members if x[: len(s)] == s]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), sum(not children[x] for x in below), saved, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(seed, n=60):
    """Few roles and texts, so that prefixes meet; families with and without their first conversation."""
    r, rows = random.Random(seed), []
    for c in r.sample(range(330), n) + [0, 100]:
        style = r.random()
        for t in range(r.choice([1, 2, 3, 5, 7, 9])):
            rows.append((c, None if t == 0 and style < 0.2 else t, r.choice(["user", None, "bot"]), r.choice(["a", "", None, "bé", "longer text"]) if style < 0.8 else f"own {c} {t}"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_of_whole_sequences(spark, seed):
    rows = random_rows(seed)
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_one_long_and_many_equal_conversations(spark, monkeypatch):
    """A conversation over several ranges and blocks, its copy, and more copies of another than go into one piece."""
    monkeypatch.setattr(trie, "ENDS", 7)
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, t, "user", f"t{t}") for c in (600, 723) for t in range(60)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(7)]
    rows += [(5, 0, "x", "only"), (7, 1, "x", "only")]  # shorter than their heads, whose family has no first
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(trie.trie(df)) == []
    rows = [(None, 0, "user", "nobody"), (200, None, None, None), (200, 1, "user", "x" * 100_000), (200, 1, "user", "x" * 100_000), (201, 0, "user", "y")]
    schema = T.StructType([*T._parse_datatype_string(SCHEMA).fields, T.StructField("depth", T.StringType())])
    assert found(trie.trie(spark.createDataFrame([(*r, "extra") for r in rows], schema))) == plain(rows)


def test_collisions_are_found(spark, monkeypatch):
    rows = random_rows(3, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(trie, "PRIMES", (5, 7, 3))  # equal fingerprints of different prefixes, whatever the base
    with pytest.raises(RuntimeError):
        trie.trie(df, bases=(2, 4))
    monkeypatch.undo()
    slim = trie._slim(df, 1, "conv_id", "turn", "role", "text")
    assert trie.one_text_each(slim)
    assert not trie.one_text_each(slim.selectExpr("role", "text", "1L as h", "2L as g"))
