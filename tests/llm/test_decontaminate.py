"""Pigeonhole edit matching against a plain dynamic programme."""

from __future__ import annotations

import random

from nightfold.llm import decontaminate as dc


def slow_find(item, text, k):
    """(fewest edits, first end) over all places, or None."""
    row = list(range(len(item) + 1))
    best = None
    for at, c in enumerate(text):
        new = [0]
        for i, p in enumerate(item):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] <= k and (best is None or row[-1] < best[0]):
            best = row[-1], at + 1
    return best


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        p = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[p] = rng.choice("abc ")
        elif kind == 1:
            t.insert(p, rng.choice("abc"))
        elif len(t) > 1:
            del t[p]
    return "".join(t)


def test_myers_equals_the_programme():
    rng = random.Random(1)
    for _ in range(400):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))) + edited(rng, item, rng.randint(0, 6)) + "ba"
        k = rng.randint(0, 8)
        assert dc.myers(item, text, k) == slow_find(item, text, k)


def test_pieces_cover_the_item():
    for n in (1, 19, 20, 21, 200, 999):
        k = dc.budget(n)
        p = dc.pieces(n, k)
        assert len(p) == k + 1 and p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:])) and all(a < b for a, b in p)


def test_matcher_finds_all_and_only_what_brute_force_finds():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, dc.normalise(say(rng.randint(1, 30)))) for i in range(40)]
    m = dc.Matcher(items)
    hits = 0
    for _ in range(150):
        i, item = rng.choice(items)
        text = say(rng.randint(0, 40)) + " " + edited(rng, item, rng.randint(0, 9)) + " " + say(rng.randint(0, 20)) + " " + (edited(rng, item, 2) if rng.random() < 0.3 else "")
        t = dc.normalise(text)
        want = {(j, *slow_find(x, t, dc.budget(len(x)))) for j, x in items if slow_find(x, t, dc.budget(len(x)))}
        got = m.find(text.upper() + "\n")
        assert {g[:2] for g in got} == {w[:2] for w in want}
        hits += len(want)
    assert hits > 100


def test_on_tables_with_odd_rows_and_blocks(spark):
    a, b = "the first passage of a benchmark, with a few words in it", "another one quite different from the first passage indeed"
    bench = spark.createDataFrame([(1, a, "x"), (2, b, "x"), (3, None, "x"), (4, "  ", "x"), (1, a, "twin")], "item_id long, text string, doc_id string")
    docs = [(1, f"zz {a.upper()} zz", "k"), (2, f"zz {b.replace('quite', 'quit')}", None), (3, None, None), (4, "", None), (5, "clean words only", None), (None, a, None), (6, "x " * 40_000 + a.replace(" ", "\n") + " y" * 40_000, None), (7, b[:-12], None), (1, f"zz {a.upper()} zz", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    for size in (dc.BLOCK_CHARS, 60):
        got = sorted(((r.doc_id, r.item_id, r.edits) for r in dc.matches(df, bench, block_chars=size).collect()), key=repr)
        assert got == sorted([(1, 1, 0)] * 4 + [(2, 2, 1)] + [(None, 1, 0)] * 2 + [(6, 1, 0)] * 2, key=repr)
        left = dc.without_benchmark(df, bench, block_chars=size)
        assert left.columns == df.columns
        assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]
    assert dc.matches(df, bench.limit(0)).count() == 0 and dc.matches(df.limit(0), bench).count() == 0
    assert dc.without_benchmark(df, bench.limit(0)).count() == len(docs)
