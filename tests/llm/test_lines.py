"""Line dedup: patience alignment, blocks, and the whole operator against a plain version."""

from __future__ import annotations

import random

from nightfold.llm import lines


def test_patience_is_an_alignment():
    rng = random.Random(0)
    for _ in range(300):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        got = lines.patience(a, b)
        assert all(a[p] == b[q] != 0 for p, q in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert lines.patience([5, 1, 2, 3], [1, 2, 3, 5]) == [(1, 0), (2, 1), (3, 2)]
    assert lines.patience([7, 7, 1, 7], [7, 1, 7, 7]) == [(0, 0), (2, 1), (3, 3)]


def test_blocks_need_an_anchor():
    assert lines.common_blocks([1, 2, 0, 3, 9, 4], [1, 2, 3, 8, 4], {3}) == [0, 1, 3]
    assert lines.common_blocks([1, 2, 9, 4], [1, 2, 8, 4], {4}) == [3]
    assert lines.common_blocks([1, 2], [1, 2], set()) == []


def slow(rows):
    """{(id, text): removed} by the docstrings, in plain Python."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    hashed = [(d, [lines.line_hash(x) for x in d[1].split("\n")]) for d in docs]
    hashed = [(d, h) for d, h in hashed if any(h)]
    count, owner, heads = {}, {}, {}
    for d, h in hashed:
        heads.setdefault(tuple(h), d)
        for x in set(h) - {0}:
            count[x] = count.get(x, 0) + 1
            owner.setdefault(x, (d, h))
    anchor = {x for x, n in count.items() if n > 1 and (x & 1 or n <= lines.RARE)}
    out = {}
    for d, h in hashed:
        if heads[tuple(h)] != d:
            if set(h) & anchor:
                out[d] = [i for i, x in enumerate(h) if x]
            continue
        gone = set()
        for first in {owner[x][0] for x in set(h) & anchor if owner[x][0] != d}:
            own = {x for x in set(h) & anchor if owner[x][0] == first}
            gone |= set(lines.common_blocks(h, next(b for e, b in hashed if e == first), own))
        if gone:
            out[d] = sorted(gone)
    return out


def test_operator_equals_plain_version_and_odd_rows(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    long = "one passage of more than eight words that many documents share"
    rows += [(1000 + i, f"own line {i}\n{long}\nanother own {i}") for i in range(120)]
    rows += [(3000 + i, "an exact copy of a text with words\nsecond line") for i in range(80)] + [(4000 + i, "short") for i in range(80)]
    rows += [(None, rows[0][1]), (7000, None), (7001, ""), (7002, " \n "), (7003, "x\n" * 30_000 + long), rows[3]]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    out = lines.dedup(df)
    assert out.columns == ["doc_id", "n_lines", "removed", "partners", "text"]
    got, want = out.collect(), slow(rows)
    assert len(got) == len(rows)
    text = {i: t for i, t in rows}
    for r in got:
        t = text[r.doc_id]
        assert list(r.removed) == want.get((r.doc_id, t), []), (r, want.get((r.doc_id, t)))
        assert r.n_lines == (0 if t is None else t.count("\n") + 1)
        kept = None if t is None else [x for i, x in enumerate(t.split("\n")) if i not in set(r.removed)]
        assert r.text == (None if t is None else "\n".join(kept) if any(x.strip() for x in kept) or not r.removed else "")
        assert bool(r.partners) == bool(r.removed)
    by = {r.doc_id: r for r in got}
    assert list(by[1001].removed) == [1] and by[3001].text == "" and by[4001].text == "short" and list(by[7003].removed) == [30_000]
    assert lines.dedup(df.limit(0)).count() == 0


def test_repeated_lines_go_as_well():
    assert lines.common_blocks([8, 5, 9], [1, 5, 2, 5, 3], {5}) == [1]  # twice in the first holder
    assert lines.common_blocks([8, 5, 9, 5, 7, 5, 6], [1, 5, 2, 5, 3], {5}) == [1, 3, 5]
    assert lines.common_blocks([1, 8, 5, 6, 0, 4, 9, 5, 6, 4, 7], [2, 5, 6, 4, 3], {5}) == [2, 3, 5, 7, 8, 9]  # a passage twice
    assert lines.common_blocks([5, 8, 1, 2, 3, 9], [7, 1, 2, 3, 6, 5, 4], {5, 2}) == [0, 2, 3, 4]  # in another order
    assert lines.patience([4, 4, 9, 4], [8, 4, 4, 4, 8]) == [(0, 1), (1, 2), (3, 3)]


def test_passages_of_frequent_short_lines(spark):
    verse = [f"verse {i} of it" for i in range(14)]  # over 50 words, no line of eight
    rows = [(i, "\n".join([f"head {i}", *verse[:7], "", *verse[7:], f"tail {i}"])) for i in range(120)]
    rows += [(1000 + i, "a\nb c\nd") for i in range(70)] + [(2000 + i, "two words") for i in range(70)]
    rows += [(3000 + i, f"mine {i}\ntwo words\nyours {i}") for i in range(3)]
    by = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert list(by[0].removed) == [] and by[0].text == rows[0][1]
    assert all(by[i].text == f"head {i}\n\ntail {i}" and list(by[i].partners) == [0] for i in range(1, 120))
    assert by[1000].text == "a\nb c\nd" and all(by[1000 + i].text == "" for i in range(1, 70))
    assert all(by[2000 + i].text == "two words" for i in range(70)) and all(not len(by[3000 + i].removed) for i in range(3))
