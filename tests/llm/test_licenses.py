"""License scans: bands, retrieval and verification against a scan of all places."""

from __future__ import annotations

import random

from nightfold.llm import licenses


def slow(text, templates):
    """{(license)}: whose shingles lie in some stretch of a window's length to the wanted share."""
    words = licenses.words_of(text)
    places = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = set()
    for name, t in templates:
        w = licenses.words_of(t)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if own and any(len(own & set(places[i : i + round(1.25 * len(own))])) >= 0.8 * len(own) for i in range(len(places))):
            out.add(name)
    return out


def test_finds_planted_notices_and_nothing_else():
    rng = random.Random(0)
    fill = lambda n: " ".join(rng.choice(["the", "license", "of", "work", "under", "public", "version", "x1", "y2"]) for _ in range(n))
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for round_ in range(150):
        name, t = rng.choice(licenses.TEMPLATES)
        words, edited = t.split(), False
        if len(words) > 30 and rng.random() < 0.7:
            edited = True
            words[rng.randrange(len(words))] = "changed"
            words.insert(rng.randrange(len(words)), "more")
        text = fill(rng.randint(0, 300)) + " " + " ".join(words).upper() + "\n" + fill(rng.randint(0, 50))
        got = {g[0] for g in scanner.find([text])[0]}
        want = slow(text, licenses.TEMPLATES)
        assert want <= got and (edited or name in got)
        for g, share, first, n in scanner.find([text])[0]:
            assert share >= 0.8 and first >= 0 and n >= 5
    assert not any(scanner.find([fill(400) for _ in range(20)]))


def test_every_place_of_a_long_text():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for pad in [0, 1, 2, 3, 5, 8, 32_760, 32_764, 32_768, 40_000]:
        got = scanner.find(["before", "w " * pad + "Released under the MIT License. " + "v " * 100, None, "after " * 9])[1]
        assert [g[0] for g in got] == ["mit-line"] and got[0][2] == pad and got[0][3] == 5


def test_on_tables_with_odd_rows_and_blocks(spark):
    rows = [(1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"), (2, None, None), (3, "", None), (4, "MIT License", None), (None, "so: licensed under CC BY-NC 4.0", None), (5, "clean words " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    more = licenses.default_templates(spark).unionAll(spark.createDataFrame([("null", None), ("short", "two words")], "license string, text string"))
    for size in (licenses.BLOCK_CHARS, 300):
        got = licenses.scan(df, more, block_chars=size)
        assert got.columns == ["doc_id", "license", "containment", "first_word", "words"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "mit-line", 1.0, 0, 5)] * 2 + [(None, "cc-by-nc-4.0-line", 1.0, 1, 5)], key=repr)
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, more.limit(0)).count() == 0
