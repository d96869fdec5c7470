from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nightfold.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain_counts(text):
    words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def plain_rows(docs, enough):
    """The same rules with sorted lists instead of sketches: quartiles are then cut to their leading digits."""
    counted = [(d[0], d[2], d[3], plain_counts(d[1])) for d in docs]
    measures = lambda n, chars, symbols, dup, rep: {"word_length": chars * 100 // n, "symbol_share": symbols * 10_000 // n, "dup_lines": dup * 10_000 // n, "repeat_share": rep * 10_000 // n}
    cut = lambda v: v >> max(v.bit_length() - rules.BITS, 0) << max(v.bit_length() - rules.BITS, 0)
    out = []
    for doc_id, lang, source, c in counted:
        base = c[0] < 50 or 100 * c[4] > 50 * c[0]
        failed = []
        if c[0]:
            mine = measures(*c)
            for r in rules.RULES:
                for same in (lambda x: x[1:3] == (lang, source), lambda x: x[1] == lang, lambda x: True):
                    values = sorted(measures(*x[3])[r.name] for x in counted if x[3][0] and same(x))
                    if len(values) >= enough:
                        break
                q1, q3 = cut(values[len(values) // 4]), cut(values[3 * len(values) // 4])
                reach = max(q3 - q1, r.least)
                v = mine[r.name]
                if (r.below is not None and v < q1 - r.below * reach) or (r.above is not None and v > q3 + r.above * reach):
                    failed.append(r.name)
        out.append((doc_id, *c, base, not base and not failed, failed))
    return out


def docs(seed=1):
    r, out = random.Random(seed), []
    for k in range(160):
        lang, source = r.choice(["en", "en", "en", "de", None]), r.choice(["a", "a", "a", "b", None])
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.choice([3, 60, 90, 200]))]
        if r.random() < 0.1:
            words = [w + r.choice(["###", "|", "é$"]) for w in words]
        if r.random() < 0.1:
            words = words[:3] * 40 + words
        text = "".join(w + r.choice([" ", "  ", "\n", "\t", " \r\n"]) for w in words)
        if r.random() < 0.1:
            text = "\n".join(["one line again"] * 9 + [text])
        out.append((k, text, lang, source))
    return [*out, (900, None, "en", "a"), (901, "", None, None), (902, " \n\t ", "en", "a"), (0, *out[0][1:]), (903, "x " * 30_000, "en", "b"), (904, "　wide  \U0001f600 ok" * 30, "de", "a")]


@pytest.mark.parametrize("enough", [1, 30, 1000])
def test_rules_against_sorted_lists(spark, enough):
    rows = docs()
    got = rules.judged(spark.createDataFrame([(*d, 1) for d in rows], SCHEMA + ", n_words long").repartition(5), enough=enough).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain_rows(rows, enough), key=repr)


def test_sketch_is_mergeable_and_close(spark):
    r = random.Random(2)
    values = [int(r.lognormvariate(6, 2)) for _ in range(4000)] + [0, 0, 1]
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "part int, v long")
    rule = (rules.Rule("v", lambda: F.col("v"), 1.0, None, 1),)
    parts = rules.sketches(df, ["part"], rule)
    merged = parts.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, rules.sketches(df, [], rule).collect()))
    q = rules.quartiles(merged, []).first()
    for got, rank in ((q.q1, len(values) // 4), (q.q3, 3 * len(values) // 4)):
        exact = sorted(values)[rank]
        assert got <= exact <= got * (1 + 2 ** -(rules.BITS - 1))


def test_no_rows(spark):
    assert rules.judged(spark.createDataFrame([], SCHEMA)).count() == 0
