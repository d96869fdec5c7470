from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from nightfold.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world, hello again.", "", None, "a", " ", "  two  spaces\tand\ttabs \n\n lines\r\n", "Ünïcödé straße 東京 \U0001f600\U0001f468‍\U0001f469", "already ▁ marked",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "x" * 5000, "1234567890 3.14159 -- ??!!", "nul \x00 inside", "Hello world, hello again.", "ﬁ ligature ½", "the the the the",
]


def plain(texts):
    """Token bytes from the libraries, groups and links by comparing all ends and all ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = {c: b for b, c in enumerate(bytes_to_characters())}
    out, linked, best = [], [], Counter()
    for t in texts:
        row, links = (0, 0, 0, 0, ""), Counter()
        if t:
            ids_a, ids_b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            parts_a = [bytes(printable[c] for c in tok.id_to_token(i)) for i in ids_a]
            parts_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in ids_b)]
            if b"".join(parts_a) == b"".join(parts_b) == (" " + t).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in parts_a]), np.cumsum([len(x) for x in parts_b])
                cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                groups, last = [], 0
                for c in cuts:
                    groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if last < e <= c) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
                    last = c
                begin_a, begin_b = ends_a - [len(x) for x in parts_a], ends_b - [len(x) for x in parts_b]
                for k, i in enumerate(ids_a):
                    for m in np.flatnonzero((begin_b < ends_a[k]) & (ends_b > begin_a[k])):
                        links[i, ids_b[m]] += 1
                row = (len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest())
        out.append(row)
        linked.append(links)
    count = Counter(p for links in linked for p in links)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(*r[:4], sum(n for p, n in x.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in x.items()), r[4]) for r, x in zip(out, linked)]


def bytes_to_characters():
    """Characters of bytes 0 to 255 in byte-level BPE, as its definition states them."""
    odd = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(next(odd)) for b in range(256)]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 5, 0])
def test_alignment(spark, frequent):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, row string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in align.alignment(df, A, B, frequent=frequent).collect()}
    assert [got[k] for k in range(len(TEXTS))] == plain(TEXTS)


def test_byte_level_tokens_give_texts_back():
    pair, r = align.Pair(A, B), random.Random(4)
    assert pair.faithful_a
    odd = ["a", "é", " ", "\n", "\x00", "\u0301", "\U0001f600", "\ufffd", "<|endoftext|>", "\u3000", "'s", "1"]
    texts = [" " + "".join(r.choice(odd) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for t, ids in zip(texts, pair.a.encode(texts)):
        assert b"".join(pair.bytes_a[i] for i in np.frombuffer(ids, pair.a.type)) == t.encode()


def test_no_rows(spark):
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_runs_against_common_ends():
    r = random.Random(1)
    for _ in range(300):
        n = r.choice([1, 5, 40, 250])
        share = r.choice([0.05, 0.5, 0.95])
        a = sorted({*(k for k in range(1, n) if r.random() < share), n})
        b = sorted({*(k for k in a if r.random() < r.choice([0.2, 0.98])), *(k for k in range(1, n) if r.random() < 0.02), n})
        steps = lambda x: bytes(np.diff([0, *x]).tolist())
        first_a, first_b, i, j = align.groups(steps(a), steps(b))
        common = sorted(set(a) & set(b))
        assert [a.index(c) + 1 for c in common] == [*first_a[1:].tolist(), len(a)] and [b.index(c) + 1 for c in common] == [*first_b[1:].tolist(), len(b)]
        wanted = {(k, m) for k in range(len(a)) for m in range(len(b)) if max(([0] + a)[k], ([0] + b)[m]) < min(a[k], b[m])}
        assert len(i) == len(wanted) and set(zip(i.tolist(), j.tolist())) == wanted
        straight, odd, *_ = align.runs(steps(a), steps(b))
        assert sum(x[2] for x in straight) + len(odd) == len(common)


def test_stretches_are_jumped():
    """A long one-to-one text is one stretch, found with few comparisons."""

    class Counted(bytes):
        looked = 0

        def __getitem__(self, k):
            Counted.looked += 1
            return super().__getitem__(k)

    steps = bytes([1, 2, 3, 4]) * 25_000
    assert align.runs(Counted(steps), steps)[:2] == ([(0, 0, 100_000)], []) and Counted.looked < 50


def test_counts_passed_on_early(spark, monkeypatch):
    monkeypatch.setattr(align, "PAIRS", 3)
    batch = align.pa.RecordBatch.from_pydict({"pairs": [np.array(x, "<u4").tobytes() for x in ([1, 2], [2, 3, 4], [2, 9], [1])]})
    total = Counter()
    for b in align._count(iter([batch])):
        total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert total == {1: 2, 2: 3, 3: 1, 4: 1, 9: 1}


def _batch(texts):
    columns = [align.pa.array(range(len(texts))), align.pa.array(range(len(texts))), align.pa.array(texts, align.pa.string())]
    return align.pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text"])


def test_models_see_a_piece_once(monkeypatch):
    """What the models are given grows with the different pieces, not with the text."""
    seen = []
    encode = align.Pieces.encode
    monkeypatch.setattr(align, "_pairs", {})
    monkeypatch.setattr(align.Pieces, "encode", lambda self, texts: seen.extend(texts) or encode(self, texts))
    texts = [f"common words, word{k % 7} again and again" for k in range(500)]
    rows = [r for b in align._align(A, B)(iter([_batch(texts)] * 3)) for r in b.to_pylist()]
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows[:7]] == [(*x[:4], x[6]) for x in plain(texts[:7])]
    assert len(rows) == 1500 and sum(map(len, seen)) < 200


def test_pieces_against_whole_texts(monkeypatch):
    r = random.Random(9)
    odd = ["a", "word", "é", " ", " ", "  ", "\n", "\x00", "\u0301", "\U0001f600", "\u2581", "<|endoftext|>", "<s>", "\u3000", "\x1c", "\u200b", ".", "'s", "12", "x" * 70]
    texts = [None, "", " ", "  "] + ["".join(r.choice(odd if r.random() < 0.5 else odd[:4]) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    pair = align.Pair(A, B)
    assert pair.cuts
    pair.known.most = 300  # the table of known pieces is full time and again
    found = [pair.encode(align.pa.array(texts[k : k + 100], align.pa.string())) for k in range(0, len(texts), 100)]
    found = [np.concatenate(x) for x in zip(*found)]
    pair.cuts = False
    assert all(np.array_equal(x, y) for x, y in zip(found, pair.encode(align.pa.array(texts, align.pa.string()))))
    assert 0 < sum(n == 0 for n in found[2]) < len(texts) / 2
    # chunks of several documents, of one document, and documents of their own
    monkeypatch.setattr(align, "BYTES", 40)
    few = texts[:300]
    one = [x for k in range(len(few)) for b in align._align(A, B)(iter([_batch(few).slice(k, 1)])) for x in b.to_pylist()]
    assert [x for b in align._align(A, B)(iter([_batch(few)])) for x in b.to_pylist()] == one
    assert [(x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"]) for x in one] == [(*x[:4], x[6]) for x in plain(few)]
