"""Huffman-coded token files: best code lengths, round trips, ids as the library gives them, odd rows."""

from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from nightfold.llm import queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    h = [c for c in counts if c]
    heapq.heapify(h)
    cost = 0
    while len(h) > 1:
        a = heapq.heappop(h) + heapq.heappop(h)
        cost += a
        heapq.heappush(h, a)
    return cost


def test_code_lengths():
    rng = random.Random(0)
    for n in (2, 3, 10, 300):
        counts = np.array([rng.choice([0, 1, 5, 1000, 10**6]) for _ in range(n)] + [1, 2])
        bits = tokens.code_lengths(counts, 40)
        assert (bits * counts).sum() == huffman_cost(counts.tolist())
        used = bits[bits > 0]
        assert (0.5**used).sum() == 1
        tight = tokens.code_lengths(counts, 9)
        assert tight.max() <= 9 and (0.5 ** tight[tight > 0]).sum() <= 1 and ((tight > 0) == (counts > 0)).all()
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    assert tokens.code_lengths(np.array(fib)).max() <= 20
    assert tokens.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        tokens.code_lengths(np.ones(9, dtype=np.int64), 3)


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.4, size=5000)
    bits = tokens.code_lengths(counts)
    codes, _ = tokens.canonical(bits)
    table, top = tokens.lookup_table(bits)
    n = np.array([1, 1023, 1024, 1025, 1, 5000, 2, 2048])
    ids = rng.choice(5000, size=n.sum(), p=counts / counts.sum())
    body, at, offsets, first = tokens.pack(ids, np.cumsum(n), bits, codes)
    assert len(body) == at[-1] and len(offsets) == first[-1] == (-(-n // 1024)).sum()
    assert (tokens.unpack(np.frombuffer(body, np.uint8), at[:-1], n, offsets, table, top) == ids).all()
    one = np.frombuffer(body, np.uint8)[at[5] : at[6]]
    assert (tokens.unpack(one, np.array([0]), n[5:6], offsets[first[5] : first[6]], table, top) == ids[n[:5].sum() : n[:6].sum()]).all()


def test_encoder_equals_the_library(monkeypatch):
    t = Tokenizer.from_file(PATH)
    e = tokens.Encoder(PATH)
    assert e.cuts
    rng = random.Random(3)
    odd = ["a", "B", " ", "  ", "\n", "\t", ",", ".", "'s", "'", "é", "ß", "1", "²", "<|endoftext|>", " ", " ", "\x1c", "日本", "🙂", "!!", "́", "Ⅷ", "word", "don't"]
    texts = ["", " ", "a b", " a", "a ", "x  y", "a \n b"] + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for x, got in zip(texts, e.encode(texts)):
        assert np.frombuffer(got, e.type).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    monkeypatch.setattr(tokens, "PIECES", 40)
    monkeypatch.setattr(tokens, "WORDS", 30)
    small = tokens.Encoder(PATH)
    assert [y for i in range(0, len(texts), 50) for y in small.encode(texts[i : i + 50])] == e.encode(texts)
    assert e.encode([]) == [] and e.encode([None]) == [b""]


def test_known_pieces_are_not_encoded_again(monkeypatch):
    rng = random.Random(4)
    e, sent = tokens.Encoder(PATH), []
    learn = e._learn
    monkeypatch.setattr(e.later, "learn", lambda pieces: sent.extend(pieces) or learn(pieces))
    common, t = [f"w{i}rd" for i in range(50)], Tokenizer.from_file(PATH)
    monkeypatch.setattr(e.later, "most", 200)
    for k in range(20):  # each call has the common words, with and without a sign, and 40 of its own
        words = common + [w + "," for w in common] + ["é" * (k + 1) + "x" * i for i in range(40)]
        text = " ".join(["start", *rng.sample(words, len(words))])
        assert np.frombuffer(e.encode([text])[0], e.type).tolist() == t.encode(text, add_special_tokens=False).ids
    assert all(sent.count(f" {w}") == 1 for w in common) and len(e.later.pieces) <= 200
    texts = ["a\n\nb c\t\td", "in  doubt,  yes", None, " lead", "tail ", "<|endoftext|> x", "\u3000 wide \u3000", "ids.\n\n  - item"]
    ids = e.encode_column(pa.array(texts), tokens.END).to_pylist()
    assert [np.frombuffer(x, e.type).tolist() for x in ids] == [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_files_round_trip_with_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "gamma.\n", "ß", "é"]) for _ in range(rng.randint(0, 60))), "x") for i in rng.sample(range(10**6), 300)]
    rows += [(7, None, None), (8, "", None), (None, "null id", None), (9, "long " * 60_000, None), (rows[0][0], "twin", None), rows[1], (2**60, "far", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = str(tmp_path / "coded")
    tokens.write(df, PATH, path)
    t = Tokenizer.from_file(PATH)
    want = [(d, t.encode(x or "", add_special_tokens=False).ids + [0]) for d, x, _ in rows]
    data = lambda ids: np.array(ids, dtype="<u4").tobytes()
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(data(r[1]))))
    got = sorted(tokens.starts(tokens.read(spark, path)).collect(), key=lambda r: (r.start))
    at = 0
    for r, (d, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_ids, bytes(r.ids)) == (d, at, len(ids), data(ids))
        at += len(ids)
    stored = spark.read.parquet(path + "/docs").select("part", "doc_id").collect()
    by = {}
    for r in stored:
        by.setdefault(r.part, []).append(-1 if r.doc_id is None else r.doc_id)
    assert all(v == sorted(v) for v in by.values())
    keys = sorted(by)
    assert all(max(by[a]) <= min(by[b]) for a, b in zip(keys, keys[1:]))


def test_query_digests_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(2, "two words"), (1, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_token_ids(spark, str(tmp_path)).orderBy("doc_id").collect()
    ids = Tokenizer.from_file(PATH).encode("two words", add_special_tokens=False).ids + [0]
    assert [tuple(r) for r in got] == [(1, 0, 1, zlib.crc32(bytes(4))), (2, 1, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))]
    tokens.write(df.limit(0), PATH, str(tmp_path / "none"))
    assert tokens.starts(tokens.read(spark, str(tmp_path / "none"))).count() == 0
