"""Alignment of the tokens that two tokenizers make of the same text, and corpus-wide counts of linked ids.

Both token sequences cut the text's bytes; where a token of either ends at the same byte, both are cut into groups, and
tokens of a group whose bytes overlap are linked. Groups are found on the two arrays of token ends by skipping along
diagonals: as long as tokens match one to one, the ends agree at a constant shift between the indices, so stretches of
doubling length are compared at the current shift, and the last one is searched for the first difference. There the
group is irregular; both sides are walked token by token (each step is a link) until their ends meet, which gives the new
shift.

Texts are tokenized once. Neither tokenizer joins anything over a single space between two other characters (for models
of other kinds whole texts are tokenized), so texts are cut there, and both look up the numbered pieces of a chunk
together; only new pieces reach the libraries. A chunk's documents are aligned as one sequence: where a document ends, both
sides end. A document's distinct linked pairs of ids are kept with their numbers in a table; document
frequencies are sums over it. The most frequent pairs, at most FREQUENT of them, are sent to all tasks; links of all others
meet their counts by a join.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.llm.common import stored
from nightfold.llm.tokens import _ODD, Encoder, Known, _binary, _chunks, _runs

SPACE = "▁"  # how pieces spell a space
BYTES = 1 << 20  # bytes of texts that are tokenized and aligned at once, whole texts
KNOWN = 500_000  # pieces that a worker remembers, more only if one chunk has more
LONG = 64  # bytes of a piece that is remembered, at most
PROBE = 4  # tokens of a stretch's first probe
PAIRS = 2_000_000  # distinct pairs that a task counts before it passes them on
FREQUENT = 1 << 20  # pairs whose counts are sent to every task, at most


# One document


def runs(a: bytes, b: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[int], list[int]]:
    """Groups of two token sequences over the same bytes. a, b: each token's bytes (255 at most), that is the steps between
    the ends: from a common end on, ends agree as long as steps do, and comparing steps is comparing memory.

    Returns (one-to-one stretches (i, j, length), irregular groups (i, i after, j, j after), and the links i, j inside the
    irregular groups).
    """
    straight, odd, left, right = [], [], [], []
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        # Both stand at a common end: probe PROBE, twice as many, ... tokens further at this shift.
        begin, width = i, PROBE
        while i < n and j < m and a[i : i + width] == b[j : j + width]:
            step = min(width, n - i)
            i, j, width = i + step, j + step, width * 2
        if i < n and j < m:
            # The first difference is within the last probe: halve it.
            lo, hi = 0, min(width, n - i, m - j)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if a[i + lo : i + mid] == b[j + lo : j + mid]:
                    lo = mid
                else:
                    hi = mid
            i, j = i + lo, j + lo
        if i > begin:
            straight.append((begin, j - (i - begin), i - begin))
        if i < n and j < m:
            # An irregular group: one step a link, until the ends meet. The shift j - i is then a new one.
            first_i, first_j = i, j
            ahead = a[i] - b[j]
            left.append(i)
            right.append(j)
            while ahead:
                if ahead < 0:
                    i += 1
                    ahead += a[i]
                else:
                    j += 1
                    ahead -= b[j]
                left.append(i)
                right.append(j)
            i, j = i + 1, j + 1
            odd.append((first_i, i, first_j, j))
    return straight, odd, left, right


def groups(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first a, first b) of every group in order, and (i, j) of all links, of two sequences as in `runs`."""
    straight, odd, left, right = runs(a, b)
    s, o = np.array(straight, dtype=np.int64).reshape(-1, 3), np.array(odd, dtype=np.int64).reshape(-1, 4)
    place = np.arange(s[:, 2].sum()) - np.repeat(np.cumsum(s[:, 2]) - s[:, 2], s[:, 2])
    si, sj = np.repeat(s[:, 0], s[:, 2]) + place, np.repeat(s[:, 1], s[:, 2]) + place
    start_a, start_b = np.concatenate([si, o[:, 0]]), np.concatenate([sj, o[:, 2]])
    order = np.argsort(start_a, kind="stable")
    return start_a[order], start_b[order], np.concatenate([si, np.array(left, dtype=np.int64)]), np.concatenate([sj, np.array(right, dtype=np.int64)])


# Tokenizers


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """Ids of texts under a sentencepiece model, and the bytes of its pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.cuts = self._separates()

    def _separates(self) -> bool:
        """Whether a text may be cut before a space behind another character. Pairs are merged only into pieces of the
        model: if none has such a space, no merge reaches over it, and the model adds the space that each part begins with."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:  # the model's settings are read with protobuf
            return False
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        norm, kind = spec.normalizer_spec, spec.trainer_spec
        merges = kind.model_type == kind.BPE and kind.byte_fallback and not kind.treat_whitespace_as_suffix
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        return merges and plain and all(p.type not in (p.USER_DEFINED, p.UNUSED) and SPACE not in p.piece.lstrip(SPACE) for p in spec.pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """The two tokenizers of a worker: ids and bytes of tokens."""

    def __init__(self, byte_level: str, pieces: str):
        self.a = Encoder(byte_level)
        self.a.tokenizer.encode_special_tokens = True
        self.a.special = []  # their strings are ordinary text here
        alphabet = _byte_alphabet()
        spec = json.loads(self.a.tokenizer.to_str())
        vocabulary = {t["content"]: t["id"] for t in spec.get("added_tokens", [])} | spec["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        # A byte-level model that knows every byte and normalises nothing gives each text back, so that needs no look.
        self.faithful_a = self.a.cuts and all(c in spec["model"]["vocab"] for c in alphabet)
        self.b = Pieces(pieces)
        self.bytes_b = self.b.bytes
        if max(map(len, self.bytes_a + self.bytes_b)) > 255:
            raise ValueError("tokens of more than 255 bytes")
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.uint8) for t in (self.bytes_a, self.bytes_b))
        # Decimal ids with what follows them in a digest: inside a group, and at its end. Filled up with zero bytes.
        digits = [f"{i}{end}".encode() for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)]
        self.digits_n = np.array([len(x) for x in digits])
        self.digits = np.array(digits).view(np.uint8).reshape(len(digits), -1)
        self.wide = len(self.bytes_b)
        # Ids of known pieces of text: those of A, then those of B after all of A's, or `unlike` if B does not give the piece back.
        self.unlike = len(self.bytes_a) + len(self.bytes_b)
        self.cuts = self.faithful_a and self.b.cuts
        self.known = Known("", KNOWN, self._learn, np.dtype(np.int32))

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of both, number of them for each piece) of pieces that stand behind a space."""
        from_a, n_a = self.a._learn([" " + p for p in pieces])
        found = self.b.encode(pieces)
        n_b = np.array([len(x) for x in found], dtype=np.int64)
        from_b = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(n_b.sum()))
        wholes = [b" " + p.encode() for p in pieces]
        ends = np.r_[0, np.cumsum(self.length_b[from_b], dtype=np.int64)][np.cumsum(n_b)]
        if not (np.diff(np.r_[0, ends]) == [len(w) for w in wholes]).all() or b"".join(map(self.bytes_b.__getitem__, from_b.tolist())) != b"".join(wholes):
            found = [x if b"".join(map(self.bytes_b.__getitem__, x)) == w else [self.wide] for x, w in zip(found, wholes)]
            n_b = np.array([len(x) for x in found], dtype=np.int64)
            from_b = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(n_b.sum()))
        first = np.stack([np.cumsum(n_a) - n_a, len(from_a) + np.cumsum(n_b) - n_b], axis=1)
        both = np.concatenate([from_a.astype(np.int32), (from_b + len(self.bytes_a)).astype(np.int32)])
        return _runs(both, first.ravel(), np.stack([n_a, n_b], axis=1).ravel()), n_a + n_b

    def _find(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number) of different pieces; long ones are not remembered."""
        long = pc.greater(pc.binary_length(pieces), LONG)
        if not pc.any(long).as_py():
            return self.known.find(pieces)
        ids, at, n = self.known.find(pieces.filter(pc.invert(long)))
        more, size = self._learn(pieces.filter(long).to_pylist())
        long = long.to_numpy(zero_copy_only=False)
        first, number = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        first[~long], number[~long] = at, n
        first[long], number[long] = len(ids) + np.cumsum(size) - size, size
        return np.concatenate([ids, more]), first, number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, their numbers for each text): of all texts one after another. Texts that are null, empty, or
        not those that the bytes of both sides give behind a space, have none."""
        n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        there = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        if not len(there):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), n_a, n_b
        texts = texts.cast(pa.string()).take(pa.array(there))
        if not self.cuts:
            found = list(self._whole(texts.to_pylist()))
            n_a[there], n_b[there] = [len(a) for a, _ in found], [len(b) for _, b in found]
            return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), n_a, n_b
        # An empty piece could not be told from none: texts that begin or end with a space are not split at every space.
        lists = self.a._pieces(texts, f"{_ODD}|^ | $")
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        numbered = lists.flatten().dictionary_encode()
        ids, first, n = self._find(numbered.dictionary)
        place = numbered.indices.to_numpy()
        ids, ends = _runs(ids, first[place], n[place]), np.r_[0, np.cumsum(n[place])][starts]
        unlike = np.diff(np.r_[0, np.cumsum(ids == self.unlike)][ends]) > 0
        if unlike.any():
            ids, sizes = ids[~np.repeat(unlike, np.diff(ends))], np.where(unlike, 0, np.diff(ends))
            ends = np.r_[0, np.cumsum(sizes)]
        of_b = ids >= len(self.bytes_a)
        n_b[there] = np.diff(np.r_[0, np.cumsum(of_b)][ends])
        n_a[there] = np.diff(ends) - n_b[there]
        return ids[~of_b].astype(np.int64), ids[of_b].astype(np.int64) - len(self.bytes_a), n_a, n_b

    def _whole(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text, tokenized whole; none where the bytes of a side are not those of a space and the text."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, x, y in zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts)):
            ids, whole = np.frombuffer(x, dtype=self.a.type), b" " + t.encode()
            same = b"".join(map(self.bytes_b.__getitem__, y)) == whole and (self.faithful_a or b"".join(map(self.bytes_a.__getitem__, ids.tolist())) == whole)
            yield (ids.astype(np.int64), np.array(y, dtype=np.int64)) if same else nothing

    def digests(self, a: np.ndarray, b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, ends: np.ndarray) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each text: a group's ids of either side, groups in order; '' without tokens.
        ends: ids of both sides before each text and after the last."""
        if not len(a):
            return [""] * (len(ends) - 1)
        end_a, end_b = np.r_[start_a[1:], len(a)], np.r_[start_b[1:], len(b)]
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[end_a - 1], last_b[end_b - 1] = 1, 1
        order = np.zeros(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(start_b, end_a - start_a)] = a + last_a * len(self.bytes_a)
        order[np.arange(len(b)) + np.repeat(end_a, end_b - start_b)] = 2 * len(self.bytes_a) + b + last_b * len(self.bytes_b)
        written = self.digits[order].ravel()
        written = written[written != 0]
        at = np.r_[0, np.cumsum(self.digits_n[order])][ends].tolist()
        return [hashlib.sha256(written[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in itertools.pairwise(at)]


_pairs: dict[tuple[str, str], Pair] = {}  # one per worker and files


def _pair(byte_level: str, pieces: str) -> Pair:
    if (byte_level, pieces) not in _pairs:
        _pairs[byte_level, pieces] = Pair(byte_level, pieces)
    return _pairs[byte_level, pieces]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _align(byte_level: str, pieces: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_level, pieces)
        for batch in batches:
            for lo, hi in _chunks(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(), BYTES):
                part = batch.slice(lo, hi - lo)
                a, b, n_a, n_b = pair.encode(part.column(2))
                # Documents follow one another on both sides: where one ends, so do its tokens of either.
                start_a, start_b, i, j = groups(pair.length_a[a].tobytes(), pair.length_b[b].tobytes())
                ends_a, ends = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_a + n_b)]
                doc = np.repeat(np.arange(len(part)), n_a)[i]
                keys, times = np.unique(doc << 32 | (a[i] * pair.wide + b[j]), return_counts=True)
                at = np.searchsorted(keys, np.arange(len(part) + 1) << 32) * 4
                numbers = (n_a, n_b, np.diff(np.searchsorted(start_a, ends_a)), np.bincount(doc, minlength=len(part)))
                lists = (_binary(x.astype("<u4").view(np.uint8), at) for x in (keys & 0xFFFFFFFF, times))
                columns = [*map(pa.array, numbers), pa.array(pair.digests(a, b, start_a, start_b, ends), pa.string()), *lists]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return run


def aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), stored: one row per document.

    pairs: distinct linked pairs, a id * size of B's vocabulary + b id, as ascending little-endian unsigned 32-bit
    integers; times: how often each is linked. Texts that are null, empty or not given back by both tokenizers have none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_align(byte_level, pieces), ALIGNED), "aligned")


# Corpus


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task hold each pair, passed on whenever PAIRS of them are known."""
    keys, counts, waiting, size = np.zeros(0, "<u4"), np.zeros(0, np.int64), [], 0

    def merge() -> None:
        nonlocal keys, counts, waiting, size
        new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        both = np.concatenate([keys, new])
        keys, at = np.unique(both, return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        waiting, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    for batch in batches:
        for x in batch.column(0):
            waiting.append(np.frombuffer(x.as_py(), "<u4"))
            size += len(waiting[-1])
            if size > PAIRS:
                merge()
                if len(keys) > PAIRS:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
    merge()
    yield out()


def pair_counts(rows: DataFrame, wide: int) -> DataFrame:
    """(pair, n, best), stored: documents that hold each pair, and whether no pair of the same A id is in more."""
    counts = stored(rows.select("pairs").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    top = F.max("n").over(W.partitionBy(F.floor(F.col("pair") / wide)))  # at most one row an id of B
    return stored(counts.withColumn("best", (F.col("n") == top).cast("long")), "best")


def _most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(pairs, ascending, n, best, least): the pairs in `least` documents or more, a power of two for which they are `most` at most."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("rows"))
    e, total = 63, 0
    found = {r.e: r.rows for r in sizes.collect()}  # at most 63 rows
    while e > 0 and total + found.get(e - 1, 0) <= most:
        e -= 1
        total += found.get(e, 0)
    rows = counts.where(F.col("n") >= F.lit(1 << e)).toArrow()
    pairs, n, best = (rows.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return pairs[order].astype("<u4"), n[order], best[order].astype(bool), 1 << e


def _sum_up(sent) -> Callable:
    """Sums over the pairs that were sent; the others of a document are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            sums = []
            for p, t in zip(batch.column(1), batch.column(2)):
                p, t = np.frombuffer(p.as_py(), "<u4"), np.frombuffer(t.as_py(), "<u4").astype(np.int64)
                at = np.searchsorted(pairs, p)
                known = np.zeros(len(p), bool) if not len(pairs) else pairs[np.minimum(at, len(pairs) - 1)] == p
                at, mine = at[known], t[known]
                sums.append((int(mine[best[at]].sum()), int((mine * n[at]).sum()), p[~known].astype(np.int64), t[~known]))
            columns = [pa.array([s[k] for s in sums], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "n_best", "count_sum", "rare", "rare_times"])

    return run


def link_counts(rows: DataFrame, wide: int, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of `aligned` rows: links whose pair is the most frequent of its A id, and the sum of the
    links' counts. `frequent` bounds what is sent to all tasks; whatever it is, the result is the same."""
    counts = pair_counts(rows, wide)
    *table, least = _most_frequent(counts, frequent)
    sums = rows.select("row", "pairs", "times").mapInArrow(_sum_up(rows.sparkSession.sparkContext.broadcast(tuple(table))), "row long, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    if least == 1:
        return sums.drop("rare", "rare_times")  # every pair was sent
    sums = stored(sums, "sums")
    rare = sums.select("row", F.inline(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_times").alias("times"))))
    rest = rare.join(counts.where(F.col("n") < least), "pair").select("row", (F.col("best") * F.col("times")).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    return sums.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_level: a byte-level BPE file of the tokenizers library, which reads a space and the text; pieces: a
    sentencepiece model, which adds the space itself. Null, empty and unfaithfully tokenized texts have zeros and an empty
    digest; documents of any length are aligned whole; repeated rows are separate documents, in pair counts too.
    Other columns are not read; an empty table gives an empty result.
    """
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    wide = SentencePieceProcessor(model_file=pieces).get_piece_size()
    if Tokenizer.from_file(byte_level).get_vocab_size() * wide > 1 << 32:
        raise ValueError("pairs of ids do not fit 32 bits")
    rows = aligned(docs, byte_level, pieces, id_col, text_col)
    sums = link_counts(rows, wide, frequent)
    out = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
