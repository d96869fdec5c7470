"""Token ids as compressed files: canonical length-limited Huffman codes from global counts.

Texts are encoded once; the ids are written, counted (one number per id and task), and coded document by document
with one code for the whole corpus. A document's bits begin on a byte; every BLOCK ids the bit offset is kept, so
that blocks can be decoded independently of one another, which the reader does for all blocks of a batch at once,
one table lookup an id. Coded documents are dealt into ranges of ids, so the files are in ascending order of ids.

Files under a folder: `code` (id, bits) and `docs` (part, doc_id, n_ids, crc, payload, checkpoints), Parquet
tables that any Spark store can hold; parts count upwards, and so do the ids inside and between them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from nightfold.llm.common import shuffle_partitions, stored

END = 0
BLOCK = 1024
MAX_BITS = 20
CHUNK = 1 << 20  # ids that are coded or decoded at once, whole documents
TEXT = 1 << 25  # bytes of text that are encoded at once, or a single document
PIECES = 500_000  # known pieces at the beginning of a text in a worker, more only if one call has more
WORDS = 1_500_000  # known pieces after a space in a worker, more only if one call has more

_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: A space beside another: white space of any definition in use, so that other spaces stand between two characters.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ODD = f"{_WHITE} | {_WHITE}"
#: Letters, then a sign: every pre-tokenisation of byte-level BPE separates the two.
_SIGNED = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[.,;:!?]$"


class Known:
    """Ids of pieces of text that were met before, one run of numbers a piece."""

    def __init__(self, begin: str, most: int, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: np.dtype):
        self.begin, self.most, self.learn = begin, most, learn
        self.pieces, self.ids, self.size, self.again = pa.array([], pa.string()), np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, bool)

    def find(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number) of different pieces; new ones are learnt. What was met once goes first if there are too many."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(at.is_null())
        known = at.drop_null().to_numpy()
        self.again[known] = True
        if len(self.pieces) + len(new) > self.most:
            stay = self.again.copy()
            if int(stay.sum()) + len(new) > self.most:
                stay[:] = False
            stay[known] = True
            keep = np.flatnonzero(stay)
            self.ids, self.pieces = _runs(self.ids, (np.cumsum(self.size) - self.size)[keep], self.size[keep]), self.pieces.take(pa.array(keep))
            self.size, self.again = self.size[keep], np.zeros(len(keep), bool)
            at = pc.index_in(pieces, value_set=self.pieces)
        where = at.to_numpy(zero_copy_only=False).astype(np.float64)
        if len(new):
            where[np.isnan(where)] = len(self.pieces) + np.arange(len(new))
            ids, size = self.learn([self.begin + p for p in new.to_pylist()])
            self.pieces, self.ids = pa.concat_arrays([self.pieces, new]), np.concatenate([self.ids, ids])
            self.size, self.again = np.concatenate([self.size, size]), np.concatenate([self.again, np.zeros(len(new), bool)])
        where = where.astype(np.int64)
        return self.ids, (np.cumsum(self.size) - self.size)[where], self.size[where]


def _runs(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """data[first[0] : first[0] + n[0]], data[first[1] : ...], ... one after another."""
    total = np.cumsum(n)
    return data[np.repeat(first - (total - n), n) + np.arange(total[-1] if len(n) else 0)]


class Encoder:
    """Ids of texts, as the tokenizers library gives them.

    Byte-level BPE never joins what its pre-tokenisation separates, and a single space between two other
    characters always begins a new piece. So for such tokenizers texts are cut there, a batch's different pieces are
    numbered and looked up, and only new ones reach the library. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cuts = self.cuts and all(s and not s[0].isspace() and not s[-1].isspace() and " " not in s for s in self.special) and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        if self.cuts:
            vocabulary = self.tokenizer.get_vocab()
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has one character a byte
            self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
            self.first, self.later = Known("", PIECES, self._learn, self.type), Known(" ", WORDS, self._learn, self.type)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them for each piece) by the library, all in one call."""
        ids = np.array(self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.cumsum([len(p.encode()) for p in pieces])
        after = np.r_[0, np.cumsum(self.bytes[ids])]
        cut = np.searchsorted(after, ends, side="left")
        if after[-1] == ends[-1] and (after[cut] == ends).all():
            return ids.astype(self.type), np.diff(np.r_[0, cut])
        each = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]  # a model that does not know every byte
        return np.array([i for x in each for i in x], dtype=self.type), np.array([len(x) for x in each], dtype=np.int64)

    def encode_column(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """Binary values: ids of texts, little-endian, with an end id if one is given; null counts as empty."""
        tail = b"" if end is None else np.array([end], self.type).tobytes()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.full(len(texts), not self.cuts)
        for s in self.special if self.cuts else ():
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if whole.any():  # from here on few texts, or a tokenizer of another kind
            out = np.empty(len(texts), dtype=object)
            out[whole] = [(self.library(t) if t else b"") + tail for t in texts.filter(pa.array(whole)).to_pylist()]
            if not whole.all():
                out[~whole] = self.encode_column(texts.filter(pa.array(~whole)), end).to_pylist()
            return pa.array(out, pa.binary())
        if not len(texts):
            return pa.array([], pa.binary())
        lists = self._pieces(texts)
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        numbered = flat.dictionary_encode()
        place, pieces = numbered.indices.to_numpy(), numbered.dictionary
        signed = pc.match_substring_regex(pieces, _SIGNED)
        stems = pc.if_else(signed, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        opening = flat.take(pa.array(starts[:-1])).dictionary_encode()
        ids_first, at_first, n_first = self.first.find(opening.dictionary)
        signs = pc.utf8_slice_codeunits(pieces.filter(signed), -1, None).dictionary_encode()
        ids_sign, n_sign = self._learn(signs.dictionary.to_pylist()) if len(signs) else (np.zeros(0, self.type), np.zeros(0, np.int64))
        ids_later, at, n = self.later.find(stems.dictionary)
        # ids of each piece: those of its stem and of its sign, if any; then those of each opening, then the end
        stem, signed = stems.indices.to_numpy(), signed.to_numpy(zero_copy_only=False)
        own = np.zeros((len(pieces), 2, 2), np.int64)
        own[:, 0, 0], own[:, 0, 1] = at[stem], n[stem]
        sign = signs.indices.to_numpy()
        own[signed, 1, 0], own[signed, 1, 1] = len(ids_later) + (np.cumsum(n_sign) - n_sign)[sign], n_sign[sign]
        ids = _runs(np.concatenate([ids_later, ids_sign]), own[..., 0].ravel(), own[..., 1].ravel())
        n = np.concatenate([own[..., 1].sum(axis=1), n_first, [len(tail) // self.type.itemsize]])
        ids = np.concatenate([ids, _runs(ids_first, at_first, n_first), np.frombuffer(tail, self.type)])
        at = np.cumsum(n) - n
        place = place.astype(np.int64)
        place[starts[:-1]] = len(pieces) + opening.indices.to_numpy()
        sizes = np.diff(starts)
        out = []
        for lo, hi in _chunks(sizes, CHUNK):
            run = np.insert(place[starts[lo] : starts[hi]], starts[lo + 1 : hi + 1] - starts[lo], len(n) - 1)
            ends = np.r_[0, np.cumsum(n[run])][np.r_[0, starts[lo + 1 : hi + 1] - starts[lo] + np.arange(1, hi - lo + 1)]]
            out.append(_binary(_runs(ids, at[run], n[run]).view(np.uint8), ends * self.type.itemsize))
        return pa.concat_arrays(out)

    def _pieces(self, texts: pa.Array, odd: str = _ODD) -> pa.ListArray:
        """Each text's pieces, without the space before them; texts that match `odd` are not split at every space."""
        odd = pc.match_substring_regex(texts, odd)
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " ")
        odd = odd.to_numpy(zero_copy_only=False)
        cut = pa.array([_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        both = pa.concat_arrays([pc.split_pattern(texts.filter(pa.array(~odd)), " "), cut])
        return both.take(pa.array(np.argsort(np.argsort(odd, kind="stable"), kind="stable")))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, little-endian, without an end id; null counts as empty."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()


_encoders: dict[str, Encoder] = {}  # one per worker and file


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# Codes


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol (0 where its count is 0) of a best prefix code with at most `most` bits, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} symbols need more than {most} bits")
    order = used[np.lexsort((used, counts[used]))]
    coins = counts[order].astype(np.float64 if counts.sum() > 1 << 57 else np.int64)
    levels, packages = [], coins[:0]
    for _ in range(most):
        merged = np.concatenate([coins, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2]
    take = 2 * n - 2
    for is_coin in reversed(levels):
        own = int(is_coin[:take].sum())
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


def canonical(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, symbols in order of their codes): shorter first, then by symbol."""
    used = np.flatnonzero(bits)
    order = used[np.lexsort((used, bits[used]))]
    codes = np.zeros(len(bits), dtype=np.uint64)
    if len(order):
        top = int(bits.max())
        width = np.uint64(1) << (top - bits[order]).astype(np.uint64)
        codes[order] = np.r_[np.uint64(0), np.cumsum(width)[:-1]] >> (top - bits[order]).astype(np.uint64)
    return codes, order


def lookup_table(bits: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, its bits): for the next bits of a stream, symbol * 32 + bits of its code."""
    _, order = canonical(bits)
    top = max(1, int(bits.max(initial=0)))
    table = np.zeros(1 << top, dtype=np.int32)
    filled = np.repeat((order * 32 + bits[order]).astype(np.int32), 1 << (top - bits[order]))
    table[: len(filled)] = filled
    return table, top


def pack(ids: np.ndarray, ends: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of documents (ids[.. ends[0]], ids[ends[0] .. ends[1]], ...): (bytes, byte offsets of documents and of the
    end, bit offsets of blocks in their documents, first block of documents and the end)."""
    starts = np.r_[0, ends[:-1]]
    n = ends - starts
    length = bits[ids]
    after = np.r_[0, np.cumsum(length)]
    at_byte = np.r_[0, np.cumsum((after[ends] - after[starts] + 7) // 8)]
    inside = after[:-1] - np.repeat(after[starts], n)
    at = inside + np.repeat(at_byte[:-1] * 8, n)
    word = at >> 5
    value = codes[ids] << (64 - length - (at & 31)).astype(np.uint64)
    buffer = np.zeros(int(at_byte[-1]) // 4 + 3, dtype=np.uint64)
    if len(ids):
        new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])  # the codes in a word share no bit: sums are unions
        buffer[word[new]] += np.add.reduceat(value >> np.uint64(32), new)
        buffer[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    blocks = -(-n // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    places = np.repeat(starts, blocks) + (np.arange(first[-1]) - np.repeat(first[:-1], blocks)) * BLOCK
    return buffer.astype(">u4").tobytes()[: int(at_byte[-1])], at_byte, inside[places], first


def unpack(payload: np.ndarray, at_byte: np.ndarray, n: np.ndarray, offsets: np.ndarray, table: np.ndarray, top: int) -> np.ndarray:
    """All ids of the documents that begin at `at_byte` of `payload` and have n ids; offsets: of all their blocks."""
    blocks = -(-n // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    j = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    left = np.minimum(BLOCK, np.repeat(n, blocks) - j * BLOCK)
    bit = np.repeat(at_byte * 8, blocks) + offsets
    to = np.repeat(np.r_[0, np.cumsum(n)[:-1]], blocks) + j * BLOCK if len(n) else np.zeros(0, np.int64)
    order = np.argsort(-left, kind="stable")
    left, bit, to = left[order], bit[order], to[order]
    b = np.r_[payload, np.zeros(8, np.uint8)].astype(np.uint32)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    out = np.zeros(int(n.sum()), dtype=np.uint32)
    live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")  # blocks with more ids than the step
    for step, k in enumerate(live):
        p = bit[:k]
        found = table[(window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - top)]
        out[to[:k] + step] = found >> 5
        bit[:k] = p + (found & 31)
    return out


# Tables


def _binary(data: bytes | memoryview | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in `data`."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of rows whose sizes sum to `most` at most, or a single row."""
    total = np.r_[0, np.cumsum(sizes)]
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            for lo, hi in _chunks(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(), TEXT):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode_column(part.column(1), END)], names=["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with each text's ids and END as little-endian integers of `id_type(tokenizer)`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(tokenizer), "doc_id long, ids binary")


def count_ids(ids: DataFrame, vocabulary: int, kind: np.dtype) -> np.ndarray:
    """How often each id occurs; every task sends one number an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            total += np.bincount(_bytes(b.column(0))[0].view(kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(vocabulary, dtype=np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def _code(bits_sent, bounds: list[float], kind: np.dtype) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_sent.value
        codes, _ = canonical(bits)
        for b in batches:
            data, offsets = _bytes(b.column(1))
            ids_all, offsets = data.view(kind), offsets // kind.itemsize
            for lo, hi in _chunks(np.diff(offsets), CHUNK):
                ids = ids_all[offsets[lo] : offsets[hi]]
                ends = offsets[lo + 1 : hi + 1] - offsets[lo]
                body, at_byte, block_bits, first = pack(ids, ends, bits, codes)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[s:e]) for s, e in zip(np.r_[0, ends[:-1]], ends)]
                doc = b.column(0).slice(lo, hi - lo)
                part = np.searchsorted(bounds, doc.to_pandas().to_numpy(dtype=np.float64, na_value=-np.inf), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), doc, pa.array(np.diff(np.r_[0, ends])), pa.array(crc, pa.int64()), _binary(body, at_byte), _binary(block_bits.astype("<i8").view(np.uint8), first * 8)],
                    names=["part", "doc_id", "n_ids", "crc", "payload", "checkpoints"],
                )

    return run


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the coded ids of `docs` under `path` (which must not exist) in ascending order of ids, null ids first;
    equal ids are ordered by length and checksum. A null text counts as empty; other columns are not read."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    ids = stored(encoded(docs, tokenizer, id_col, text_col), "ids")
    bits = code_lengths(count_ids(ids, vocabulary, kind))
    used = np.flatnonzero(bits)
    spark.createDataFrame(pa.table({"id": used, "bits": bits[used]})).coalesce(1).write.parquet(f"{path}/code")
    parts = shuffle_partitions(spark)
    bounds = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    coded = ids.mapInArrow(_code(spark.sparkContext.broadcast(bits), sorted(set(bounds)), kind), "part int, doc_id long, n_ids long, crc long, payload binary, checkpoints binary")
    coded = coded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "n_ids", "crc")
    coded.write.option("compression", "none").parquet(f"{path}/docs")


def _decode(table_sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top = lookup_table(table_sent.value)
        for b in batches:
            n_all = b.column(2).to_numpy()
            body, at_byte = _bytes(b.column(4))
            points, at_point = _bytes(b.column(5))
            points, at_point = points.view("<i8"), at_point // 8
            for lo, hi in _chunks(n_all, CHUNK):
                n = n_all[lo:hi]
                ids = unpack(body[at_byte[lo] : at_byte[hi]], at_byte[lo:hi] - at_byte[lo], n, points[at_point[lo] : at_point[hi]], table, top)
                ends = np.r_[0, np.cumsum(n)]
                wide = ids.astype("<u4").view(np.uint8)
                for i in range(hi - lo):
                    if zlib.crc32(wide[4 * ends[i] : 4 * ends[i + 1]]) != b.column(3)[lo + i].as_py():
                        raise ValueError(f"document {b.column(1)[lo + i].as_py()} does not match its checksum")
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(4)), _binary(wide, ends * 4)], names=["part", "doc_id", "n_ids", "crc", "ids"])

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, n_ids, crc, ids) of all documents under `path`; ids are little-endian unsigned 32-bit integers
    with the end id, checked against the checksum kept with them."""
    code = spark.read.parquet(f"{path}/code").collect()  # at most one row an id of the vocabulary
    bits = np.zeros(max((r.id for r in code), default=0) + 1, dtype=np.int64)
    for r in code:
        bits[r.id] = r.bits
    docs = spark.read.parquet(f"{path}/docs").select("part", "doc_id", "n_ids", "crc", "payload", "checkpoints")
    return docs.mapInArrow(_decode(spark.sparkContext.broadcast(bits)), "part int, doc_id long, n_ids long, crc long, ids binary")


def starts(rows: DataFrame) -> DataFrame:
    """Adds `start`, the number of ids of all documents before a row's: those of earlier parts (one row a part is
    summed up), and those before it in its part."""
    at = W.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "n_ids", "crc").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(at), F.lit(0))).join(parts, "part").withColumn("start", (F.col("start") + F.col("_before")).cast("long")).drop("_before")
