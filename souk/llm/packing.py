"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's ids (the end id last) are hashed into a vector: a token adds its
sign to its bucket. The vector, damped and of unit length, is projected to a few
Gaussian dimensions, whose values are made about uniform and cut into a grid; the
cell's place on the Hilbert curve is the document's key. Documents are range-sorted by
key, so that neighbours along the curve are alike, and laid end to end:

* every task of the sort knows where each of its documents starts in its range;
* a running sum over the ranges' sizes (one row a range) gives the global start;
* each document, joined with its start, is then cut by itself wherever a sequence ends.

No task sees more than its range, and no document waits for another. All sequences
are full but the last ``length`` ids at most, which are dealt into sequences whose
sizes are falling powers of two, so that none is padded.

Ids are stored once, before the sort, as little-endian integers of 16 bits where the
vocabulary allows, else 32. Encoding uses the tokenizers library: a text is cut at
blanks, tabs and line breaks (the tokenizer's normaliser and pattern never join
across them), and the ids of words met before come from a bounded table of the Python
worker. A text that holds one of the file's added tokens goes to the library whole.

Defined results: null text counts as empty: only the end id; repeated rows are packed
each, in the order doc_id (null first), then place of reading; other columns are
ignored; a text of any length is cut into as many pieces as it needs; an empty table
gives no piece.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.llm.common import id_text, int64, scratch_table, slices, texts_of, width
from souk.llm.words import WordTable, byte_alphabet, letters_and_marks, with_end

BUCKETS = 256
SLICE_BYTES = 6_000_000


# ------------------------------------------------------------------ the curve
def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (dimensions of ``bits`` bits; int64),
    by Skilling's transform."""
    x = [c.astype(np.uint64) for c in cells.T]
    one, top = np.uint64(1), 1 << (bits - 1)
    q = top
    while q > 1:
        low, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(len(x)):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ flip) >> np.uint64(bit)) & one)
    return key.astype(np.int64)


class Curve:
    """Hilbert keys of lists of ids: hashed vectors, ``dims`` projections, ``bits`` bits each."""

    def __init__(self, vocabulary: int, dims: int = 3, bits: int = 20, seed: int = 17):
        if dims * bits > 62:
            raise ValueError("dims * bits must fit a long: 62 at most")
        self.bits = bits
        h = (np.arange(vocabulary, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        self.bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
        self.sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        self.plane = np.random.default_rng(seed).standard_normal((BUCKETS, dims))

    def keys(self, counts: np.ndarray, ids: np.ndarray, at_once: int = 1024) -> np.ndarray:
        out, ends = np.empty(len(counts), np.int64), np.concatenate([[0], np.cumsum(counts)])
        for a in range(0, len(counts), at_once):
            b = min(len(counts), a + at_once)
            part = ids[ends[a]:ends[b]]
            cell = np.repeat(np.arange(b - a), counts[a:b]) * BUCKETS + self.bucket[part]
            v = np.bincount(cell, self.sign[part], (b - a) * BUCKETS).reshape(b - a, BUCKETS)
            v = np.sign(v) * np.sqrt(np.abs(v))
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            # a projection of a unit vector is about normal: its distribution function evens it out
            even = 1 / (1 + np.exp(-1.702 * (v @ self.plane)))
            out[a:b] = hilbert_keys(np.minimum((even * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits)
        return out


# ------------------------------------------------------------------- encoding
class BlankEncoder:
    """uint32 ids of whole texts for a tokenizer whose tokens never cross blanks."""

    GAPS = bytes.maketrans(b"\t\n\r", b"   ")
    LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in GAPS)

    def __init__(self, path: str, kept: int = 700_000, kept_chars: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.ends: dict[str, list[int]] = {"": []}
        self.table = WordTable(self.words, kept, kept_chars)

    @classmethod
    def of_worker(cls, path: str) -> BlankEncoder:
        """The Python worker's encoder for a file: its tasks share the table."""
        import tokenizers

        encoders = tokenizers.__dict__.setdefault("souk_blank_encoders", {})
        if path not in encoders:
            encoders[path] = cls(path)
        return encoders[path]

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def match(self, text: str) -> list[int]:
        """Ids of a text that is one match of the pattern."""
        return [t.id for t in self.merge(text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet))]

    def words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        other, at = [], []
        near: dict[str, list[int]] = {}
        for n, word in enumerate(words):
            split = letters_and_marks(word)
            if split is None:
                other.append(word)
                at.append(n)
                out.append([])
                continue
            core, tail = split[0].lower(), split[1]
            ids = near.get(core) or self.table.known(core)
            if ids is None:
                ids = near[core] = self.match(core)
            if tail not in self.ends:
                if len(self.ends) > 10_000:
                    self.ends = {"": []}
                self.ends[tail] = self.match(tail)
            out.append(ids + self.ends[tail])
        for n, ids in zip(at, self.plain(other)):
            out[n] = ids
        return out

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text (UTF-8), and all ids in turn."""
        odd = [n for n, text in enumerate(texts) if any(a in text for a in self.added)]
        # ASCII letters may get their lower case before the library gives it, but where a combining mark
        # (U+0300 to U+037F) could join the lower letter only, or an added token could come about
        plain = [text.translate(self.GAPS if b"<|" in text or b"\xcc" in text or b"\xcd" in text else self.LOWER) for text in texts]
        for n in odd:
            plain[n] = b""
        column = pa.array(plain, pa.large_binary()).cast(pa.large_string())
        counts, ids = self.table.ids(pc.split_pattern(column, " "))
        if not odd:
            return counts, ids
        by_text = np.split(ids, np.cumsum(counts)[:-1])
        for n, part in zip(odd, self.plain([texts[n].decode() for n in odd])):
            by_text[n] = np.array(part, np.uint32)
        return np.array([len(x) for x in by_text], np.int64), np.concatenate(by_text)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a binary column: null becomes empty, a byte that is not UTF-8 the replacement sign."""
    try:
        column.cast(pa.string())
    except pa.ArrowInvalid:
        return [t.encode() for t in texts_of(column)]
    return [t or b"" for t in column.to_pylist()]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, dims: int = 3, bits: int = 20) -> DataFrame:
    """doc_id, row (place of reading), key (on the curve), n, ids (bytes) of every row."""
    def run(batches):
        encoder = BlankEncoder.of_worker(tokenizer_path)
        curve = Curve(max(encoder.vocabulary, end_id + 1), dims, bits)
        kind = "<u2" if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, SLICE_BYTES):
            texts = utf8(batch.column(1))
            counts, ids = encoder.flat(texts)
            keys = curve.keys(counts, ids)
            counts, ids = with_end(counts, ids, end_id)
            data = ids.astype(kind).tobytes()
            ends = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "row": int64(np.arange(row, row + len(counts))), "key": int64(keys), "n": int64(counts),
                "ids": pa.array([data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())})
            row += len(counts)
    return id_text(docs).mapInArrow(run, "doc_id long, row long, key long, n long, ids binary")


# -------------------------------------------------------------------- packing
def ordered(rows: DataFrame) -> DataFrame:
    """For each row of ``encoded`` (without its ids): row, part (of the sort), local (start inside it), n."""
    order = ["key", "doc_id", "row"]
    rows = rows.select(*order, "n").repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(3).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_pydict({"row": batch.column(2), "part": pa.array(np.full(len(n), part, np.int32)), "local": int64(ends - n), "n": batch.column(3)})
            before = int(ends[-1]) if len(n) else before
    return rows.mapInArrow(run, "row long, part int, local long, n long")


def tail_sizes(left: int) -> list[int]:
    """The falling powers of two that add up to ``left``."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 4096, dims: int = 3, bits: int = 20) -> DataFrame:
    """Pieces: doc_id, start (in its document), length, ids (little-endian unsigned 32-bit, as
    bytes), doc_tokens, sequence_id, offset (in the sequence), key."""
    stored = scratch_table(encoded(docs, tokenizer_path, end_id, dims, bits), "packing-ids")
    # the ids stay where they are while their rows are ordered, and are shuffled once
    rows = scratch_table(ordered(stored), "packing-order")
    # one row for each range of the sort
    parts = rows.groupBy("part").agg(F.sum("n").alias("size"))
    parts = parts.select(F.col("part").alias("of"), (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    full = total // length
    # ends of the sequences after the last full one
    tail = full * length + np.concatenate([[0], np.cumsum(tail_sizes(total - full * length))]).astype(np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield cut(batch.slice(at, 1024))

    def cut(batch):
        doc_id, begin, n = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        from_row, start, size, sequence, offset, data = [], [], [], [], [], []
        for i, raw in enumerate(batch.column(3)):
            raw = raw.as_py()
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[i] else "<u4").astype("<u4")
            g, end = int(begin[i]), int(begin[i] + n[i])
            edges = np.arange((g // length + 1) * length, min(end, full * length + 1), length)
            edges = np.unique(np.concatenate([[g, end], edges[edges < end], tail[(tail > g) & (tail < end)]]))
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                j = int(np.searchsorted(tail, a, "right")) - 1
                from_row.append(i)
                start.append(a - g)
                size.append(b - a)
                sequence.append(a // length if j < 0 else full + j)
                offset.append(a % length if j < 0 else a - int(tail[j]))
                data.append(ids[a - g:b - g].tobytes())
        take = pa.array(from_row, pa.int64())
        return pa.RecordBatch.from_pydict({
            "doc_id": doc_id.take(take), "start": int64(start), "length": int64(size), "ids": pa.array(data, pa.binary()),
            "doc_tokens": batch.column(2).take(take), "sequence_id": int64(sequence), "offset": int64(offset), "key": batch.column(4).take(take)})
    begins = rows.join(F.broadcast(parts), F.col("part") == F.col("of")).select("row", (F.col("before") + F.col("local")).alias("begin"))
    placed = stored.join(begins, "row").select("doc_id", "begin", "n", "ids", "key")
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, key long")
