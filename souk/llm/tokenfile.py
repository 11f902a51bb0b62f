"""Token-ID files: bit-plane shuffled ids, zstandard planes, a chunk index.

File format (little-endian). A file holds whole documents, in order:

    magic  b"SOUKPL1\\n"
    planes of chunk 0, planes of chunk 1, ...    zstandard frames
    index  a zstandard frame of int64: part, number, n_documents, n_ids,
           chunk_ids, n_planes; the doc_ids (null: the least int64); the
           documents' id counts; for each chunk its plane lengths in bytes
    tail   uint64 length of the index frame, b"SOUKPL1\\n"

A chunk is a block of ``chunk_ids`` ids (the last may be shorter) that does not
care about document ends. It is transposed into 4 byte planes (``planes="byte"``:
first all lowest bytes, ...) or 32 bit planes (``planes="bit"``), each compressed
by itself: the high planes are nearly constant and vanish. With the index a
reader can decode any document from the chunks that hold it.

Writing: documents are range-partitioned and sorted by doc_id (null first, ties
by a hash of the text), each task encodes its range and cuts it into files of about
``file_ids`` ids, each a row that Spark's text sink writes to a file of its own
on the shared store. ``part`` and ``number`` order the files. Reading: Spark's
binaryFile source, one file at a time in a task; a document's global start is
its start in the file plus a two-level running sum of the files' sizes.

Encoding uses the tokenizers library. A text is cut at its single spaces and
line breaks and before the marks that end a word, where a token always ends; each
distinct word of a slice is looked up once, and the ids of words met before are kept in
a bounded table of the Python worker. A text that holds one of the file's added tokens
or other white space goes to the library whole.

Defined results: null text counts as empty: only the end id; repeated rows are
written each; other columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.llm.common import int64, scratch_table, slices, texts_of, width
from souk.llm.words import WordTable, byte_alphabet, letters_and_marks, with_end

MAGIC = b"SOUKPL1\n"
CHUNK_IDS = 1 << 16
FILE_IDS = 1 << 22
NULL_ID = -(1 << 63)


# ---------------------------------------------------------------------- codec
def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    by_bit = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(by_bit[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        by_bit = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(by_bit, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack(part: int, number: int, doc_ids: list, counts: list[int], ids: np.ndarray, planes: str = "byte",
         chunk_ids: int = CHUNK_IDS, level: int = 3) -> bytes:
    """A whole file."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level).compress
    body, lengths = [MAGIC], []
    for at in range(0, len(ids), chunk_ids):
        frames = [squeeze(p) for p in to_planes(ids[at:at + chunk_ids], planes)]
        body += frames
        lengths += map(len, frames)
    head = [part, number, len(doc_ids), len(ids), chunk_ids, 4 if planes == "byte" else 32]
    index = squeeze(np.array([*head, *(NULL_ID if d is None else d for d in doc_ids), *counts, *lengths], dtype="<i8").tobytes())
    return b"".join([*body, index, len(index).to_bytes(8, "little"), MAGIC])


def index_of(data: bytes) -> dict:
    """The index of a file given as bytes; ``starts`` are the chunks' first bytes."""
    import zstandard

    if not data.startswith(MAGIC) or not data.endswith(MAGIC):
        raise ValueError("not a token file")
    size = int.from_bytes(data[-16:-8], "little")
    numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[len(data) - 16 - size:-16]), "<i8")
    part, number, docs, ids, chunk_ids, planes = map(int, numbers[:6])
    lengths = numbers[6 + 2 * docs:].reshape(-1, planes)
    ends = np.cumsum(lengths.sum(axis=1))
    return {"part": part, "number": number, "ids": ids, "chunk_ids": chunk_ids, "doc_ids": numbers[6:6 + docs],
            "counts": numbers[6 + docs:6 + 2 * docs], "lengths": lengths, "starts": len(MAGIC) + np.concatenate([[0], ends[:-1]]).astype(np.int64)}


def chunk(data: bytes, index: dict, k: int) -> np.ndarray:
    """The ids of chunk ``k``."""
    import zstandard

    loosen = zstandard.ZstdDecompressor().decompress
    at, planes = int(index["starts"][k]), []
    for length in index["lengths"][k].tolist():
        planes.append(loosen(data[at:at + length]))
        at += length
    return from_planes(planes, min(index["chunk_ids"], index["ids"] - k * index["chunk_ids"]))


def documents(data: bytes):
    """(doc_id, start in the file, ids) of every document, decoding a chunk at a time."""
    index = index_of(data)
    held, at, k = np.empty(0, np.uint32), 0, 0
    for doc_id, count in zip(index["doc_ids"].tolist(), index["counts"].tolist()):
        parts = [held]
        have = len(held)
        while have < count:
            parts.append(chunk(data, index, k))
            have += len(parts[-1])
            k += 1
        joined = np.concatenate(parts) if len(parts) > 1 else held
        yield (None if doc_id == NULL_ID else doc_id), at, joined[:count]
        held = joined[count:]
        at += count


# ------------------------------------------------------------------- encoding
class PieceEncoder:
    """uint32 ids of whole texts by their words (``words.WordTable``).

    A text is cut before its single spaces and line breaks: the tokenizer's pattern always
    ends a match there. A word of letters is one match, and so are the marks that end it; the
    library's model merges them. Other words go to the library in whole batches. ``kept`` words
    stay in the table, those of up to ``kept_chars`` characters. With ``added_tokens`` the
    file's added tokens in a text get their own ids, as the library loads it; without, they
    are encoded like other text."""

    DOUBLE = ("  ", "\n\n", " \n", "\n ")
    OTHER_GAP = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
    ASCII_GAPS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"

    def __init__(self, path: str, kept: int = 700_000, kept_chars: int = 40, added_tokens: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # with added tokens the tokenizer stays as the library loads it
        if not added_tokens:
            self.tokenizer.encode_special_tokens = True
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        self.added = sorted(t.content for t in added)
        (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.ends: dict[str, list[int]] = {"": []}
        self.table = WordTable(self.words, kept, kept_chars)

    @classmethod
    def of_worker(cls, path: str) -> PieceEncoder:
        """The Python worker's encoder for a file: its tasks share the table."""
        import tokenizers

        encoders = tokenizers.__dict__.setdefault("souk_encoders", {})
        if path not in encoders:
            encoders[path] = cls(path, added_tokens=True)
        return encoders[path]

    def odd(self, text: str) -> bool:
        """Whether a text has an added token, or white space other than single spaces and line
        breaks inside."""
        if text[0] in " \n" or text[-1] in " \n":
            return True
        for token in self.added:
            if token in text:
                return True
        for gap in self.DOUBLE:
            if gap in text:
                return True
        if text.isascii():
            for gap in self.ASCII_GAPS:
                if gap in text:
                    return True
            return False
        return self.OTHER_GAP.search(text) is not None

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def pieces(self, texts: list[str], at_once: int = 256) -> list[list[int]]:
        """Ids of pieces without line breaks, many in one text: a line break between two
        pieces is always a token of its own, so that it tells their ids apart."""
        joined = ["\n".join(texts[i:i + at_once]) for i in range(0, len(texts), at_once)]
        out = []
        for ids in self.plain(joined) if texts else []:
            for part in np.split(ids, np.flatnonzero(ids == self.line_break)):
                out.append(part[1:].tolist() if len(part) and part[0] == self.line_break else part.tolist())
        return out

    def match(self, text: str) -> list[int]:
        """Ids of a text that is one match of the pattern."""
        return [t.id for t in self.merge(text if text.isascii() and text[0] != " " else text.encode().decode("latin-1").translate(self.alphabet))]

    def words(self, keys: list[str]) -> list[list[int]]:
        """Ids of words without their space; a word that begins a line has the line break."""
        out: list[list[int] | None] = []
        other, at = [], []
        near: dict[str, list[int]] = {}
        for n, key in enumerate(keys):
            line = key[:1] == "\n"
            word = key[1:] if line else key
            split = letters_and_marks(word)
            if split is None:
                other.append(word if line else " " + word)
                at.append((n, line))
                out.append(None)
                continue
            core, tail = split
            whole = key[:len(key) - len(tail)]
            ids = near.get(whole) or self.table.known(whole)
            if ids is None:
                ids = near[whole] = [self.line_break, *self.match(core)] if line else self.match(" " + core)
            if tail not in self.ends:
                if len(self.ends) > 10_000:
                    self.ends = {"": []}
                self.ends[tail] = self.match(tail)
            out.append(ids + self.ends[tail])
        for (n, line), ids in zip(at, self.pieces(other)):
            out[n] = [self.line_break, *ids] if line else ids
        return out

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in turn."""
        odd = [n for n, text in enumerate(texts) if not text or self.odd(text)]
        # the first word follows no line break: it gets one, whose id goes
        start, none = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        lined = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n")
        lined = pc.binary_join_element_wise(start, lined, none)
        if odd:
            keep = np.ones(len(texts), bool)
            keep[odd] = False
            lined = lined.filter(pa.array(keep))
        counts, ids = self.table.ids(pc.split_pattern(lined, " "))
        first = np.ones(len(ids), bool)
        first[(np.cumsum(counts) - counts)] = False
        counts, ids = counts - 1, ids[first]
        if not odd:
            return counts, ids
        by_text: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for n, part in zip(np.flatnonzero(keep).tolist(), np.split(ids, np.cumsum(counts)[:-1])):
            by_text[n] = part
        whole = [n for n in odd if texts[n]]
        for n, part in zip(whole, self.plain([texts[n] for n in whole])):
            by_text[n] = part
        return np.array([len(x) for x in by_text], np.int64), np.concatenate([*by_text, np.empty(0, np.uint32)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        counts, ids = self.flat(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


# ------------------------------------------------------------ writing, reading
def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, planes: str = "byte", file_ids: int = FILE_IDS,
          chunk_ids: int = CHUNK_IDS) -> None:
    """Write the ids of all texts, ``end_id`` after each, to files below ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)
    def run(batches):
        encoder = PieceEncoder.of_worker(tokenizer_path)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, counts, held, size = [], [], [], 0

        def file():
            return pa.RecordBatch.from_pydict({"data": pa.array([pack(part, number, doc_ids, counts, np.concatenate(held), planes, chunk_ids)], pa.binary())})
        for batch in slices(batches, 6_000_000):
            sizes, ids = with_end(*encoder.flat(texts_of(batch.column(1))), end_id)
            at = 0
            # a file ends with the document that fills it
            ends, batch_ids = np.cumsum(sizes), batch.column(0).to_pylist()
            while at < len(sizes):
                begin = ends[at] - sizes[at]
                to = min(len(sizes), int(np.searchsorted(ends, begin + file_ids - size)) + 1)
                doc_ids += batch_ids[at:to]
                counts += sizes[at:to].tolist()
                held.append(ids[begin:ends[to - 1]])
                size += len(held[-1])
                at = to
                if size >= file_ids:
                    yield file()
                    doc_ids, counts, held, size = [], [], [], 0
                    number += 1
        if doc_ids:
            yield file()
    files = rows.mapInArrow(run, "data binary")
    # the text sink writes a string's bytes as they are, and a line end
    files.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, number, doc_id, start (in its file), ids of every document below ``path``."""
    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()[:-1]  # without the sink's line end
                index = index_of(data)
                rows = []
                for row in documents(data):
                    rows.append(row)
                    if len(rows) == 512:
                        yield columns(index, rows)
                        rows = []
                if rows:
                    yield columns(index, rows)

    def columns(index, rows):
        n = len(rows)
        ends = np.cumsum([0, *(len(ids) for *_, ids in rows)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([ids for *_, ids in rows]).astype(np.int64)))
        return pa.RecordBatch.from_pydict({
            "part": pa.array([index["part"]] * n, pa.int32()), "number": pa.array([index["number"]] * n, pa.int32()),
            "doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": int64([r[1] for r in rows]), "ids": ids})
    return _files(spark, path).mapInArrow(run, "part int, number int, doc_id long, start long, ids array<long>")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter("length > 1").select("content")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32 of every document below ``path``."""
    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()[:-1]
                index = index_of(data)
                doc_ids, starts, crc = [], [], []
                for doc_id, start, ids in documents(data):
                    doc_ids.append(doc_id)
                    starts.append(start)
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = len(crc)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([index["part"]] * n, pa.int32()), "number": pa.array([index["number"]] * n, pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()), "local": int64(starts), "n_tokens": int64(index["counts"]), "ids_crc32": int64(crc)})
    rows = scratch_table(_files(spark, path).mapInArrow(run, "part int, number int, doc_id long, local long, n_tokens long, ids_crc32 long"), "tokenfile-rows")
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    # running sums: over the files of a part, then over the parts (as many as the write had tasks)
    before = F.sum("n").over(W.partitionBy("part").orderBy("number")) - F.col("n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before_part"))
    starts = sizes.select("part", "number", before.alias("before")).join(parts, "part")
    return rows.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("local") + F.col("before") + F.col("before_part")).alias("start"), "n_tokens", "ids_crc32")
