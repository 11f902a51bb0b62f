import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from souk.llm import packing, queries
from souk.llm.words import WordTable

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_steps_of_one(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = packing.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_encoder_equals_the_library(tokenizer):
    rnd = random.Random(0)
    parts = ["a", "b", "Word", "WORD", "é", "É", "ñ", "1", "23", " ", "  ", "\n", ".", ",", "!!", "'s", "'", '"', "|", "\t", "\xa0", "\x1c", "###", "-", "_", "日本", "́",
             "٣", "<|endoftext|>", "<|startof", "text|>", "\r", "İ", "ŉ", "ß", "Σ", "ſ", "\x0b", "　", "ﬁ", "µ", "Å"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["", "z" * 5000, "tail." * 3]
    encoder = packing.BlankEncoder(FILE, kept=300)
    for at in range(0, len(texts), 500):
        counts, ids = encoder.flat([t.encode() for t in texts[at:at + 500]])
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [whole(tokenizer, t)[:-1] for t in texts[at:at + 500]]


def test_word_table_forgets_long_and_late_words():
    asked = []

    def encode(words):
        asked.extend(words)
        return [[len(w), 7] for w in words]
    table = WordTable(encode, kept=3, kept_chars=5)
    for words in (["a", "bb", "longer word"], ["a", "longer word"], ["c", "dd"], ["a"]):
        counts, ids = table.ids(pa.array([words, []]))
        assert counts.tolist() == [2 * len(words), 0] and ids.tolist() == sum(([len(w), 7] for w in words), [])
    assert asked == ["a", "bb", "longer word", "longer word", "c", "dd"] and set(table.row) == {"a", "bb", "c"}


def check(rows, docs, tokenizer, length):
    """Every id in one piece, gapless sequences of ``length`` or of a power of two."""
    want = sorted(((d is not None, d or 0), whole(tokenizer, t)) for d, t in docs)
    by_sequence, pieces = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"] is not None, r["doc_id"] or 0), []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at == length or at < length and at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)
    for doc, ids in want:
        found = [r for r in pieces[doc] if r["doc_tokens"] == len(ids)]
        starts = {}
        for r in found:
            starts.setdefault(r["start"], []).append(r)
        at = 0
        while at < len(ids):  # a copy of each piece; repeated rows have their own cuts
            fits = [r for r in starts[at] if zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
            assert fits
            at += fits[0]["length"]


def test_query_against_the_library(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.op13_packing(spark, sf)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = df.collect()
    check(rows, docs, tokenizer, 4096)
    total = sum(r["length"] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert sum(s == 4096 for s in sizes.values()) == total // 4096


def test_neighbours_on_the_curve_are_alike(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = packing.pack(docs, FILE, 2).collect()
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    assert len(order) == len(lang)
    same = np.mean([lang[a] == lang[b] for a, b in zip(order, order[1:])])
    shares = np.unique([str(x) for x in lang.values()], return_counts=True)[1] / len(lang)
    assert same > 0.7 > 1.5 * (shares ** 2).sum()
    # the order of the pieces is the order of the keys
    keys = [r["key"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert keys == sorted(keys)


def test_odd_rows(spark, odd, empty, odd_rows, tokenizer):
    docs = [(r[0], r[1]) for r in odd_rows]
    for length in (4096, 64, 7):
        from pyspark.sql import functions as F
        rows = packing.pack(odd, FILE, 2, length=length).withColumn("ids_crc32", F.crc32("ids")).collect()
        if length != 7:
            check(rows, docs, tokenizer, length)
        assert {r["sequence_id"] for r in rows} == set(range(max(r["sequence_id"] for r in rows) + 1))
    assert packing.pack(empty, FILE, 2).collect() == []


def test_tail_sizes():
    assert [packing.tail_sizes(n) for n in (0, 1, 6, 4095)] == [[], [1], [4, 2], [1 << b for b in range(11, -1, -1)]]
