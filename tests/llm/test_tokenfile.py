import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from souk.llm import queries, tokenfile
from souk.llm.common import scratch_dir

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert (tokenfile.from_planes(tokenfile.to_planes(ids, planes), n) == ids).all()


@pytest.mark.parametrize("planes,chunk_ids", [("byte", 3), ("bit", 5), ("byte", 1 << 16)])
def test_file_round_trip(planes, chunk_ids):
    docs = [(None, []), (-5, [1, 2, 3]), (0, []), (7, list(range(50_000, 50_040))), (7, [9])]
    data = tokenfile.pack(3, 4, [d for d, _ in docs], [len(x) for _, x in docs], np.array(sum((x for _, x in docs), []), np.uint32), planes, chunk_ids)
    got = [(d, ids.tolist()) for d, _, ids in tokenfile.documents(data)]
    assert got == docs
    index = tokenfile.index_of(data)
    assert (index["part"], index["number"], index["ids"]) == (3, 4, 44)
    with pytest.raises(ValueError):
        tokenfile.index_of(data[:-1])


def test_encoder_equals_the_library_on_odd_texts(tokenizer):
    rnd = random.Random(0)
    parts = ["a", "b", "Word", "é", "ñ", "1", "23", " ", "  ", "\n", "\n\n", ".", ",", "!!", "'s", "'", '"', "|", "\t", "\xa0", "\x1c", "###", "-", "_",
             "日本", "́", " \n", "٣", "<|endoftext|>", "\r", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["", "z" * 5000]
    encoder = tokenfile.PieceEncoder(FILE, kept=300)
    for at in range(0, len(texts), 500):
        got = encoder.encode(texts[at:at + 500])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole(tokenizer, t) for t in texts[at:at + 500]]


def test_added_tokens_get_their_ids_as_in_the_unchanged_library(spark):
    library = Tokenizer.from_file(FILE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y.", "two\nlines <|endoftext|>\nthree", "plain text", "<|endoftext", None]
    path = scratch_dir(spark, "test-tokens")
    tokenfile.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, FILE)
    check(tokenfile.read_digests(spark, path).collect(), list(enumerate(texts)), library)
    ids = {r["doc_id"]: r["ids"] for r in tokenfile.read(spark, path).collect()}
    assert ids[0] == [64, 220, 50256, 275, 0]
    rnd = random.Random(3)
    parts = ["a", " Word", "é", "1", " ", "\n", ".", "!!", "<|endoftext|>", "<|endof", "text|>", "\t"]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(2000)]
    got = tokenfile.PieceEncoder(FILE, kept=300, added_tokens=True).encode(odd)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole(library, t) for t in odd]


def check(rows, docs, tokenizer):
    at = 0
    got = sorted(rows, key=lambda r: r["start"])
    assert len(got) == len(docs)
    for r, (doc_id, text) in zip(got, docs):
        ids = [*whole(tokenizer, text), 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_query_against_the_library(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    check(queries.op7_token_file(spark, sf).collect(), docs, tokenizer)


def test_small_files_and_bit_planes(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = scratch_dir(spark, "test-tokens")
    tokenfile.write(docs, path, FILE, planes="bit", file_ids=5_000, chunk_ids=777)
    check(tokenfile.read_digests(spark, path).collect(), sorted((r["doc_id"], r["text"]) for r in docs.collect()), tokenizer)
    ids = {r["doc_id"]: r["ids"] for r in tokenfile.read(spark, path).collect()}
    assert ids == {r["doc_id"]: [*whole(tokenizer, r["text"]), 0] for r in docs.collect()}


def test_odd_rows(spark, odd, empty, odd_rows, tokenizer):
    path = scratch_dir(spark, "test-tokens")
    tokenfile.write(odd, path, FILE)
    rows = tokenfile.read_digests(spark, path).collect()
    docs = sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0))
    check(rows, docs, tokenizer)
    nothing = scratch_dir(spark, "test-tokens")
    tokenfile.write(empty, nothing, FILE)
    assert tokenfile.read_digests(spark, nothing).collect() == [] and tokenfile.read(spark, nothing).collect() == []
