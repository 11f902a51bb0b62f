import hashlib
import random

import public_tokenizers
import pytest

from souk.llm import bpe, queries

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoding():
    return bpe.load_encoding(FILE, PATTERN)


def test_pieces_at_safe_boundaries_give_the_ids_of_the_whole(encoding):
    rnd = random.Random(2)
    parts = ["a", "Word", "é", "12", " ", "  ", "\n", "\n\n", ".", "!!", "'s", "\t", "\xa0", "\x1c", " ", "日本", "́", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        pieces = bpe.safe_pieces(text, 5)
        assert "".join(pieces) == text
        assert bpe.encode_whole(encoding, text, 5) == encoding.encode_ordinary(text)


def test_long_texts(encoding):
    for text in ("word " * 40_000, "x" * 60_000, " " * 50_000, "\n \t" * 20_000):
        ids = bpe.encode_whole(encoding, text)
        assert ids == encoding.encode_ordinary(text) and encoding.decode_bytes(ids).decode() == text
    assert max(map(len, bpe.safe_pieces("word " * 40_000))) < 2 * bpe.PIECE_CHARS


def test_query_against_the_library(spark, encoding):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = encoding.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_encode_then_decode(spark, odd, empty):
    encoded = bpe.encode(odd, FILE, PATTERN)
    back = bpe.decode(encoded, FILE, PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["data"]).decode()) for r in back) == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert bpe.encode(empty, FILE, PATTERN).collect() == [] and bpe.decode(bpe.encode(empty, FILE, PATTERN), FILE, PATTERN).collect() == []
    rows = bpe.round_trip(odd, FILE, PATTERN).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert bpe.round_trip(empty, FILE, PATTERN).collect() == []


def test_very_long_white_space(spark):
    encoding = bpe.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    gaps = [" " * 12_000, "\n" * 15_000, " \n\t\xa0\u3000" * 3_000, " " * 11_000 + "\n"]
    for gap in gaps:
        for text in (gap, "a" + gap, gap + "b", "a." + gap + "'s 1", "x" + gap + "\u00e9" + gap + "!", gap + "\x1c" + gap):
            assert bpe.encode_whole(encoding, text) == encoding.encode_ordinary(text)
    # the library alone cannot take this one
    text = "start" + " " * 1_500_000 + "end" + "\n" * 1_200_000
    ids = bpe.encode_whole(encoding, text)
    assert encoding.decode(ids) == text
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()[0]["n_tokens"] == len(ids)
