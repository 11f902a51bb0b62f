"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Every executor task loads the rank file from ``ranks_path`` (a file that each
node has) and encodes whole texts. tiktoken splits a text with
the pattern and merges inside each match. A long text is first cut at safe
boundaries: before ASCII white space that follows a character that is no white
space. No match of the pattern holds such a pair, and no part of the
pattern looks back, so the pieces' ids joined are the ids of the whole text;
each call gets a bounded piece however long the text is. A run of over ``GAP_CHARS`` white
space characters has no such place and is too long for the pattern's search: by the
pattern it is one match, without its last character where another follows, and goes to
the merges directly. Decoding joins the tokens' raw bytes, so a token that ends inside a
character does no harm.

Defined results: null and empty texts have no ids; a text without any safe
boundary is one piece; repeated rows and equal ids give a row each; other
columns of the input are not looked at; an empty table gives an empty table.
Bytes that are not UTF-8 are replaced as Spark's readers would print them.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import id_text, lists, map_text, texts_of

SAFE = re.compile(r"(?<=\S)(?=[\x20\x09-\x0D])")
PIECE_CHARS = 16_384
GAP_CHARS = 10_000
#: The characters of the pattern's white space class.
LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % GAP_CHARS)


def load_encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("souk", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> list[str]:
    """Consecutive pieces of ``text``, each cut at the first safe boundary after ``piece_chars``."""
    if len(text) <= piece_chars:
        return [text] if text else []
    pieces, at = [], 0
    while at < len(text):
        m = SAFE.search(text, at + piece_chars) if at + piece_chars < len(text) else None
        end = m.start() if m else len(text)
        pieces.append(text[at:end])
        at = end
    return pieces


def encode_whole(encoding, text: str, piece_chars: int = PIECE_CHARS) -> list[int]:
    ids: list[int] = []
    at = 0
    for gap in LONG_GAP.finditer(text) if len(text) >= GAP_CHARS else ():
        for piece in safe_pieces(text[at:gap.start()], piece_chars):
            ids += encoding.encode_ordinary(piece)
        # the pattern leaves the last character to what follows
        at = gap.end() if gap.end() == len(text) else gap.end() - 1
        ids += encoding._encode_single_piece(text[gap.start():at])
    for piece in safe_pieces(text[at:], piece_chars):
        ids += encoding.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, ranks_path: str, pattern: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, ids (array of int) of every row."""
    def step():
        encoding = load_encoding(ranks_path, pattern)

        def of(batch):
            ids = [np.asarray(encode_whole(encoding, t, piece_chars), dtype=np.int32) for t in texts_of(batch.column(1))]
            return {"doc_id": batch.column(0), "ids": lists(ids)}
        return of
    return map_text(id_text(docs), "doc_id long, ids array<int>", step)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, data (the bytes of the ids) of every row."""
    def step():
        encoding = load_encoding(ranks_path, pattern)

        def of(batch):
            data = [encoding.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "data": pa.array(data, pa.binary())}
        return of
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return map_text(rows, "doc_id long, data binary", step)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode every row in one pass,
    for digests of both without a shuffle or a stored copy of the ids."""
    def step():
        encoding = load_encoding(ranks_path, pattern)
        decimal = [str(i).encode() for i in range(encoding.n_vocab)]

        def of(batch):
            count, ids_sha, data_sha = [], [], []
            for text in texts_of(batch.column(1)):
                ids = encode_whole(encoding, text, piece_chars)
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
                data_sha.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            return {"doc_id": batch.column(0), "n_tokens": pa.array(count, pa.int64()),
                    "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(data_sha, pa.string())}
        return of
    return map_text(id_text(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", step)
