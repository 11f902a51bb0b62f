"""Ranked lexical search: hybrid term-at-a-time / document-at-a-time evaluation.

Terms are runs of characters other than ASCII controls, blanks and punctuation, with
A-Z lower-cased. A document's score for a query is the sum, over the query's terms
(repeats included), of w * ((10^9 tf) div (1000 tf + 12 m)): w is the term's weight
floor(1000 ln((2N + 2) / (2df + 1))), m = 100 - 25 + ((25 n N) div L) the document's
length against the mean; all in 64-bit integers.

The index is partitioned by documents: a pass over the whole texts stores, for each
document, its length and the occurrences of the queries' terms. A task reads its
documents in shards of at most ``SHARD`` and inverts each shard's lists. For a query

* lists of at most a sixteenth of the shard are short: their contributions are summed
  into accumulators term at a time;
* the accumulators then are one more list, with a bound for each block of documents,
  beside the long lists; blocks are visited in document order, skipped where the bounds
  of all lists add up to less than the ``k``-th best score so far, and evaluated
  document by document otherwise.

Every task returns its ``k`` best for each query; the best of those are the result. The
queries come in blocks of about ``block_chars`` characters, one pass over the documents
for each, so what is broadcast does not grow with their number.

Defined results: null and empty texts have no term: such a document is never found and
does not count in N, such a query finds nothing; every row is a document or a query of
its own, repeated ones too; equal scores go by ascending doc_id, null first; other
columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.llm.common import id_text, int64, lists, scratch_table, slices

SHARD = 4096
BLOCK = 128
PART_BYTES = 1 << 20

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Letters, digits and all bytes of characters beyond ASCII stay, A-Z lower-cased; the rest are blanks.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    return data.translate(TERM_BYTES).split()


def term_parts(data: bytes, most: int = PART_BYTES):
    """Lists of the terms of consecutive parts of a text, so that a very long one is bounded too."""
    data = data.translate(TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most) if len(data) - at > most else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


# --------------------------------------------------------------------- queries
def query_blocks(items: DataFrame, block_chars: int) -> int:
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // block_chars))


def query_block(items: DataFrame, n: int, of: int) -> list[tuple]:
    """(item_id, [(term, repeats)]) of the items of block ``n``."""
    rows = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(of)) == n) if of > 1 else items
    rows = rows.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).collect()
    return [(r["item_id"], sorted(Counter(terms(bytes(r["text"]))).items())) for r in rows if r["text"] is not None]


# ----------------------------------------------------------------------- index
def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms of the text), terms, tfs (of the ``vocabulary``, a broadcast map of term to
    number) of every row."""
    def run(batches):
        known = vocabulary.value
        get, size = known.get, max(1, len(known))
        for batch in slices(batches):
            n, keys = [], []
            for d, text in enumerate(batch.column(1)):
                count, found = 0, []
                for part in term_parts(text.as_py() or b""):
                    count += len(part)
                    found += [x for x in map(get, part) if x is not None]
                n.append(count)
                keys.append(np.array(found, np.int64) + d * size)
            keys, tfs = np.unique(np.concatenate(keys), return_counts=True)
            ends = np.searchsorted(keys // size, np.arange(len(n)), "right")
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n": int64(n), "terms": lists(np.split((keys % size).astype(np.int32), ends[:-1])),
                "tfs": lists(np.split(tfs.astype(np.int32), ends[:-1]))})
    return id_text(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_frequencies(stored: DataFrame, size: int) -> dict[int, int]:
    """Documents holding each term of the vocabulary: a count from each task, added up."""
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held.astype(np.int32)), "df": int64(df[held])})
    rows = stored.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


class Shard:
    """The inverted lists of some documents: documents and contributions of each term."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, total: int):
        self.size = len(n)
        self.starts = np.arange(0, self.size, BLOCK)
        m = 100 - 25 + (25 * n * docs) // max(1, total)
        doc = np.repeat(np.arange(self.size), np.diff(offsets))
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
        self.gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        self.cut = np.searchsorted(term, np.arange(len(weight) + 1))
        self.known: dict[int, tuple] = {}

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cut[t], self.cut[t + 1]
        return self.doc[a:b], self.gain[a:b]

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each block of documents begins in the term's list, and the block's greatest gain."""
        if t not in self.known:
            doc, gain = self.postings(t)
            dense = np.zeros(self.size, np.int64)
            dense[doc] = gain
            self.known[t] = np.append(np.searchsorted(doc, self.starts), len(doc)), np.maximum.reduceat(dense, self.starts)
        return self.known[t]


class Best:
    """The ``k`` best documents so far: score, whether doc_id is null, doc_id."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, np.empty((0, 3), np.int64), 1

    def add(self, score: np.ndarray, null: np.ndarray, doc_id: np.ndarray) -> None:
        good = score >= self.least
        if good.any():
            rows = np.concatenate([self.rows, np.stack([score[good], null[good], doc_id[good]], axis=1)])
            self.rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], -rows[:, 0]))][:self.k]
            if len(self.rows) == self.k:
                self.least = int(self.rows[-1, 0])


def rank(shard: Shard, query: list[tuple[int, int]], best: Best, null: np.ndarray, doc_id: np.ndarray) -> int:
    """Add the shard's documents to ``best``; the number of blocks that were evaluated."""
    short, long_ = [], []
    for t, repeats in query:
        size = int(shard.cut[t + 1] - shard.cut[t])
        if size:
            (short if 16 * size <= shard.size else long_).append((t, repeats))
    # term at a time: the short lists become one list of accumulators
    accumulated = np.zeros(shard.size, np.int64)
    for t, repeats in short:
        doc, gain = shard.postings(t)
        accumulated[doc] += repeats * gain
    bound = np.maximum.reduceat(accumulated, shard.starts)
    cursors = []
    for t, repeats in long_:
        at, most = shard.blocks(t)
        bound += repeats * most
        cursors.append((at, *shard.postings(t), repeats))
    # document at a time, skipping blocks that cannot reach the k-th best
    visited = 0
    for b in range(len(shard.starts)):
        if bound[b] < best.least:
            continue
        visited += 1
        lo = b * BLOCK
        score = accumulated[lo:lo + BLOCK].copy()
        for at, doc, gain, repeats in cursors:
            x, y = at[b], at[b + 1]
            if y > x:
                score[doc[x:y] - lo] += repeats * gain[x:y]
        best.add(score, null[lo:lo + BLOCK], doc_id[lo:lo + BLOCK])
    return visited


# ---------------------------------------------------------------------- search
def _search_block(docs: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, counted in queries for t, _ in counted}))}
    stored = scratch_table(postings(docs, spark.sparkContext.broadcast(vocabulary)), "search-postings")
    found = stored.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("total")).first()
    n_docs, total = found["docs"], found["total"] or 0
    weight = np.zeros(len(vocabulary), np.int64)
    for t, df in document_frequencies(stored, len(vocabulary)).items():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    numbered = [(item, [(vocabulary[t], c) for t, c in counted]) for item, counted in queries]
    shared = spark.sparkContext.broadcast((numbered, weight))

    def run(batches):
        asked, weights = shared.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                # a list column's flatten() and offsets follow the slice
                offsets = part.column(2).offsets.to_numpy()
                shard = Shard(part.column(1).to_numpy(), offsets, part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy(), weights, n_docs, total)
                ids = part.column(0)
                null, doc_id = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
                for (_, query), b in zip(asked, best):
                    rank(shard, query, b, null, doc_id)
        for number, ((item, _), b) in enumerate(zip(asked, best)):
            if len(b.rows):
                yield pa.RecordBatch.from_pydict({
                    "number": pa.array([number] * len(b.rows), pa.int32()), "item_id": pa.array([item] * len(b.rows), pa.int64()),
                    "doc_id": pa.array(b.rows[:, 2], mask=b.rows[:, 1] > 0), "score": pa.array(b.rows[:, 0])})
    tops = stored.mapInArrow(run, "number int, item_id long, doc_id long, score long")
    order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_chars: int = 1_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` best documents with a score above 0 for
    every row of ``items`` (item_id, text)."""
    of = query_blocks(items, block_chars)
    return reduce(DataFrame.unionByName, [_search_block(docs, query_block(items, n, of), k) for n in range(of)])
