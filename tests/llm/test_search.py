import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from souk.llm import queries, search

RUN = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = [(t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in terms_of(text) if t in df]
        scored = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            s = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, w in asked if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_query_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows_of(got) == brute(docs, items)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(db.execute(queries.ORACLES["op12_search"]).fetchall(), key=str) == rows_of(got)


@pytest.mark.parametrize("shard,block", [(64, 8), (4096, 128)])
def test_shards_blocks_and_ties(spark, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "BLOCK", block)
    rnd = random.Random(2)
    words = ["the", "of", *(f"w{i}" for i in range(60)), "É", "日本", "x_y", "Of", "2"]
    # the first words are in most documents: long lists beside short ones; copies tie
    docs = [(i, " ".join(rnd.choices(words, [30, 20] + [1] * (len(words) - 2), k=rnd.randint(0, 30)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(300)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 8)))) for i in range(20)] + [(50, docs[5][1]), (50, docs[5][1])]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=20, block_chars=200)
    assert rows_of(got) == brute(docs, items)


def test_blocks_are_skipped():
    n = 64 * search.BLOCK
    # term 0 is everywhere, term 1 in one document early on: nothing else can reach its score
    offsets = np.arange(n + 1)
    offsets[4:] += 1
    term = np.zeros(n + 1, np.int64)
    term[4] = 1
    shard = search.Shard(np.full(n, 10), offsets, term, np.ones(n + 1, np.int64), np.array([1, 5000]), n, 10 * n)
    best = search.Best(1)
    ids = np.arange(n)
    assert search.rank(shard, [(0, 1), (1, 1)], best, np.zeros(n, np.int64), ids) < 64
    assert best.rows[0, 2] == 3


def test_a_long_text_is_read_in_parts():
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("aBé-.", k=rnd.randint(1, 9))) for _ in range(5000)).encode()
    want = [t.encode() for t in terms_of(text.decode())]
    assert [t for part in search.term_parts(text, 100) for t in part] == want == search.terms(text)


def test_odd_rows(spark, odd, empty, odd_rows):
    items = [(1, "one SMALL text"), (2, None), (None, "more日本 spaces"), (3, ""), (4, "x" * 120_000), (1, "one SMALL text"), (5, "zzz")]
    asked = spark.createDataFrame([(*r, 1, "clash") for r in items], "item_id long, text string, score int, rank string")
    assert rows_of(search.search(odd, asked)) == brute([(r[0], r[1]) for r in odd_rows], items)
    assert search.search(empty, asked).collect() == [] and search.search(odd, asked.limit(0)).collect() == []
