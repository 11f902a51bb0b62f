import numpy as np

from souk.llm import simhash
from tests_llm_brute import brute_classes, brute_fingerprint

SF = "/root/testdata/sf0.01"


def ball(seed, n, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size=4, dtype=np.uint64)
    out = set()
    for _ in range(n):
        x = int(base[rng.integers(0, 4)])
        for _ in range(rng.integers(0, flips + 1)):
            x ^= 1 << int(rng.integers(0, 64))
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def test_trie_join_equals_brute_force():
    for seed, n, flips in ((1, 60, 3), (2, 300, 7), (3, 900, 2), (4, 200, 20)):
        keys = ball(seed, n, flips)
        for bits in (0, 1, 4):
            label = simhash.trie_links(keys, np.array([[0, len(keys), 0, len(keys)]]), np.array([0]), bits)
            assert (label == brute_classes(keys, bits)).all()


def test_trie_join_of_two_nodes_links_only_across():
    left, right = np.array([0b0000, 0b0001], np.uint64), np.array([0b0011, 3 << 59], np.uint64)
    keys = np.concatenate([left, right])
    label = simhash.trie_links(keys, np.array([[0, 2, 2, 4]]), np.array([0]), 1)
    assert label.tolist() == [0, 1, 1, 3]


def test_fingerprint_of_odd_texts():
    for text in (None, "", "  \n", "one", "One two", "a b c d e f g A B C D", "É é x y z", "same " * 50):
        assert simhash.fingerprint((text or "").encode(), 4, 42) == brute_fingerprint(text)


def test_long_text_in_blocks():
    data = " ".join(f"w{i % 700}" for i in range(5000)).encode()
    assert simhash.fingerprint(data, 4, 42, block=64) == simhash.fingerprint(data, 4, 42)


def test_components_equal_brute_force_with_and_without_split_keys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_classes(fps, 4)
    want = {rows[i][0]: (fps[i], rows[label[i]][0]) for i in range(len(rows))}
    for cap in (1024, 3):
        got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.components(docs, cap=cap).collect()}
        assert got == want


def test_split_dense_group(spark):
    keys = ball(7, 400, 3).view(np.int64).tolist()
    fps = spark.createDataFrame([(i, f) for i, f in enumerate(keys)], "doc_id long, fp long")
    label = brute_classes(np.array(keys).view(np.uint64), 4)
    for whole, cap in ((1, 16), (2, 16), (3, 1024), (4, 64)):
        found = {r["node"]: r["root"] for r in simhash.classes(simhash.links(fps, 4, cap, whole)).collect()}
        for i, f in enumerate(keys):
            same = {keys[j] for j in np.flatnonzero(label == label[i])}
            assert found.get(f, f) == min(same)


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.blocks_for(n, 4) for n in (0, 200_000, 20_000_000, 10**10, 10**12)] == [1, 1, 2, 3, 4]
    for whole in (1, 2, 3):
        cuts = simhash.blocks(4, whole)
        assert sum(w for _, w in cuts) == 64 and len(cuts) == 4 + whole
        fp = np.array([0x0123456789ABCDEF, 2**64 - 1, 0], np.uint64)
        for chosen in simhash.block_sets(4, whole):
            out = simhash.turned(fp, cuts, chosen)
            assert (np.bitwise_count(out) == np.bitwise_count(fp)).all() and out[1] == fp[1]


def test_odd_rows(spark, odd, empty):
    got = simhash.components(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9]["component_id"] == by_id[1]["component_id"] == 1
    assert by_id[2]["fp"] == by_id[3]["fp"] == by_id[6]["fp"] == 0
    assert {by_id[i]["component_id"] for i in (2, 3, 6)} == {2}
    assert simhash.components(empty).collect() == []


def test_representatives_keep_columns_and_one_row_of_each_class(spark, odd, empty):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 9 not in ids and 3 not in ids and 2 in ids
    assert simhash.representatives(empty).count() == 0


def test_classes_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.classes(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_representatives_where_doc_ids_repeat(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(3, a, "en"), (5, a, "en"), (5, b, "en"), (7, b, "en"), (9, "fifteen " + a[4:] + " more words", "fr"), (9, "fifteen " + a[4:] + " more words", "en"), (None, b, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for part in (df, df.repartition(5), df.orderBy("lang")):
        assert sorted(map(tuple, simhash.representatives(part).collect())) == [(3, a, "en"), (5, b, "en"), (9, "fifteen " + a[4:] + " more words", "en")]
    alone = spark.createDataFrame([(None, b, None), (None, b, "en")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in simhash.representatives(alone).collect()] == [(None, b, "en")]


def test_representatives_shuffle_texts_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        plan = simhash.representatives(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    above_join = plan[:plan.index("SortMergeJoin")]
    assert "Exchange" not in above_join
