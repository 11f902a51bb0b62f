import numpy as np

from souk.llm import quality_mil as mil

SF = "/root/testdata/sf0.01"


def test_passages_cover_the_whole_text():
    texts = [b"", b" \n ", b"a bb a a", b"w " * 200, "ñé !!!".encode()]
    x, count = mil.passages(texts)
    assert count.tolist() == [1, 1, 1, 4, 1] and x.shape == (8, mil.WIDTH)
    words = x[:, mil.WIDTH - 1] * mil.PASSAGE_WORDS
    assert words.tolist() == [0, 0, 4, 64, 64, 64, 8, 2]
    distinct, again = x[2, mil.CLASSES + 2], x[2, mil.CLASSES + 3]
    assert abs(distinct - 0.5) < 1e-6 and abs(again - 0.25) < 1e-6


def test_passages_do_not_depend_on_the_batch():
    texts = [b"x", b"One two.\nthree ", b"", b"y " * 100, b"  lead"]
    whole, count = mil.passages(texts)
    alone = np.concatenate([mil.passages([t])[0] for t in texts])
    assert np.allclose(whole, alone)


def test_gradient_lowers_the_loss_and_attention_sums_to_one():
    rng = np.random.default_rng(1)
    count = rng.integers(1, 6, 200)
    x = rng.normal(0, 1, (count.sum(), mil.WIDTH))
    bag = np.repeat(np.arange(200), count)
    y = (np.maximum.reduceat(x[:, 3], np.cumsum(count) - count) > 0.8).astype(float)  # one passage decides
    model = mil.fit(x, count, y, np.ones(200), epochs=60)
    f = mil.forward(model, x, count)
    assert np.allclose(np.bincount(bag, weights=f["a"]), 1)
    assert ((f["score"] > 0.5) == y).mean() > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = mil.score_all(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_labels_of_the_held_out_part_do_not_matter(spark):
    from pyspark.sql import functions as F
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, mil.score_all(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, odd, empty, labels, no_labels):
    got = mil.score_all(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (2, 3)} == {next(r["score"] for r in got if r["doc_id"] == 2)}
    assert {r["score"] for r in mil.score_all(odd, no_labels).collect()} == {0.5}
    assert mil.score_all(empty, labels).collect() == [] and mil.score_all(empty, no_labels).collect() == []
