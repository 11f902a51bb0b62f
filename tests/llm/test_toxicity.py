import numpy as np
from pyspark.sql import functions as F

from souk.llm import toxicity


def test_non_negative_risk_recovers_positives_hidden_in_the_unlabelled():
    rng = np.random.default_rng(0)
    n, prior = 1500, 0.2
    truth = np.concatenate([np.ones(300, bool), rng.random(n) < prior])
    positive = np.arange(len(truth)) < 300
    marks = rng.random((len(truth), 6)) < np.where(truth[:, None], 0.45, 0.01)
    noise = rng.random((len(truth), 20)) < 0.3
    rows, cols = np.nonzero(np.concatenate([marks, noise], axis=1))
    weight, bias = toxicity.nnpu_weights(rows, cols, positive, 26, prior, np.zeros(26))
    z = bias + np.bincount(rows, weights=weight[cols], minlength=len(truth))
    guess = z > 0
    assert (guess == truth)[300:].mean() > 0.93
    assert weight[:6].min() > np.abs(weight[6:]).max()


def test_features():
    assert toxicity.features_of("") == set()
    found = toxicity.features_of("Abcdef abcdxy abcdzz abcd")
    assert {"abcdef", "abcd", "abcd*1", "abcd*2", "abcd*3"} <= found and "abcd*4" not in found


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_all(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    caught = sum(r["predicted"] for r in rows if r["toxic"])
    assert caught >= 0.8 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.02 * len(rows)


def test_labels_of_the_held_out_part_and_labelled_zeros_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score_all(docs, x).collect())) for x in (labels, other))
    assert a == b


def test_odd_rows(spark, odd, empty, labels, no_labels):
    got = toxicity.score_all(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == 0 for r in toxicity.score_all(odd, no_labels).collect())
    assert toxicity.score_all(empty, labels).collect() == [] and toxicity.score_all(empty, no_labels).collect() == []
    kept = toxicity.reject(odd, no_labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.reject(empty, labels).collect() == []


def test_reject_drops_what_scores_high(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    high = {r["doc_id"] for r in toxicity.score_all(docs, labels).filter("predicted = 1").collect()}
    kept = {r["doc_id"] for r in toxicity.reject(docs, labels).collect()}
    assert high and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - high
