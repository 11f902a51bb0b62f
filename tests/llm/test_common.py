from pyspark.sql import functions as F

from souk.llm.common import hash_below, labelled_sample


def test_every_label_value_has_its_rows_however_many_there_are(spark):
    n = 70_000_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    assert 25 <= labelled_sample(rows, "lang", 64, {"en": n}).count() <= 110


def test_shares_of_the_hash(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"))
    assert rows.filter(hash_below("x", 1.0)).count() == rows.filter(hash_below("x", 3.0)).count() == 100_000
    assert 24_000 <= rows.filter(hash_below("x", 0.25)).count() <= 26_000
    assert rows.filter(hash_below("x", 1e-12)).count() == 0
