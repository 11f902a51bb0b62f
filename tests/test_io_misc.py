"""Sources, selectors and small helpers."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from souk.functions import names as N
from souk.operators import compare as C
from souk.operators import indicators as I
from souk.operators import quality as Q
from souk.operators.reshape import pivot_wide
from souk.sources import io


def test_row_index_is_positional(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    got = [(r["k"], r["index"]) for r in io.with_row_index(df, ["k"]).orderBy("index").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3)]


def test_compare_by_position_needs_a_declared_order(spark):
    x = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "s string, v double")
    y = spark.createDataFrame([("b", 3.0), ("a", 1.0)], "s string, v double").repartition(2)
    cells = [(r["__row"], r["variable"], r["value_x"], r["value_y"]) for r in C.compare_tables(x, y, order=["s"]).collect()]
    assert cells == [(2, "v", "2", "3")]
    with pytest.raises(ValueError):
        C.compare_tables(x, y)


def test_row_index_over_several_files(spark):
    folder = tempfile.mkdtemp(prefix="souk-test-")
    spark.range(30_000).repartition(7).write.parquet(f"{folder}/t")
    df = io.with_row_index(spark.read.parquet(f"{folder}/t"), ["id"])
    assert df.where("index <> id + 1").count() == 0 and df.count() == 30_000


def test_table_equals_itself_with_infinities_and_odd_names(spark):
    rows = [(i, float(v), "t") for i, v in enumerate(("inf", "-inf", "nan", "1.5"))]
    x = spark.createDataFrame(rows, "k int, `don't know` double, `back``tick` string")
    assert C.compare_tables(x, x, ["k"]).count() == 0
    y = x.withColumn("don't know", F.when(F.col("k") == 0, float("-inf")).otherwise(F.col("don't know")))
    assert [(r["k"], r["variable"]) for r in C.compare_tables(x, y, ["k"]).collect()] == [(0, "don't know")]
    other = y.drop("back`tick").withColumn("new", F.lit(1))
    summary = {r["item"]: r["value"] for r in C.compare_summary(x, other, ["k"]).collect()}
    assert summary["diff:don't know"] == 1 and summary["only_x:back`tick"] == 1 and summary["only_y:new"] == 1
    far = C.compare_unmatched(x, y.where("k > 0"), ["k"]).collect()
    assert [(r["k"], r["side"]) for r in far] == [(0, "x")]


def test_colliding_names_raise(spark):
    long = spark.createDataFrame([("L", "b__x", 0.5), ("L", "b__x", 0.25), ("M", "b__y", 1.0)], "call_location string, item string, pc double")
    with pytest.raises(Exception, match="collide"):
        pivot_wide(long, "call_location", "item", "pc").collect()
    with pytest.raises(ValueError):
        pivot_wide(long, "call_location", "item", "pc", max_names=1)


def test_drop_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b string, c string")
    assert N.drop_all_null_columns(df).columns == ["a", "c"]


def test_filter_round(spark):
    df = spark.createDataFrame([("A", "2101"), ("B", "2102")], "call_location string, jmmi_date string")
    assert I.filter_round(df).count() == 2
    assert I.filter_round(df, location="A").count() == 1
    assert I.filter_round(df, date="2102").collect()[0]["call_location"] == "B"


def test_sensitive_column_names(spark):
    df = spark.createDataFrame([], "respondent_name string, phone_number string, price double")
    assert sorted(r["variable"] for r in Q.sensitive_columns(df).collect()) == ["phone_number", "respondent_name"]


def test_dated_table_and_bundle_order(spark):
    folder = tempfile.mkdtemp(prefix="souk-test-")
    df = spark.createDataFrame([(1,)], "a int")
    path = io.write_table(df, f"{folder}/log check", fmt="csv", run_date=dt.date(2021, 6, 9))
    assert path.endswith("log check_2021-06-09")
    assert spark.read.option("header", True).csv(path).count() == 1
    io.write_bundle({"z": df, "a": df.withColumn("b", F.lit(2))}, f"{folder}/bundle")
    assert io.sheet_names(spark, f"{folder}/bundle") == ["z", "a"]
    assert io.read_sheet(spark, f"{folder}/bundle", 1).columns == ["a", "b"]
    assert io.read_sheet(spark, f"{folder}/bundle", "z").columns == ["a"]


def test_unique_rename_guard(spark):
    df = spark.createDataFrame([], "X_uuid string, b string")
    assert N.unique_rename(df, "uuid", "uuid").columns == ["uuid", "b"]
    with pytest.raises(ValueError):
        N.unique_rename(spark.createDataFrame([], "a_uuid string, b_uuid string"), "uuid", "uuid")


def test_compare_runs_reports_missing_sheets(spark):
    from souk.plans.comparison import compare_runs

    folder = tempfile.mkdtemp(prefix="souk-test-")
    items = spark.createDataFrame([("A", "Rice", "shop", 3)], "call_location string, item string, "
                                                               "vendor_type string, nv long")
    barrier = spark.createDataFrame([("A", 0.5)], "call_location string, q__x double")
    io.write_bundle({"items": items, "barrier": barrier}, f"{folder}/a")
    io.write_bundle({"items": items.withColumn("nv", F.lit(4).cast("long"))}, f"{folder}/b")
    got = {(r["sheet"], r["item"]): r["value"] for r in compare_runs(spark, f"{folder}/a", f"{folder}/b").collect()}
    assert got[("items", "diff:nv")] == 1
    assert got[("barrier", "sheet_missing_in_b")] == 1
