"""Bundles: versions, stored order, comparison by position."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from souk.operators import compare as C
from souk.operators import rollup as R
from souk.plans.comparison import compare_runs
from souk.sources import io


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="souk-bundle-")


def rows(spark, n, files):
    return spark.range(n).select((F.lit(n) - F.col("id")).alias("v"), F.concat(F.lit("r"), F.col("id")).alias("s")).repartition(files)


def test_a_failing_sheet_leaves_the_bundle_as_it_was(spark, folder):
    good = {f"s{i}": spark.range(i + 1).toDF("v") for i in range(8)}
    io.write_bundle(good, folder)
    bad = {k: df.withColumn("v", F.col("v") + 100) for k, df in good.items()}
    bad["s4"] = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("v"))
    with pytest.raises(Exception, match="no"):
        io.write_bundle(bad, folder)
    sheets = io.read_bundle(spark, folder)
    assert list(sheets) == list(good)
    assert {k: sorted(r["v"] for r in df.collect()) for k, df in sheets.items()} == {f"s{i}": list(range(i + 1)) for i in range(8)}


def test_the_latest_version_is_read_and_older_ones_can_go(spark, folder):
    first = io.write_bundle({"a": spark.range(1), "b": spark.range(2)}, folder)
    old = io.read_sheet(spark, folder, "a")
    second = io.write_bundle({"c": spark.range(3), "a": spark.range(4)}, folder)
    assert io.sheet_names(spark, folder) == ["c", "a"] and io.read_sheet(spark, folder, "a").count() == 4
    assert old.count() == 1  # a reader of the version before is not disturbed
    assert io.vacuum_bundle(spark, folder) == [first] and not os.path.exists(f"{folder}/v{first}")
    assert io.sheet_names(spark, folder) == ["c", "a"] and os.path.exists(f"{folder}/v{second}")
    with pytest.raises(KeyError):
        io.read_sheet(spark, folder, "b")
    with pytest.raises(IndexError):
        io.read_sheet(spark, folder, 2)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_order_survives_storage(spark, folder, fmt):
    df = rows(spark, 5000, 7).orderBy(F.desc("v"))
    io.write_bundle({"x": spark.range(1).toDF("k"), "sheet": df}, folder, fmt=fmt)
    for got in (io.read_sheet(spark, folder, "sheet", position="at"), io.read_sheet(spark, folder, 1, "at"), io.read_bundle(spark, folder, "at")["sheet"]):
        assert got.columns == ["v", "s", "at"]
        assert got.where("at <> 5001 - v").count() == 0 and got.count() == 5000


def test_positional_comparison_of_tables_in_different_files(spark, folder):
    df = rows(spark, 3000, 5).orderBy("v")
    df.write.parquet(f"{folder}/many")
    df.write.option("maxRecordsPerFile", 50).parquet(f"{folder}/one")
    changed = df.withColumn("s", F.when(F.col("v") == 1234, "other").otherwise(F.col("s")))
    changed.where("v < 2900").repartitionByRange(3, "v").sortWithinPartitions("v").write.parquet(f"{folder}/changed")
    many, one, other = (spark.read.parquet(f"{folder}/{n}") for n in ("many", "one", "changed"))
    assert C.compare_tables(many, one).count() == 0
    summary = {r["item"]: r["value"] for r in C.compare_summary(many, one).collect()}
    assert summary["rows_both"] == 3000 and summary["rows_only_x"] == summary["rows_only_y"] == summary["diff:v"] == summary["diff:s"] == 0
    assert [(r["__row"], r["variable"], r["value_y"]) for r in C.compare_tables(many, other).collect()] == [(1234, "s", "other")]
    summary = {r["item"]: r["value"] for r in C.compare_summary(many, other).collect()}
    assert summary["rows_only_x"] == 101 and summary["diff:s"] == 1


def test_bundles_compared_without_keys(spark, folder):
    sheets = {"items": rows(spark, 100, 3).orderBy("v"), "stock": rows(spark, 50, 2).orderBy("s")}
    io.write_bundle(sheets, f"{folder}/a")
    io.write_bundle({k: df.coalesce(1) for k, df in sheets.items()}, f"{folder}/b")
    found = compare_runs(spark, f"{folder}/a", f"{folder}/b", keyed=False).where("item like 'diff:%' or item like 'rows_only%'")
    assert {r["sheet"] for r in found.collect()} == {"items", "stock"} and found.where("value > 0").count() == 0


def shares_of(spark, names, places=3):
    """Share rows (location, item, n, pc): place k has every name whose number is not k modulo 5."""
    df = spark.range(names * places).select((F.col("id") % places).alias("k"), F.floor(F.col("id") / places).alias("i"))
    return df.where("i % 5 <> k").select(F.concat(F.lit("L"), F.col("k")).alias("call_location"), F.format_string("q__%06d", "i").alias("item"),
                                         F.lit(1).alias("n"), ((F.col("i") % 7) / 7).alias("pc"))


def test_parts_of_a_wide_sheet_hold_what_one_table_holds(spark):
    shares = shares_of(spark, 23)
    whole = R.global_shares_wide(shares)
    parts = R.global_shares_parts(shares, width=10)
    assert [len(p.columns) - 1 for p in parts] == [10, 10, 3] and sum((p.columns[1:] for p in parts), []) == whole.columns[1:]
    want = {r["call_location"]: r.asDict() for r in whole.collect()}
    for part in parts:
        rows = part.collect()
        assert sorted(r["call_location"] for r in rows) == sorted(want)
        for r in rows:
            assert all(r[c] == want[r["call_location"]][c] for c in part.columns)
    # in parts or not, of one width or another: no difference
    found = C.compare_bundles({"s": parts}, {"s": R.global_shares_parts(shares, width=8)}, {"s": ["call_location"]})["s"]
    values = {r["item"]: r["value"] for r in found.collect()}
    assert values["rows_both"] == 23 * 4 and values["diff:value"] == values["rows_only_x"] == values["rows_only_y"] == 0


def test_a_sheet_in_parts_written_and_read(spark, folder):
    shares = shares_of(spark, 1_200)
    io.write_bundle({"credit1": R.global_shares_parts(shares, width=500), "n": spark.range(2)}, folder)
    sheets = io.read_bundle(spark, folder)
    assert list(sheets) == io.sheet_names(spark, folder) == ["credit1", "n"]
    assert [len(p.columns) for p in sheets["credit1"]] == [501, 501, 201]
    long = io.long_sheet(sheets["credit1"], "call_location")
    assert long.count() == 1_200 * 4
    got = long.join(shares.withColumnRenamed("item", "name"), ["call_location", "name"])
    assert got.where("abs(value - pc) > 1e-12").count() == 0 and got.count() == shares.count()
