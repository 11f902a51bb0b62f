"""The sheets from one read of the survey: the same tables as from the interviews, scanned once."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from souk.operators import indicators as I
from souk.operators.cells import Cells, cell_counts
from souk.plans.analysis import analyse, write_analysis
from souk.sources import demo


def same(a, b):
    def rows(df):
        return sorted(map(str, df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()))
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def odd_survey(spark):
    """Null locations and vendors, a question nobody answered, a location without answers, a column with a dot."""
    rows = [("a", "shop", 1.0, None, 2.0, "dk", "yes", "1", None, "own", "3", 10.0, "free 0"),
            ("a", "shop", 1.0, None, 2.0, "no", "yes", "0", None, "own", "x", 10.5, None),
            ("a", "water_seller", 4.0, None, None, "yes", None, "1", None, "rent", "4", None, "free 1"),
            (None, None, 7.0, None, 3.0, "pnta", "no", None, None, None, None, 2.0, "free 1"),
            ("b", "shop", None, None, None, None, None, None, None, None, None, None, None)]
    names = "call_location string, vendor_type string, price_usd_rice_kg double, price_usd_oil_l double, stock_len_rice double, " \
            "stock_dif_rice string, barrier_any string, `barrier_kind.road` string, payment_none string, transportation_who string, " \
            "supplier_number string, credit_max_usd double, cva_effect_other string"
    return spark.createDataFrame(rows * 3, names)


@pytest.mark.parametrize("make", [lambda s: demo.survey(s, SF001), odd_survey])
def test_tables_equal_those_of_the_interviews(spark, make):
    survey = make(spark)
    cells = Cells(survey)
    assert same(cells.price_table(), I.price_table(survey))
    assert same(cells.stock_table(), I.stock_table(survey))
    for family, direct in (("barrier", I.barrier_shares), ("payment", I.payment_shares),
                           ("supplier", I.supplier_shares), ("credit", I.credit_shares)):
        assert same(cells.shares(family), direct(survey)), family
    assert same(cells.supplier_numbers(), I.supplier_numbers(survey))
    assert same(cells.credit_numbers(), I.credit_numbers(survey))


def test_counts_hold_every_cell_once(spark):
    survey = odd_survey(spark)
    counts = cell_counts(survey).collect()
    assert sum(r["n"] for r in counts if r["part"] == "price") == 2 * survey.count()
    assert {(r["call_location"], r["num"], r["n"]) for r in counts if r["name"] == "price_usd_rice_kg"} == {
        ("a", 1.0, 6), ("a", 4.0, 3), (None, 7.0, 3), ("b", None, 3)}
    assert all(r["vendor_type"] is None for r in counts if r["part"] not in ("price", "supplier_number"))


def test_all_sheets_read_the_survey_once(spark):
    survey = demo.survey(spark, SF001)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x
    watched = survey.withColumn("call_location", counted(F.col("call_location").cast("string")))
    write_analysis(analyse(watched), tempfile.mkdtemp(prefix="souk-test-") + "/a")
    assert seen.value == survey.count()


def test_a_part_is_read_alone(spark):
    plan = Cells(odd_survey(spark)).shares("barrier")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan


def test_a_survey_without_a_family_is_refused(spark):
    with pytest.raises(ValueError, match="barrier"):
        cell_counts(odd_survey(spark).drop("barrier_any", "barrier_kind.road"))
    empty = Cells(odd_survey(spark).limit(0))
    assert empty.price_table().collect() == [] and empty.credit_numbers().collect() == []
