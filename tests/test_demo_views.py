"""The derived survey views: the steps that Spark plans for them, and rows that odd lines give."""

import datetime as dt

from souk.sources import demo, io


def _tables(spark, folder, flags):
    """One order for each entry of ``flags``, with a line for each of its return flags."""
    day = dt.datetime(2020, 1, 2)
    rows = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(0, 0)], "c_custkey long, c_nationkey int"),
        "supplier": ([(0, 0)], "s_suppkey long, s_nationkey int"),
        "part": ([(0, "SMALL")], "p_partkey long, p_type string"),
        "orders": ([(k, 0, "F", 1.0, day, "1-URGENT") for k in range(2, 2 + len(flags))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(k, 0, 0, n, 1.0, 2.0, f) for k, of in enumerate(flags, 2) for n, f in enumerate(of)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    demo.register_base_tables(spark, str(folder))


def test_lines_are_aggregated_without_sorting_them(spark, tmp_path):
    flags = [["A"], ["N", "R"], ["R", "A", None], [None], ["", "A"], ["AB", "R"], ["B", "N"], ["Z"], ["R"], ["N"], []]
    _tables(spark, tmp_path, flags)
    survey = spark.sql(demo.survey_sql("spark"))
    assert "SortAggregate" not in survey._jdf.queryExecution().executedPlan().toString()
    told = {"A": "local", "N": "regional", "R": "import"}
    want = {k: told.get(min((f for f in of if f is not None), default=None)) for k, of in enumerate(flags, 2)}
    assert {int(r["uuid"][1:]): r["supplier_source"] for r in survey.collect()} == want


def test_copies_of_the_survey_are_not_stored(spark, tmp_path):
    _tables(spark, tmp_path, [["A"], ["N", "R"], [None]])
    copies = demo.survey_copies(spark, str(tmp_path))
    assert all("/survey-" in f for f in copies.inputFiles())
    assert copies.where("index <= 1000000000").count() == demo.survey(spark, str(tmp_path)).count()


def test_the_edited_survey_keeps_the_order_of_its_rows(spark, tmp_path):
    _tables(spark, tmp_path, [["A"]] * 60)
    assert all("/survey-" in f for f in demo.survey_edited(spark, str(tmp_path)).inputFiles())
    ordered = io.sorted_rows(demo.survey(spark, str(tmp_path)), "uuid", task_rows=5)
    assert ordered.rdd.getNumPartitions() >= 12
    uuids = [r["uuid"] for r in ordered.collect()]
    assert uuids == sorted(uuids)
    edited = [r["uuid"] for r in demo.edited(ordered).collect()]
    assert edited == [u for u in uuids if u != "S5"]
