"""Validation and comparison operators on hand-made tables."""

import datetime as dt
import decimal

import pytest

from souk.operators import compare as C
from souk.operators import quality as Q


def test_check_log_reports_only_real_mismatches(spark):
    data = spark.createDataFrame([("u1", "a", None), ("u2", "c", None)], "uuid string, q string, r string")
    log = spark.createDataFrame([("u1", "q", "x", " a "), ("u1", "r", "x", None), ("u2", "q", "x", "b")],
                                "uuid string, question string, old_value string, new_value string")
    out = Q.check_log(data, Q.restrict_log(log, data)).collect()
    assert [(r["uuid"], r["question"], r["new_value"], r["value_extracted"], r["check"]) for r in out] == \
        [("u2", "q", "b", "c", "Please check log")]


def test_log_reach(spark):
    data = spark.createDataFrame([("u1", "a")], "uuid string, q string")
    log = spark.createDataFrame([("u1", "q"), ("u9", "q"), ("u8", "q"), ("u1", "zz")],
                                "uuid string, question string")
    dels = spark.createDataFrame([("u9",), ("u1",)], "uuid string")
    assert [r["uuid"] for r in Q.log_unknown_uuids(log, data, dels).collect()] == ["u9"]
    assert [r["question"] for r in Q.log_unknown_questions(log, data).collect()] == ["zz"]
    assert sorted((r["uuid"], r["question"]) for r in Q.restrict_log(log, data).collect()) == [("u1", "q")]
    assert [r["uuid"] for r in Q.undeleted(dels, data).collect()] == ["u1"]


def test_check_time(spark):
    df = spark.createDataFrame([
        ("u1", "2021-08-01T09:00:00.000+03:00", "2021-08-01T09:05:00.000+03:00"),
        ("u2", "2021-08-01T10:00:00", "2021-08-01T11:00:00"),
        ("u3", "2021-08-01T23:50:00", "2021-08-02T00:10:00"),
        ("u4", "2021-08-01T10:00:00", "2021-08-01T10:30:00")], "X_uuid string, start string, end string")
    got = {r["uuid"]: (r["value"], r["issue_type"], r["has_issue"], r["variable"])
           for r in Q.check_time(df, 5, 60).collect()}
    assert got == {"u1": (5.0, "form duration too short", "TRUE", "Completion Duration (min)"),
                   "u2": (60.0, "form duration too long", "TRUE", "Completion Duration (min)")}


def test_check_time_empty_keeps_schema(spark):
    df = spark.createDataFrame([("u1", "2021-08-01T10:00:00", "2021-08-01T10:30:00")],
                               "uuid string, start string, end string")
    out = Q.check_time(df, 5, 60)
    assert out.count() == 0
    assert out.columns == ["uuid", "value", "variable", "has_issue", "issue_type"]


def test_check_time_requires_columns(spark):
    with pytest.raises(ValueError):
        Q.check_time(spark.createDataFrame([("u",)], "uuid string"), 5, 60)


def test_find_outliers_and_duplicates(spark):
    rows = [(i, 10.0 + (i % 3), f"u{i}") for i in range(1, 40)] + [(40, 1000.0, "u1")]
    df = spark.createDataFrame(rows, "index long, price double, uuid string")
    out = Q.find_outliers(df, ["price"]).collect()
    assert {(r["index"], r["issue_type"]) for r in out} >= {(40, Q.OUTLIER_NORMAL)}
    dups = sorted(r["index"] for r in Q.find_duplicates(df, "uuid").collect())
    assert dups == [1, 40]


def test_other_responses_and_owner(spark):
    df = spark.createDataFrame([(1, "u1", "org1", "cousin"), (2, "u2", "org2", "cousin"), (3, "u3", "org1", None)],
                               "index long, uuid string, enumerator_org string, source_other string")
    other = Q.find_other_responses(df).collect()
    assert [(r["variable"], r["value"], r["n"]) for r in other] == [("source_other", "cousin", 2)]
    issues = spark.createDataFrame([(1, "9", "x", True, "outlier"), (2, "9", "x", True, "outlier"),
                                    (None, "a", "y", True, Q.OTHER_RESPONSE)],
                                   "index long, value string, variable string, has_issue boolean, issue_type string")
    log = spark.createDataFrame([("u2",)], "uuid string")
    keep = Q.attach_issue_owner(issues, df, log, "drop_logged").collect()
    assert [(r["index"], r["uuid"], r["ngo"]) for r in keep] == [(1, "u1", "org1")]
    only = Q.attach_issue_owner(issues, df, log, "keep_logged").collect()
    assert [(r["index"], r["uuid"]) for r in only] == [(2, "u2")]


def test_compare_tables(spark):
    x = spark.createDataFrame([(1, None, 1.0), (2, "a", 1.0), (3, "b", 2.0)], "k int, s string, v double")
    y = spark.createDataFrame([(1, None, 1.000000001), (2, None, 1.0), (4, "c", 9.0)], "k int, s string, v double")
    cells = sorted((r["k"], r["variable"]) for r in C.compare_tables(x, y, ["k"]).collect())
    assert cells == [(2, "s")]
    summ = {r["item"]: r["value"] for r in C.compare_summary(x, y, ["k"]).collect()}
    assert summ["rows_only_x"] == 1 and summ["rows_only_y"] == 1 and summ["rows_both"] == 2
    assert summ["diff:s"] == 1 and summ["diff:v"] == 0


def test_compare_with_itself_is_empty(spark):
    x = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert C.compare_tables(x, x, ["k"]).count() == 0


def test_convert_col_types(spark):
    df = spark.createDataFrame([("12", "x", 1.0)], "a string, b string, c double")
    out = Q.convert_col_types(df, {"a": "integer", "b": "select_one", "c": "text"}).collect()[0]
    assert (out["a"], out["b"], out["c"]) == (12.0, "x", "1")


def _stored(spark, folder, rows, schema, per_file=None):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    (df.write.option("maxRecordsPerFile", per_file) if per_file else df.write).parquet(folder)
    return spark.read.parquet(folder)


SIDE = "s string, v double, n int, b boolean, d date, t timestamp, m decimal(10,2)"


def _side(i, k=0):
    day = dt.date(2021, 1, 1 + i % 28)
    return (None if i % 11 == 3 else f"s{i - i % 7 * k}", float("nan") if i % 13 == 1 else float(i + k * (i % 5 == 0)), None if i % 3 else i, i % 2 == 0,
            day, dt.datetime(2021, 1, 1, i % 24, tzinfo=dt.timezone.utc), decimal.Decimal(i) / 4)


@pytest.mark.parametrize("nx,ny,block", [(100, 100, 7), (100, 60, 16), (20, 90, 4096), (0, 30, 8), (30, 0, 8), (0, 0, 8)])
def test_rows_by_place_meet_in_blocks(spark, tmp_path, monkeypatch, nx, ny, block):
    # the same differences as a join on the places gives
    monkeypatch.setattr(C._by_position, "__defaults__", (block,))
    x = _stored(spark, f"{tmp_path}/x", [_side(i) for i in range(nx)], SIDE)
    y = _stored(spark, f"{tmp_path}/y", [_side(i, 1) for i in range(ny)], SIDE, per_file=9)
    def rows(df):
        return sorted(df.collect(), key=str)
    cells, summary = rows(C.compare_tables(x, y)), rows(C.compare_summary(x, y))
    monkeypatch.setattr(C, "PLAIN_TYPES", ())
    assert cells == rows(C.compare_tables(x, y)) and summary == rows(C.compare_summary(x, y))
    found = {r["item"]: r["value"] for r in summary}
    assert (found["nrow_x"], found["nrow_y"], found["rows_both"]) == (nx, ny, min(nx, ny))
    assert len(cells) == sum(v for k, v in found.items() if k.startswith("diff:")) and (min(nx, ny) == 0) == (not cells)


def test_rows_by_place_are_not_shuffled_as_rows(spark, tmp_path):
    x = _stored(spark, f"{tmp_path}/x", [_side(i) for i in range(40)], SIDE)
    y = _stored(spark, f"{tmp_path}/y", [_side(i, 1) for i in range(40)], SIDE, per_file=9)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        plan = C.compare_summary(x, y)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
