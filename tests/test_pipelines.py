"""End-to-end runs: analysis bundle, validation outputs, bundle comparison, streaming checks."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from souk.plans.analysis import SHEETS, analyse, write_analysis
from souk.plans.comparison import compare_runs
from souk.plans.validation import validate, write_validation
from souk.sources import demo
from souk.sources.io import read_bundle, read_survey_csv, sheet_names
from souk.streaming import checks


def test_analysis_bundle_roundtrip_and_compare(spark):
    survey = demo.survey(spark, SF001)
    out = tempfile.mkdtemp(prefix="souk-test-")
    sheets = analyse(survey)
    write_analysis(sheets, f"{out}/a")
    assert sheet_names(spark, f"{out}/a") == list(SHEETS)
    back = read_bundle(spark, f"{out}/a")
    assert back["items"].where(F.col("call_location") == "_global").count() > 0
    assert "_global" in [r[0] for r in back["barrier"].select("call_location").collect()]
    # a second run of the same data compares equal
    write_analysis(analyse(survey), f"{out}/b")
    summary = {(r["sheet"], r["item"]): r["value"] for r in compare_runs(spark, f"{out}/a", f"{out}/b").collect()}
    assert all(v == 0 for (s, item), v in summary.items() if item.startswith("diff:") or item.startswith("rows_only"))


def test_validation_outputs(spark):
    survey = demo.survey(spark, SF001)
    outs = validate(survey, demo.cleaning_log(spark, SF001), demo.deletions(spark, SF001), demo.tool(spark),
                    one_enumerator="E2")
    folder = tempfile.mkdtemp(prefix="souk-test-")
    paths = write_validation(outs, folder, run_date=dt.date(2021, 8, 1))
    assert paths["cleaning_log_not_applied"].endswith("_2021-08-01")
    assert spark.read.parquet(paths["cleaning_log_not_applied"]).count() > 0


def test_read_survey_csv_markers_and_headers(spark):
    folder = tempfile.mkdtemp(prefix="souk-test-")
    with open(f"{folder}/s.csv", "w") as f:
        f.write("_uuid,price usd,a,a,q/opt\nu1,1.5,NA, ,1\nu2,,x,y,0\n")
    df = read_survey_csv(spark, f"{folder}/s.csv")
    assert df.columns == ["X_uuid", "price.usd", "a", "a.1", "q.opt"]
    rows = df.orderBy("X_uuid").collect()
    assert rows[0]["price.usd"] == 1.5 and rows[1]["price.usd"] is None
    assert rows[0]["a"] is None and rows[0]["a.1"] is None
    assert dict(df.dtypes)["q.opt"] == "bigint"


def test_csv_cells_with_line_breaks_and_number_rule(spark):
    folder = tempfile.mkdtemp(prefix="souk-test-")
    with open(f"{folder}/s.csv", "w") as f:
        f.write('price (usd),1st,a-b,if,_x,a,a.1,a\n"line one\nline ""two""",12d,7f,1,2.5,x,y,z\nplain,1,3,,1e3,,,\n')
    df = read_survey_csv(spark, f"{folder}/s.csv", index="index")
    assert df.columns == ["price..usd.", "X1st", "a.b", "if.", "X_x", "a", "a.1", "a.2", "index"]
    rows = df.orderBy("index").collect()
    assert rows[0]["price..usd."] == 'line one\nline "two"' and [r["index"] for r in rows] == [1, 2]
    kinds = dict(df.dtypes)
    assert (kinds["X1st"], kinds["a.b"], kinds["if."], kinds["X_x"]) == ("string", "string", "bigint", "double")
    assert read_survey_csv(spark, f"{folder}/s.csv", header="sheet").columns[:3] == ["price.(usd)", "1st", "a-b"]


def test_validate_on_sheets_with_prefixed_keys(spark):
    import glob

    from souk.__main__ import main
    folder = tempfile.mkdtemp(prefix="souk-cli-")
    data = demo.survey(spark, SF001).withColumnRenamed("uuid", "X_uuid").withColumn("q/opt", F.lit("1"))
    paths = {}
    for name, df in (("data", data.orderBy("index").drop("index")), ("log", demo.cleaning_log(spark, SF001)),
                     ("deletions", demo.deletions(spark, SF001).withColumnRenamed("uuid", "_uuid")), ("tool", demo.tool(spark))):
        df.coalesce(1).write.option("header", True).csv(f"{folder}/{name}_csv")
        paths[name] = glob.glob(f"{folder}/{name}_csv/*.csv")[0]
    assert main(["validate", "--data", paths["data"], "--log", paths["log"], "--deletions", paths["deletions"],
                 "--tool", paths["tool"], "--out", f"{folder}/checks", "--one-enumerator", "E1"]) == 0
    outs = {p.split("/")[-1].rsplit("_", 1)[0]: p for p in glob.glob(f"{folder}/checks/*")}
    own = spark.read.parquet(outs["similar_surveys_E1"])
    assert "q/opt" not in own.columns
    assert own.count() == data.where("enumerator = 'E1'").count() and own.where("most_similar_survey is null").count() == 0
    si = [r["si"] for r in spark.read.parquet(outs["enumerator_similarity"]).collect()]
    assert si and sorted(si, reverse=True) == si


def test_streaming_duration_and_outliers(spark):
    survey = demo.survey(spark, SF001)
    src = tempfile.mkdtemp(prefix="souk-stream-src-")
    survey.write.mode("overwrite").parquet(f"{src}/batch1")
    stream = checks.read_interviews(spark, f"{src}/batch1", survey.schema)
    sink = tempfile.mkdtemp(prefix="souk-stream-out-")
    q = checks.start_sink(checks.duration_issues(stream, 5, 60), f"{sink}/dur", "dur_test",
                          checkpoint_location=f"{sink}/_ckpt_dur")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{sink}/dur").count()
    from souk.operators.quality import check_time
    assert got == check_time(survey, 5, 60).count()
    stats = checks.column_stats(survey, ["credit_max_usd"])
    q2 = checks.start_sink(checks.outlier_issues(checks.read_interviews(spark, f"{src}/batch1", survey.schema),
                                                 stats, ["credit_max_usd"]), f"{sink}/out", "out_test",
                          checkpoint_location=f"{sink}/_ckpt_out")
    q2.awaitTermination(120)
    assert spark.read.parquet(f"{sink}/out").columns == ["index", "value", "variable", "has_issue", "issue_type"]


def test_v6_share_sheets_are_wide_and_sorted(spark):
    sheets = analyse(demo.survey(spark, SF001), method="v6")
    cols = sheets["barrier"].columns
    assert cols == sorted(cols) and "call_location" in cols
    glob = sheets["barrier"].where(F.col("call_location") == "_global").collect()
    assert len(glob) == 1


def test_command_line_analyse_and_compare_from_csv(spark):
    from souk.__main__ import main
    folder = tempfile.mkdtemp(prefix="souk-cli-")
    survey = demo.survey(spark, SF001)
    survey.coalesce(1).write.option("header", True).csv(f"{folder}/survey_csv")
    import glob
    csv_file = glob.glob(f"{folder}/survey_csv/*.csv")[0]
    assert main(["analyse", "--survey", csv_file, "--out", f"{folder}/a"]) == 0
    assert main(["analyse", "--survey", csv_file, "--out", f"{folder}/b"]) == 0
    assert main(["compare", "--a", f"{folder}/a", "--b", f"{folder}/b", "--out", f"{folder}/cmp"]) == 0
    cmp = spark.read.parquet(f"{folder}/cmp")
    diffs = cmp.where(F.col("item").startswith("diff:") & (F.col("value") > 0)).count()
    assert diffs == 0
    items = read_bundle(spark, f"{folder}/a")["items"]
    assert items.where(F.col("call_location") == "_global").count() > 0


def test_command_line_validate_from_csv(spark):
    import glob

    from souk.__main__ import main
    folder = tempfile.mkdtemp(prefix="souk-cli-")
    paths = {}
    for name, df in (("data", demo.survey(spark, SF001)), ("log", demo.cleaning_log(spark, SF001)),
                     ("deletions", demo.deletions(spark, SF001)), ("tool", demo.tool(spark))):
        df.coalesce(1).write.option("header", True).csv(f"{folder}/{name}_csv")
        paths[name] = glob.glob(f"{folder}/{name}_csv/*.csv")[0]
    assert main(["validate", "--data", paths["data"], "--log", paths["log"], "--deletions", paths["deletions"],
                 "--tool", paths["tool"], "--out", f"{folder}/checks"]) == 0
    outs = {p.split("/")[-1].rsplit("_", 1)[0] for p in glob.glob(f"{folder}/checks/*")}
    assert {"cleaning_log_not_applied", "uuid_not_in_dataset", "similar_surveys", "enumerator_similarity"} <= outs
