"""CSV files read by many tasks against Spark's own whole-file reader."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from souk.sources import csv_scan, io


def write(text, name="a.csv", folder=None):
    folder = folder or tempfile.mkdtemp(prefix="souk-csv-")
    with open(f"{folder}/{name}", "w", newline="") as f:
        f.write(text)
    return folder


@pytest.fixture
def small_splits(spark):
    """Splits of 300 bytes, so that most records cross an edge."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def whole_reader(spark, folder):
    """One task a file: what the split scan has to equal."""
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).csv(folder))


def plain(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def random_csv(rnd, rows, line="\n", odd=True):
    def cell():
        kind = rnd.random()
        if kind < 0.3:
            return str(rnd.randint(0, 999))
        if kind < 0.6:
            return "".join(rnd.choices("ab cé", k=rnd.randint(1, 12)))
        if odd and kind < 0.65:
            return 'x"y'
        inner = "".join(rnd.choices(["a", "b", ",", line, line, '""', " ", "é"], k=rnd.randint(0, 60)))
        return f'"{inner}"'
    out = [",".join(f"c{k}" for k in range(4))]
    out += [",".join([str(n), *(cell() for _ in range(3))]) for n in range(rows)]
    return line.join(out) + line


@pytest.mark.parametrize("seed,line", [(0, "\n"), (1, "\n"), (2, "\r\n"), (3, "\n")])
def test_cells_equal_the_whole_file_reader(spark, small_splits, seed, line):
    folder = write(random_csv(random.Random(seed), 60, line))
    got = io.read_survey_csv(spark, folder, infer=False)
    assert got.columns == ["c0", "c1", "c2", "c3"]
    want = whole_reader(spark, folder)
    want = want.select(*[F.when(~F.col(c).isin(*io.NA_MARKERS), F.col(c)).alias(c) for c in want.columns])
    assert plain(got) == plain(want) and got.count() == 60


def test_a_file_is_read_by_many_tasks_and_numbered_in_order(spark, small_splits):
    folder = write(random_csv(random.Random(4), 100))
    write(random_csv(random.Random(5), 20), "b.csv", folder)
    found = csv_scan.splits(spark, folder)
    assert len(found) > 15 and sum(s["inside"] for s in found) > 5
    assert csv_scan._lines(spark, folder).rdd.getNumPartitions() > 15
    got = io.read_survey_csv(spark, folder, index="index")
    rows = sorted((r["index"], r["c0"]) for r in got.collect())
    assert rows == [(n + 1, n) for n in range(100)] + [(101 + n, n) for n in range(20)]


def test_a_cell_longer_than_many_splits(spark, small_splits):
    long = "\n".join(f"line {n}" for n in range(200))
    folder = write(f'k,"note\nof it",v\n1,"{long}",2\n\n3,"a\n\nb",4\n5,"open\nuntil the end')
    got = {r["k"]: (r[1], r["v"]) for r in io.read_survey_csv(spark, folder).collect()}
    assert got == {1: (long, 2), 3: ("a\n\nb", 4), 5: ("open\nuntil the end", None)}
    assert io.read_survey_csv(spark, folder).columns == ["k", "note.of.it", "v"]


def test_types_are_inferred_over_all_pieces(spark, small_splits):
    # the only text cells are in a record that crosses an edge
    folder = write("a,b,c\n" + "1,2.5,7\n" * 40 + '2,"x\n' + "y" * 300 + '",8\n' + "3,NA,9\n" * 40)
    got = io.read_survey_csv(spark, folder)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "string", "bigint"]
    assert got.where("b is null").count() == 40 and got.count() == 81


def test_ends_inside():
    for line, outside, inside in [('a,b', False, True), ('"a', True, False), ('a"b', False, False), ('"a""', True, True), ('"a"",', True, True),
                                  ('"a","b', True, False), ('x"y,"b', True, True), ('"a"b,"c', True, True), ("", False, True), ('""', False, True)]:
        assert csv_scan.ends_inside(line, False) == outside, line
    assert csv_scan.ends_inside('b",c', True) is False and csv_scan.ends_inside('b","c', True) is True and csv_scan.ends_inside("x", True) is True


def test_files_without_records(spark):
    assert io.read_survey_csv(spark, write("")).columns == []
    assert io.read_survey_csv(spark, write("\n\n")).columns == []
    only = io.read_survey_csv(spark, write("a,b\n"))
    assert only.columns == ["a", "b"] and only.count() == 0


def test_type_checks_cast_only_what_is_written_as_an_integer(spark, monkeypatch):
    from pyspark.sql.classic.column import Column
    # the strict cast fails the query at the first cell that is no integer
    monkeypatch.setattr(Column, "try_cast", lambda self, kind: self.cast(kind))
    cells = spark.createDataFrame([(0, "name", "size", "no"), (1, "x1", " 12 ", None), (2, "y", "-3", None), (3, "4.5", "+7", None)], "seq int, c0 string, c1 string, c2 string")
    kept = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        assert tuple(cells.agg(*csv_scan._type_checks(3, io.NUMBER)).first()) == (0, 0, 1, 1, None, None)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", kept)


def test_ends_inside_looks_at_quotes_only():
    class Line(str):
        looked = 0

        def find(self, *of):
            self.looked += 1
            return super().find(*of)
    line = Line("a,b," * 50 + '"c ""d""","e')
    assert csv_scan.ends_inside(line, False) is True and line.looked < 10
