"""CSV files with line breaks inside quoted cells, read by many tasks.

A quoted cell may hold line breaks, so a split of a file cannot tell by itself whether it
begins inside a cell. Two passes over the lines (Spark's text source, which splits files):

1. each split finds, for both possible beginnings (outside or inside quotes), how it ends.
   The splits' functions, chained from the file's start, tell how each really begins. One
   row a split comes to the driver, which lists the splits of a scan anyway;
2. each split cuts its own records. A record that crosses an edge leaves a piece in each
   split it touches; the pieces (two a split at most) are joined by a small grouped
   job. Records are parsed by ``from_csv``, cleaned and stored, and what
   type each column has is observed while they are written.

The result reads the stored table, so that later passes read only the columns they use.

Defined results: records end at ``\\n`` outside quotes, or at ``\\r\\n`` in a file whose first line
does (there ``\\r\\n`` inside quotes becomes ``\\n``, as in Spark's reader); empty lines are no records; each file's first record is its header; a quote inside an unquoted cell is
a character like others; what follows a closing quote up to the delimiter belongs to the
cell; a cell still open at the file's end ends there; missing cells are null, cells
beyond the header's are dropped.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# the functions below travel with their tasks: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, TAIL, HEAD = 0, 1, 2
BROADCAST_SPLITS = 100_000
CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}


def ends_inside(line: str, inside: bool, quote: str = '"', delimiter: str = ",") -> bool:
    """Whether a line that begins inside a quoted cell (or at a cell's start) ends inside one."""
    at = 0
    while True:
        at = line.find(quote, at)
        if at < 0:
            return inside
        if not inside:
            # a quote opens a cell only as its first character
            inside = at == 0 or line[at - 1] == delimiter
            at += 1
        elif line[at + 1:at + 2] == quote:  # a doubled quote is a character
            at += 2
        else:
            inside = False
            at += 1


def _lines(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """block (a split's first byte), file (hash of its path), value."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_block_start").alias("block"), F.xxhash64("_metadata.file_path").alias("file"), F.col("value"), *more)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(file, block, rows) of each stretch of a batch that comes from one split."""
    block, file = (batch.column(i).to_numpy() for i in (0, 1))
    edges = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield int(file[a]), int(block[a]), batch.slice(a, b - a)


class _Split:
    """What a split shows for both beginnings: index 0 outside, 1 inside quotes."""

    def __init__(self, path: str):
        self.path, self.ends, self.begun, self.head, self.open, self.first = path, [False, True], [False, False], [], True, None

    def feed(self, values: pa.Array) -> None:
        if self.first is None:
            self.first = values[0].as_py()
        quoted = pc.match_substring(values, '"')
        if not self.open and not pc.any(quoted).as_py():
            filled = pc.any(pc.invert(pc.is_in(values, value_set=pa.array(["", "\r"])))).as_py()
            for k in (0, 1):
                self.begun[k] |= bool(filled) and not self.ends[k]
            return
        for line, has in zip(values.to_pylist(), quoted.to_pylist()):
            for k in (0, 1):
                self.begun[k] |= not self.ends[k] and line not in ("", "\r")
                if has:
                    self.ends[k] = ends_inside(line, self.ends[k])
            # the first record, if the split begins outside quotes
            if self.open and self.begun[0]:
                self.head.append(line)
                self.open = self.ends[0]

    def row(self) -> tuple:
        return (self.path, *self.ends, *self.begun, self.first[-1:] == "\r", None if self.open else "\n".join(self.head))


def splits(spark: SparkSession, path: str) -> list[dict]:
    """The splits of the files below ``path`` in file order: path, file, block, inside (whether it
    begins inside quotes), header (whether the file's first record begins in it), head (that
    record's text, if it ends there too), crlf (whether the file's first line ends with it),
    open (whether it ends inside quotes)."""
    names = ("file", "block", "path", "end_out", "end_in", "begun_out", "begun_in", "crlf", "head")

    def run(batches):
        found: dict[tuple, _Split] = {}
        for batch in batches:
            for file, block, rows in _runs(batch) if batch.num_rows else ():
                if (file, block) not in found:
                    found[file, block] = _Split(rows.column(3)[0].as_py())
                found[file, block].feed(rows.column(2))
        rows = [(*key, *split.row()) for key, split in found.items()]
        kinds = (pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 5, pa.string())
        # a split's head matters only where its file begins
        rows = [r if r[1] == 0 else (*r[:-1], None) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
    lines = _lines(spark, path, F.col("_metadata.file_path").alias("path"))
    rows = lines.mapInArrow(run, "file long, block long, path string, end_out boolean, end_in boolean, begun_out boolean, begun_in boolean, crlf boolean, head string").collect()
    out, last, inside, begun, crlf = [], None, False, False, False
    for r in sorted(rows, key=lambda r: (r["path"], r["block"])):
        if r["path"] != last:
            last, inside, begun, crlf = r["path"], False, False, r["crlf"]
        has = r["begun_in" if inside else "begun_out"]
        out.append({"path": r["path"], "file": r["file"], "block": r["block"], "inside": inside, "header": has and not begun, "crlf": crlf,
                    "head": r["head"] if has and not begun else None})
        begun, inside = begun or has, r["end_in" if inside else "end_out"]
        out[-1]["open"] = inside
    return out


def _records(spark: SparkSession, path: str, found: list[dict]) -> DataFrame:
    """file, block, seq (of the records begun in the split; the header's is 0), kind, text: whole
    records, and the pieces of those that cross an edge."""
    begins = spark.sparkContext.broadcast({(s["file"], s["block"]): (s["inside"], s["header"], s["crlf"]) for s in found})

    def run(batches):
        known = begins.value
        now, inside, seq, held, crlf = None, False, 0, [], False

        def closed():
            """What a split leaves open at its end."""
            return [(*now, seq if inside_since else -1, TAIL if inside_since else HEAD, "\n".join(held))] if held else []

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["file", "block", "seq", "kind", "text"])
        inside_since = False  # whether the open record began in this split
        for batch in batches:
            rows: list[tuple] = []
            for file, block, part in _runs(batch) if batch.num_rows else ():
                if now != (file, block):
                    rows += closed() if now else []
                    if (file, block) not in known:
                        raise RuntimeError("the files' splits changed between two passes over them: read again")
                    now, held, inside_since = (file, block), [], False
                    inside, header, crlf = known[now]
                    seq = -1 if header else 0
                values = part.column(2)
                if crlf:
                    values = pc.replace_substring_regex(values, r"\r$", "")
                quoted = pc.match_substring(values, '"')
                if not inside and not pc.any(quoted).as_py():
                    texts = [x for x in values.to_pylist() if x]
                    rows += [(file, block, n, WHOLE, x) for n, x in enumerate(texts, seq + 1)]
                    seq += len(texts)
                    continue
                for line, has in zip(values.to_pylist(), quoted.to_pylist()):
                    if not inside:
                        if not line:
                            continue
                        seq += 1
                        held, inside_since = [], True
                    held.append(line)
                    inside = ends_inside(line, inside) if has else inside
                    if not inside:
                        text = "\n".join(held)
                        rows.append((file, block, seq, WHOLE, text) if inside_since else (file, block, -1, HEAD, text))
                        held = []
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
        if now and held:
            yield batch_of(closed())
    return _lines(spark, path).mapInArrow(run, "file long, block long, seq long, kind int, text string")


def _joined(pieces: DataFrame) -> DataFrame:
    """file, block, seq, text of the records that cross edges, from their pieces."""
    by_file = Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("kind") == TAIL, F.struct("block", "seq")), ignorenulls=True).over(by_file)
    grouped = pieces.withColumn("of", opened).groupBy("file", "of").agg(
        F.array_sort(F.collect_list(F.struct("block", F.when(F.col("kind") == TAIL, 1).otherwise(0).alias("later"), "raw"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["raw"]), "\n")
    return grouped.select("file", F.col("of.block").alias("block"), F.col("of.seq").alias("seq"), text.alias("text"))


def _cells(records: DataFrame, width: int, na: tuple[str, ...], *more: str) -> DataFrame:
    """The records' cells c0, c1, ... as text, markers of missing cells as null."""
    row = F.from_csv("text", ", ".join(f"c{k} string" for k in range(width)), CSV_OPTIONS)
    parsed = records.select("file", "block", "seq", *more, row.alias("row"))
    cell = lambda k: F.col(f"row.c{k}")
    return parsed.select("file", "block", "seq", *more, *[F.when(~cell(k).isin(*na), cell(k)).alias(f"c{k}") for k in range(width)])


def _type_checks(width: int, number: str) -> list[Column]:
    """For each column: is every cell an integer, is every cell a number (null: no cell)."""
    out = []
    for k in range(width):
        x = F.col(f"c{k}")
        data = x.isNotNull() & (F.col("seq") > 0)
        # the pattern first: a cast that fails is slow
        whole = F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), x.try_cast("bigint").isNotNull()).otherwise(False)
        out.append(F.min(F.when(data, whole.cast("int"))).alias(f"i{k}"))
        out.append(F.min(F.when(data, x.rlike(number).cast("int"))).alias(f"d{k}"))
    return out


def scan(spark: SparkSession, path: str, found: list[dict], width: int, na: tuple[str, ...], number: str) -> tuple[DataFrame, list[str]]:
    """The records' cells (file, block, seq, c0, ... as text) and each column's type.

    ``found``: the files' splits; ``width``: cells of the header; ``number``: the pattern of cells
    that are numbers."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/souk-csv-cells-{uuid.uuid4().hex}"
    records = _records(spark, path, found).withColumn("raw", F.when(F.col("kind") != WHOLE, F.col("text")))
    # a piece is parsed with its record, not by itself
    cells = _cells(records.withColumn("text", F.when(F.col("kind") == WHOLE, F.col("text"))), width, na, "kind", "raw")
    seen = Observation()
    cells.observe(seen, *_type_checks(width, number)).write.parquet(out)
    stored = spark.read.parquet(out)
    whole = stored.where((F.col("kind") == WHOLE) & (F.col("seq") > 0)).drop("kind", "raw")
    # no split begins or ends inside a cell: no record crosses an edge
    if not any(s["inside"] or s["open"] for s in found):
        return whole, _kinds([seen.get], width)
    crossing = _cells(_joined(stored.where(F.col("kind") != WHOLE).select("file", "block", "seq", "kind", "raw")), width, na)
    kinds = _kinds([seen.get, crossing.agg(*_type_checks(width, number)).first().asDict()], width)
    return whole.unionByName(crossing.where(F.col("seq") > 0)), kinds


def _kinds(flags: list[dict], width: int) -> list[str]:
    """Each column's type from what ``_type_checks`` told of all its cells."""
    def all_are(name):
        told = [f[name] for f in flags if f.get(name) is not None]
        return bool(told) and all(told)
    return ["bigint" if all_are(f"i{k}") else "double" if all_are(f"d{k}") else "string" for k in range(width)]


def numbered(cells: DataFrame, found: list[dict], name: str) -> DataFrame:
    """The cells with ``name``: the record's number over all files (by path, then place in the file)."""
    spark = cells.sparkSession
    places = spark.createDataFrame([(n, s["file"], s["block"]) for n, s in enumerate(found)], "place int, of_file long, of_block long")
    counts = cells.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(places, (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block")))
    # one row a split
    before = counts.select("of_file", "of_block", (F.sum("n").over(Window.orderBy("place")) - F.col("n")).alias("before"))
    # its size is known: beyond that a shuffled join
    before = F.broadcast(before) if len(found) <= BROADCAST_SPLITS else before
    return cells.join(before, (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block"))) \
                .withColumn(name, F.col("before") + F.col("seq")).drop("before", "of_file", "of_block")
