"""Cell-by-cell comparison of two result tables or two bundles of sheets.

Rows are aligned on key columns by a null-safe full outer join (one shuffle
of both sides on the key); each shared column of a comparable type is tested
(both null = equal, one null = different, numbers within an absolute
tolerance) and the differing cells are unpivoted into a long table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sem import col, is_numeric, null_safe_join
from ..sources.io import Sheet, long_sheet, with_row_index, with_stored_index

# the functions below travel with their tasks: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULT_TOL = 1.5e-8
BLOCK_ROWS = 4096
# column types that go to tasks and back as they are
PLAIN_TYPES = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NumericType)


def _kind(dt: T.DataType) -> str:
    if is_numeric(dt):
        return "number"
    if isinstance(dt, T.BooleanType):
        return "logical"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text"


def schema_report(x: DataFrame, y: DataFrame, by: Sequence[str]) -> dict[str, list[str]]:
    """Shared, x-only, y-only and type-mismatched columns (driver-side, schema only)."""
    tx = {f.name: f.dataType for f in x.schema.fields}
    ty = {f.name: f.dataType for f in y.schema.fields}
    shared = [c for c in x.columns if c in ty and c not in by]
    return {
        "compared": [c for c in shared if _kind(tx[c]) == _kind(ty[c])],
        "not_compared": [c for c in shared if _kind(tx[c]) != _kind(ty[c])],
        "only_x": [c for c in x.columns if c not in ty],
        "only_y": [c for c in y.columns if c not in tx],
    }


def _aligned(x: DataFrame, y: DataFrame, by: Sequence[str] | None, order: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    if not by:
        # positional alignment: row numbers in the declared order of each table, else in the order they are stored in
        x, y = (with_row_index(t, list(order), "__row") if order else with_stored_index(t, "__row") for t in (x, y))
        by = ["__row"]
    by = list(by)
    rep = schema_report(x, y, by)
    xs = x.select(*[col(k).alias(f"__kx{i}") for i, k in enumerate(by)], F.lit(True).alias("__in_x"),
                  *[col(c).alias(f"__x{i}") for i, c in enumerate(rep["compared"])])
    ys = y.select(*[col(k).alias(f"__ky{i}") for i, k in enumerate(by)], F.lit(True).alias("__in_y"),
                  *[col(c).alias(f"__y{i}") for i, c in enumerate(rep["compared"])])
    cond = None
    for i in range(len(by)):
        c = F.col(f"__kx{i}").eqNullSafe(F.col(f"__ky{i}"))
        cond = c if cond is None else cond & c
    plain = all(isinstance(f.dataType, PLAIN_TYPES) for f in [*xs.schema.fields, *ys.schema.fields])
    j = _by_position(xs, ys, "__kx0", "__ky0") if by == ["__row"] and plain else xs.join(ys, cond, "full_outer")
    keys = [F.coalesce(F.col(f"__kx{i}"), F.col(f"__ky{i}")).alias(k) for i, k in enumerate(by)]
    j = j.select(*keys, F.coalesce("__in_x", F.lit(False)).alias("__in_x"),
                 F.coalesce("__in_y", F.lit(False)).alias("__in_y"),
                 *[F.col(f"__x{i}") for i in range(len(rep["compared"]))],
                 *[F.col(f"__y{i}") for i in range(len(rep["compared"]))])
    return j, by


def _in_blocks(df: DataFrame, place: str, block_rows: int) -> DataFrame:
    """``block, size, rows``: runs of rows with consecutive places (from 1), compressed column by column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = (batch.column(place).to_numpy() - 1) // block_rows
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
            held = []
            for at, end in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, end - at))
                held.append(sink.getvalue())
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[cuts[:-1]], pa.int64()), "size": pa.array([b.size for b in held], pa.int64()),
                                              "rows": pa.array([pa.compress(b, "zstd", asbytes=True) for b in held], pa.binary())})
    return df.mapInArrow(run, "block long, size long, rows binary")


def _by_position(xs: DataFrame, ys: DataFrame, kx: str, ky: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Full outer join of two tables on their rows' places (1, 2, ... in each). Blocks of consecutive
    rows meet, not rows: columns of neighbours take far less room in a shuffle than rows."""
    x_names, y_names = xs.columns, ys.columns
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in xs.schema.fields), *(T.StructField(f.name, f.dataType) for f in ys.schema.fields)])

    def table(held: pa.Table, place: str) -> pa.Table | None:
        if not held.num_rows:
            return None
        runs = [pa.ipc.open_stream(pa.decompress(r.as_buffer(), s.as_py(), "zstd")).read_all()
                for r, s in zip(held.column("rows"), held.column("size"))]
        return pa.concat_tables(runs).sort_by(place)

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = table(x, kx), table(y, ky)
        places = np.union1d(*[t.column(k).to_numpy() if t is not None else np.zeros(0, np.int64) for t, k in ((x, kx), (y, ky))])
        out = []
        for t, k, names in ((x, kx, x_names), (y, ky, y_names)):
            if t is None:
                out += [(n, pa.nulls(len(places), kinds[n])) for n in names]
                continue
            at = np.searchsorted(t.column(k).to_numpy(), places)
            at[at == t.num_rows] = 0
            t = t.take(pa.array(at, mask=t.column(k).to_numpy()[at] != places))
            out += [(n, t.column(n)) for n in names]
        return pa.table(dict(out))
    kinds = {f.name: f.type for t in (xs, ys) for f in t.limit(0).toArrow().schema}
    x, y = (_in_blocks(t, k, block_rows).groupBy("block") for t, k in ((xs, kx), (ys, ky)))
    return x.cogroup(y).applyInArrow(met, schema)


def _differs(a: str, b: str, kind: str, tol: float) -> str:
    """SQL text: both null = equal, one null = different, numbers within ``tol``."""
    a, b = f"`{a}`", f"`{b}`"
    if kind == "number":
        # equal infinities and NaN are no difference
        x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        neq = f"NOT ({x} <=> {y}) AND abs({x} - {y}) > {tol!r}"
    else:
        neq = f"{a} <> {b}"
    return f"(({a} IS NULL) <> ({b} IS NULL) OR ({a} IS NOT NULL AND {b} IS NOT NULL AND {neq}))"


def _quoted(name: str) -> str:
    """A name as an SQL text literal."""
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text_sql(name: str, dt: T.DataType) -> str:
    """SQL text rendering of a cell (whole doubles without a fraction), as ``render_text``."""
    c = f"`{name}`"
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = f"CAST({c} AS DOUBLE)"
        return (f"CASE WHEN {d} = floor({d}) AND abs({d}) < 1e15 THEN CAST(CAST({d} AS BIGINT) AS STRING) "
                f"ELSE CAST({d} AS STRING) END")
    if isinstance(dt, T.BooleanType):
        return f"CASE WHEN {c} THEN 'TRUE' WHEN NOT {c} THEN 'FALSE' END"
    return f"CAST({c} AS STRING)"


def compare_tables(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None,
                   tol: float = DEFAULT_TOL, order: Sequence[str] | None = None) -> DataFrame:
    """Differing cells of rows present in both tables: ``by..., variable, value_x, value_y``.

    Without ``by`` rows are aligned by their position: in the ``order`` columns, or without
    those in the order in which the tables (read from Parquet) are stored."""
    j, by = _aligned(x, y, by, order)
    rep = schema_report(x, y, by)
    tx = {f.name: f.dataType for f in x.schema.fields}
    ty = {f.name: f.dataType for f in y.schema.fields}
    keys = [col(k) for k in by]
    both = j.where(F.col("__in_x") & F.col("__in_y"))
    if not rep["compared"]:
        return both.select(*keys, F.lit(None).cast("string").alias("variable"),
                           F.lit(None).cast("string").alias("value_x"),
                           F.lit(None).cast("string").alias("value_y")).limit(0)
    cells = ", ".join(
        f"named_struct('variable', {_quoted(c)}, 'value_x', {_text_sql(f'__x{i}', tx[c])}, "
        f"'value_y', {_text_sql(f'__y{i}', ty[c])}, 'd', {_differs(f'__x{i}', f'__y{i}', _kind(tx[c]), tol)})"
        for i, c in enumerate(rep["compared"]))
    exploded = both.select(*keys, F.expr(f"explode(filter(array({cells}), s -> s.d))").alias("c"))
    return exploded.select(*keys, "c.variable", "c.value_x", "c.value_y")


def compare_unmatched(x: DataFrame, y: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys of the rows that only one table has: ``by..., side`` (``x`` or ``y``), once per row."""
    keys = [col(k) for k in by]
    xs, ys = x.select(*keys, F.lit("x").alias("side")), y.select(*keys, F.lit("y").alias("side"))
    return (null_safe_join(xs, y.select(*keys), list(by), "left_anti")
            .unionByName(null_safe_join(ys, x.select(*keys), list(by), "left_anti")))


def compare_summary(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None,
                    tol: float = DEFAULT_TOL, order: Sequence[str] | None = None) -> DataFrame:
    """The comparison as ``(item, value)`` rows.

    Row counts of each side, rows only in x / y, column counts, the number of
    differing cells per compared variable (zero included), and a row with value 1
    for each column that is not compared or that one table lacks
    (``not_compared:<name>``, ``only_x:<name>``, ``only_y:<name>``). One aggregate
    job over the aligned table; ``compare_unmatched`` lists the unmatched rows.
    """
    j, by = _aligned(x, y, by, order)
    rep = schema_report(x, y, by)
    kind = {f.name: _kind(f.dataType) for f in x.schema.fields}
    both = "(__in_x AND __in_y)"
    aggs = ["CAST(coalesce(sum(CAST(__in_x AS BIGINT)), 0) AS BIGINT) AS nrow_x",
            "CAST(coalesce(sum(CAST(__in_y AS BIGINT)), 0) AS BIGINT) AS nrow_y",
            "CAST(coalesce(sum(CAST(__in_x AND NOT __in_y AS BIGINT)), 0) AS BIGINT) AS rows_only_x",
            "CAST(coalesce(sum(CAST(__in_y AND NOT __in_x AS BIGINT)), 0) AS BIGINT) AS rows_only_y",
            f"CAST(coalesce(sum(CAST({both} AS BIGINT)), 0) AS BIGINT) AS rows_both"]
    for i, c in enumerate(rep["compared"]):
        d = _differs(f"__x{i}", f"__y{i}", kind[c], tol)
        aggs.append(f"CAST(coalesce(sum(CAST({both} AND {d} AS BIGINT)), 0) AS BIGINT) AS {_ident(f'diff:{c}')}")
    fixed = {"ncol_x": len(x.columns), "ncol_y": len(y.columns), "ncol_shared": len(rep["compared"]) +
             len(rep["not_compared"]), "ncol_not_compared": len(rep["not_compared"]),
             "ncol_only_x": len(rep["only_x"]), "ncol_only_y": len(rep["only_y"])}
    fixed |= {f"{kind_}:{c}": 1 for kind_ in ("not_compared", "only_x", "only_y") for c in rep[kind_]}
    counts = j.selectExpr(*[f"{k} AS `{k}`" for k in ("__in_x", "__in_y")],
                          *[f"`__x{i}`" for i in range(len(rep["compared"]))],
                          *[f"`__y{i}`" for i in range(len(rep["compared"]))]) \
        .groupBy().agg(*[F.expr(a) for a in aggs])
    names = counts.columns
    stack = ", ".join(f"{_quoted(n)}, {_ident(n)}" for n in names) + ", " + ", ".join(
        f"{_quoted(k)}, CAST({v} AS BIGINT)" for k, v in fixed.items())
    return counts.selectExpr(f"stack({len(names) + len(fixed)}, {stack}) AS (item, value)")


def compare_bundles(a: dict[str, Sheet], b: dict[str, Sheet], keys: dict[str, Sequence[str]] | None = None,
                    tol: float = DEFAULT_TOL) -> dict[str, DataFrame]:
    """``compare_summary`` for every sheet present in both bundles, in ``a``'s order. A sheet in
    parts is compared in its long form, whatever columns its parts hold."""
    keys = keys or {}
    out = {}
    for s in a:
        if s not in b:
            continue
        x, y, by = a[s], b[s], keys.get(s)
        if isinstance(x, list) or isinstance(y, list):
            first = by[0] if by else (x[0] if isinstance(x, list) else y[0]).columns[0]
            x, y, by = long_sheet(x, first), long_sheet(y, first), [first, "name"]
        out[s] = compare_summary(x, y, by, tol)
    return out
