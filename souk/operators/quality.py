"""Data-quality checks: cleaning log, deletions, interview duration, issues.

Issue tables share one shape: ``index, value, variable, has_issue, issue_type``
(``index`` is the interview's row number, null for column-level findings).
Every check is a join, an aggregate or a projection; none loops over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions.sem import col, is_numeric, null_safe_join, render_text, safe_number, trim_ws

# Labels used in the issue and log-check outputs.
LOG_OK = "Log applied correctly"
LOG_BAD = "Please check log"
MISSING_TEXT = "N/A"
TOO_SHORT = "form duration too short"
TOO_LONG = "form duration too long"
DURATION_VARIABLE = "Completion Duration (min)"
OUTLIER_NORMAL = "outlier (normal distribution)"
OUTLIER_LOG = "outlier (log normal distribution)"
DUPLICATE = "duplicated value"
OTHER_RESPONSE = "'other' response. may need recoding."
SENSITIVE = "potentially sensitive information. Please ensure appropriate data protection"
SENSITIVE_WORDS = ("name", "phone", "gps", "latitude", "longitude", "contact", "geopoint", "email", "address")
# Form types that are not answers (dropped before similarity checks).
NON_ANSWER_TYPES = ("date", "start", "end", "today", "audit", "note", "calculate", "deviceid", "geopoint")


# ---- cleaning log -------------------------------------------------------------

def log_unknown_uuids(log: DataFrame, data: DataFrame, deletions: DataFrame, uuid_log: str = "uuid",
                      uuid_data: str = "uuid", uuid_del: str = "uuid") -> DataFrame:
    """Log rows whose interview is not in the data but is listed as deleted."""
    absent = null_safe_join(log, data.select(col(uuid_data).alias(uuid_log)), [uuid_log], "left_anti")
    return null_safe_join(absent, deletions.select(col(uuid_del).alias(uuid_log)), [uuid_log], "left_semi")


def log_unknown_questions(log: DataFrame, data: DataFrame, variable: str = "question") -> DataFrame:
    """Log rows naming a question that is not a column of the data."""
    return log.where(~col(variable).isin(list(data.columns)) | col(variable).isNull())


def restrict_log(log: DataFrame, data: DataFrame, variable: str = "question", uuid_log: str = "uuid",
                 uuid_data: str = "uuid") -> DataFrame:
    """Log rows that point into the data (known interview, known question)."""
    known = null_safe_join(log, data.select(col(uuid_data).alias(uuid_log)), [uuid_log], "left_semi")
    return known.where(col(variable).isin(list(data.columns)))


def undeleted(deletions: DataFrame, data: DataFrame, uuid_del: str = "uuid", uuid_data: str = "uuid") -> DataFrame:
    """Interviews listed for deletion that are still in the data."""
    return null_safe_join(deletions, data.select(col(uuid_data).alias(uuid_del)), [uuid_del], "left_semi")


def check_log(data: DataFrame, log: DataFrame, variable: str = "question", old_var: str = "old_value",
              new_var: str = "new_value", uuid_data: str = "uuid", uuid_log: str = "uuid") -> DataFrame:
    """Log edits that are not reflected in the data.

    For each log row the cell (interview, question) is looked up, rendered as
    text, trimmed; missing values on either side read ``N/A``. Rows whose new
    value differs from the cell are returned with ``check = 'Please check log'``.
    The log should be restricted first (``restrict_log``); a log row whose
    question is unknown yields ``N/A`` as its cell. One output row per log row
    and matching interview.

    The logged questions are read from the log (a short driver-side list,
    bounded by the number of columns) so that only they are projected from the
    data before the join on the interview key.
    """
    asked = sorted(r[0] for r in log.where(col(variable).isin(list(data.columns))).select(variable).distinct().collect())
    types = {f.name: f.dataType for f in data.schema.fields}
    data_cols = [col(uuid_data).alias("__uuid")] + [render_text(col(c), types[c]).alias(f"__q{i}")
                                                   for i, c in enumerate(asked)]
    # only the logged interviews' cells go on: the log is short, the data need not be
    logged = log.select(col(uuid_log).alias("__logged")).distinct()
    cells = data.join(logged, col(uuid_data).eqNullSafe(F.col("__logged")), "left_semi").select(*data_cols)
    cell = F.lit(None).cast("string")
    for i, c in enumerate(asked):
        cell = F.when(col(variable) == c, F.col(f"__q{i}")).otherwise(cell)
    joined = log.join(cells, col(uuid_log).eqNullSafe(F.col("__uuid")), "left")
    na = F.lit(MISSING_TEXT)
    value = trim_ws(F.coalesce(cell, na))
    new = F.coalesce(trim_ws(col(new_var)), na)
    old = F.coalesce(trim_ws(col(old_var)), na)
    out = joined.select(F.coalesce(col(uuid_log), na).alias(uuid_log), F.coalesce(col(variable), na).alias(variable),
                        old.alias(old_var), new.alias(new_var), value.alias("value_extracted"))
    check = F.when(F.col(new_var) == F.col("value_extracted"), F.lit(LOG_OK)).otherwise(F.lit(LOG_BAD))
    return out.withColumn("check", check).where(F.col("check") == LOG_BAD)


# ---- interview duration -------------------------------------------------------

def _minutes(ts: F.Column) -> F.Column:
    """Clock part of ``YYYY-MM-DDThh:mm:ss...`` in minutes, rounded to 2 decimals."""
    clock = F.substring_index(ts, "T", -1)
    h = F.substring(clock, 1, 2).try_cast("double")
    m = F.substring(clock, 4, 2).try_cast("double")
    s = F.substring(clock, 7, 2).try_cast("double")
    return F.round(h * 60 + m + s / 60, 2)


def check_time(data: DataFrame, lower: float, upper: float, start: str = "start", end: str = "end") -> DataFrame:
    """Interviews started and ended on one date that took ``<= lower`` or ``>= upper`` minutes.

    ``start`` / ``end`` are ISO texts ``YYYY-MM-DDThh:mm:ss...``; fractions of
    a second and offsets are ignored. Output: uuid, value (minutes), variable,
    has_issue, issue_type. Stateless, so it also runs on a streaming DataFrame.
    """
    for c in (start, end):
        if c not in data.columns:
            raise ValueError(f"check_time: no column {c!r} in the data")
    data = N.unique_rename(data, "uuid", "uuid")
    days = F.datediff(F.try_to_date(F.substring_index(col(end), "T", 1)),
                      F.try_to_date(F.substring_index(col(start), "T", 1)))
    minutes = _minutes(col(end)) - _minutes(col(start))
    issue = (F.when(minutes <= F.lit(float(lower)), F.lit(TOO_SHORT))
             .when(minutes >= F.lit(float(upper)), F.lit(TOO_LONG)))
    return (data.where(days == 0)
                .select(col("uuid"), minutes.alias("value"), F.lit(DURATION_VARIABLE).alias("variable"),
                        F.lit("TRUE").alias("has_issue"), issue.alias("issue_type"))
                .where(F.col("issue_type").isNotNull()))


# ---- generic issue scan ---------------------------------------------------------

def _issue(index: F.Column, value: F.Column, variable: F.Column, issue_type: str | F.Column) -> list[F.Column]:
    it = F.lit(issue_type) if isinstance(issue_type, str) else issue_type
    return [index.cast("long").alias("index"), value.alias("value"), variable.alias("variable"),
            F.lit(True).alias("has_issue"), it.alias("issue_type")]


def numeric_columns(data: DataFrame, skip: Sequence[str] = ("index",)) -> list[str]:
    """Numeric answer columns: numbers that are not keys nor ticked options."""
    return [f.name for f in data.schema.fields
            if is_numeric(f.dataType) and f.name not in skip and "." not in f.name and "/" not in f.name]


def find_outliers(data: DataFrame, columns: Sequence[str] | None = None, k: float = 3.0,
                  index: str = "index") -> DataFrame:
    """Values more than ``k`` standard deviations from their column mean, raw or in logs.

    One aggregate without unpivot gives every column's statistics (one row, read on
    the driver, as wide as the table); one pass over the rows then keeps the cells
    that exceed them. A value that is out on both scales gives two issues.
    """
    columns = list(columns) if columns is not None else numeric_columns(data, (index,))
    stats = column_stats(data, columns)
    return outlier_cells(data, stats, columns, k, index)


def column_stats(data: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """Per column: mean and standard deviation of the values, and of the logs of the positive ones."""
    aggs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        lv = F.when(v > 0, F.ln(v))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.avg(lv).alias(f"lm{i}"), F.stddev_samp(lv).alias(f"ls{i}")]
    row = data.agg(*aggs).first() if aggs else None
    return {c: (row[f"m{i}"], row[f"s{i}"], row[f"lm{i}"], row[f"ls{i}"]) for i, c in enumerate(columns)}


def outlier_cells(data: DataFrame, stats: dict[str, tuple], columns: Sequence[str], k: float = 3.0,
                  index: str = "index") -> DataFrame:
    """The issue rows of the cells beyond ``stats``; stateless, so it also runs on a stream."""
    def issue(c: str, value: F.Column, kind: str, out: F.Column) -> F.Column:
        return F.when(out, F.struct(F.lit(c).alias("variable"), value.alias("value"), F.lit(kind).alias("issue_type")))
    cells = []
    for c in columns:
        m, s, lm, ls = (F.lit(x).cast("double") for x in stats[c])
        v = col(c).cast("double")
        cells.append(issue(c, v, OUTLIER_NORMAL, F.abs(v - m) > F.lit(k) * s))
        cells.append(issue(c, v, OUTLIER_LOG, (v > 0) & (F.abs(F.ln(v) - lm) > F.lit(k) * ls)))
    if not cells:
        cells = [F.lit(None).cast("struct<variable:string,value:double,issue_type:string>")]
    found = data.select(col(index), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("i"))
    return found.select(*_issue(col(index), F.col("i.value"), F.col("i.variable"), F.col("i.issue_type")))


def find_duplicates(data: DataFrame, column: str = "uuid", index: str = "index") -> DataFrame:
    """Rows whose ``column`` value occurs more than once.

    Counting is a map-side-combined aggregate, so a hot value is never gathered
    in one task; the repeated values are then joined back to their rows.
    """
    dups = (data.groupBy(col(column)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
                .select(col(column).alias("__dup")))
    hits = data.join(dups, col(column).eqNullSafe(F.col("__dup")), "inner")
    return hits.select(*_issue(col(index), col(column).cast("string"), F.lit(column), DUPLICATE))


def find_other_responses(data: DataFrame, suffix: str = "_other") -> DataFrame:
    """Frequencies of free-text answers in ``*_other`` columns (index is null)."""
    cols = N.ends_with(data.columns, suffix)
    types = {f.name: f.dataType for f in data.schema.fields}
    long = (data.select(*[render_text(col(c), types[c]).alias(c) for c in cols])
                .unpivot([], [col(c) for c in cols], "variable", "value")
                .where(F.col("value").isNotNull()))
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*_issue(F.lit(None), F.col("value"), F.col("variable"), OTHER_RESPONSE), "n")


def sensitive_columns(data: DataFrame, words: Sequence[str] = SENSITIVE_WORDS) -> DataFrame:
    """Columns whose name suggests personal data (a schema check, no data read)."""
    hits = [c for c in data.columns if any(w in c.lower() for w in words)]
    spark = data.sparkSession
    rows = [(None, None, c, True, SENSITIVE) for c in hits]
    return spark.createDataFrame(rows, "index bigint, value string, variable string, has_issue boolean, "
                                       "issue_type string")


def inspect_all(data: DataFrame, uuid: str = "uuid", index: str = "index") -> DataFrame:
    """Outliers, duplicated interview keys, 'other' answers and sensitive names, in one table."""
    parts = [find_outliers(data, index=index).withColumn("value", render_text(F.col("value"), T.DoubleType())),
             find_duplicates(data, uuid, index), find_other_responses(data).drop("n"),
             sensitive_columns(data)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach_issue_owner(issues: DataFrame, data: DataFrame, log: DataFrame | None = None,
                       mode: str = "drop_logged", index: str = "index", uuid: str = "uuid",
                       owner: str = "enumerator_org", uuid_log: str = "uuid") -> DataFrame:
    """Add the interview key and its owner to each issue (lookup by row index).

    "other" answers are dropped. ``mode='drop_logged'`` keeps issues of
    interviews absent from the cleaning log; ``'keep_logged'`` keeps only
    issues of logged interviews (and drops issues without an index).
    """
    iss = issues.where(~F.coalesce(F.col("issue_type").contains(OTHER_RESPONSE), F.lit(False)))
    owners = data.select(col(index).alias("__idx"), col(uuid).alias("uuid"), col(owner).alias("ngo"))
    out = iss.join(owners, F.col("index").eqNullSafe(F.col("__idx")), "left").drop("__idx")
    if log is None:
        return out
    logged = log.select(col(uuid_log).alias("uuid"))
    if mode == "drop_logged":
        return null_safe_join(out, logged, ["uuid"], "left_anti")
    if mode == "keep_logged":
        return null_safe_join(out.where(F.col("index").isNotNull()), logged, ["uuid"], "left_semi")
    raise ValueError(f"unknown mode {mode!r}")


# ---- types from the form ------------------------------------------------------------

def tool_types(tool: DataFrame, name: str = "name", type_: str = "type") -> dict[str, str]:
    """The form as a dict (one row per question: small, read once on the driver)."""
    return {r[0]: r[1] for r in tool.select(name, type_).collect()}


def convert_col_types(data: DataFrame, types: dict[str, str]) -> DataFrame:
    """Numbers for integer / decimal / calculate questions, text for the rest.

    Select questions and options (a ``/`` in the name) stay text and are
    treated as categories by the similarity checks.
    """
    dtypes = {f.name: f.dataType for f in data.schema.fields}
    out = []
    for c in data.columns:
        t = types.get(c)
        if t in ("integer", "decimal", "calculate"):
            out.append(safe_number(render_text(col(c), dtypes[c])).alias(c))
        else:
            out.append(render_text(col(c), dtypes[c]).alias(c))
    return data.select(*out)
