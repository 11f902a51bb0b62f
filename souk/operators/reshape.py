"""Wide <-> long reshaping and answer shares.

Survey tables are wide (one column per question or option). Every indicator
turns the chosen columns long with ``unpivot`` first; Spark plans the unpivot
as an Expand in the same stage as the partial aggregate that follows, so the
long table is never materialised and duplicates combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sem import col, null_safe_join, render_text


def long_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                name: str = "item", value: str = "value", as_text: bool = False) -> DataFrame:
    """Unpivot ``columns`` into ``(keys, name, value)``; null cells are kept.

    Values are cast to one type: double, or text rendered per ``render_text``.
    """
    if not columns:
        raise ValueError("no columns to unpivot")
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    vals = [(render_text(col(c), types[c]) if as_text else col(c).cast("double")).alias(c)
            for c in columns]
    narrow = df.select(*[col(k) for k in keys], *vals)
    return narrow.unpivot([col(k) for k in keys], [col(c) for c in columns], name, value)


def answer_counts(df: DataFrame, columns: Sequence[str], loc: str = "call_location") -> DataFrame:
    """``(loc, name, value, n)``: answer frequencies per location, null answers included."""
    long = long_values(df, [loc], columns, "name", "value", as_text=True)
    return long.groupBy(col(loc), "name", "value").agg(F.count(F.lit(1)).alias("n"))


def shares_from_counts(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Share of each non-null answer among the non-null answers of its group.

    The denominator is a grouped sum over the counts table (one row per group
    and question) joined back on the group keys, so a question with many
    distinct answers (free text) never sits in one window partition.
    """
    keys = list(group) + ["name"]
    answered = counts.where(F.col("value").isNotNull())
    nn = answered.groupBy(*[col(k) for k in keys]).agg(F.sum("n").alias("nn"))
    return (null_safe_join(answered, nn, keys, "inner")
            .withColumn("pc", F.col("n") / F.col("nn")))


def answer_shares(df: DataFrame, columns: Sequence[str], loc: str = "call_location") -> DataFrame:
    """Shares of answers per location, as the analysis sheets name them.

    ``item`` is ``question__answer``; answers starting with 0 (unticked
    options) are dropped, ``__1`` (ticked) is removed, ``.`` becomes ``__``.
    Output: ``loc, item, n, pc``.
    """
    return share_items(answer_counts(df, columns, loc), loc)


def share_items(counts: DataFrame, loc: str = "call_location") -> DataFrame:
    """``answer_shares`` of answers already counted."""
    shares = shares_from_counts(counts, [loc])
    key = F.concat(F.col("name"), F.lit("__"), F.col("value"))
    item = F.replace(F.replace(key, F.lit("__1"), F.lit("")), F.lit("."), F.lit("__"))
    return (shares.where(~key.contains("__0"))
                  .select(col(loc), item.alias("item"), F.col("n"), F.col("pc")))


def pivot_wide(long: DataFrame, key: str, name: str, value: str, names: Sequence[str] | None = None,
               fill: float | None = None, max_names: int = 5000) -> DataFrame:
    """One row per ``key``, one column per ``name`` value (sorted), filled where asked.

    Two rows for one cell raise an error (two answers whose names collide) instead of
    one of them winning. ``names`` may be given to skip the distinct pass; otherwise at
    most ``max_names`` + 1 names come to the driver, and more than ``max_names`` columns
    are refused: such an item belongs in the long form.
    """
    if names is None:
        found = long.where(col(name).isNotNull()).select(name).distinct().limit(max_names + 1).collect()
        if len(found) > max_names:
            raise ValueError(f"more than {max_names} different {name!r} values: keep the long form, or declare names")
        names = sorted(r[0] for r in found)
    one = F.when(F.count(col(value)) > 1, F.raise_error(F.lit("two rows for one cell: names collide"))).otherwise(F.max(col(value)))
    wide = long.groupBy(col(key)).pivot(name, list(names)).agg(one)
    if fill is not None:
        wide = wide.fillna(fill, subset=list(names))
    return wide
