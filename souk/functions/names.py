"""Column selectors: survey tables are wide, and names carry meaning.

``.`` separates a select-multiple question from its option, the last ``_``
separates an item from its unit or statistic, ``__`` separates a question from
its answer. Prefix and suffix tests ignore case, as the survey tools do. All of
this is driver-side work on the schema, never on the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame


def _as_tuple(x: str | Iterable[str]) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


def starts_with(columns: Iterable[str], prefixes: str | Iterable[str]) -> list[str]:
    p = tuple(s.lower() for s in _as_tuple(prefixes))
    return [c for c in columns if c.lower().startswith(p)]


def ends_with(columns: Iterable[str], suffixes: str | Iterable[str]) -> list[str]:
    s = tuple(x.lower() for x in _as_tuple(suffixes))
    return [c for c in columns if c.lower().endswith(s)]


def containing(columns: Iterable[str], parts: str | Iterable[str]) -> list[str]:
    p = [x.lower() for x in _as_tuple(parts)]
    return [c for c in columns if any(x in c.lower() for x in p)]


def drop_names(columns: Iterable[str], drop: Iterable[str]) -> list[str]:
    d = set(drop)
    return [c for c in columns if c not in d]


def select_multiple_parents(columns: Iterable[str]) -> list[str]:
    """Questions whose name occurs more than once once cut at the first dot.

    ``barrier_transport``, ``barrier_transport.road``, ... -> ``barrier_transport``.
    """
    cut = [c.split(".", 1)[0] for c in columns]
    counts = Counter(cut)
    seen, out = set(), []
    for c in cut:
        if counts[c] > 1 and c not in seen:
            seen.add(c)
            out.append(c)
    return out


def question_columns(df: DataFrame, prefixes, *, exclude_contains=(), exclude_prefixes=(),
                     keep_other: bool = False) -> list[str]:
    """Categorical question columns by prefix, minus ``*_other`` and parents."""
    cols = starts_with(df.columns, prefixes)
    if exclude_contains:
        bad = set(containing(cols, exclude_contains))
        cols = [c for c in cols if c not in bad]
    if not keep_other:
        other = set(ends_with(cols, "_other"))
        cols = [c for c in cols if c not in other]
    if exclude_prefixes:
        bad = set(starts_with(cols, exclude_prefixes))
        cols = [c for c in cols if c not in bad]
    return drop_names(cols, select_multiple_parents(df.columns))


def unique_rename(df: DataFrame, contains: str, to: str) -> DataFrame:
    """Rename the single column whose name contains ``contains``."""
    hits = [c for c in df.columns if contains in c]
    if len(hits) > 1:
        raise ValueError(f"more than one column contains {contains!r}: {hits}")
    return df.withColumnRenamed(hits[0], to) if hits and hits[0] != to else df


def drop_all_null_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns without any value (one aggregate pass, partial per task)."""
    from pyspark.sql import functions as F

    keep = set(keep)
    check = [c for c in df.columns if c not in keep]
    if not check:
        return df
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(check)]).first()
    empty = {c for i, c in enumerate(check) if counts[f"c{i}"] == 0}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in empty])
