"""Column helpers that carry the survey semantics (nulls, text, numbers).

Every helper returns a Column expression or a DataFrame built from built-in
functions, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)

# White space the survey tools strip from both ends of a text (fixed value).
WHITESPACE = " \t\r\n"


def col(name: str) -> Column:
    """Column by exact name; dotted option names are not struct paths."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def render_text(c: Column, dtype: T.DataType) -> Column:
    """Text form of a cell: whole doubles print without a fraction (1.0 -> '1')."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
        return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("TRUE")).when(~c, F.lit("FALSE"))
    return c.cast("string")


def safe_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    s = F.trim(c.cast("string"))
    ok = s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(ok, s.try_cast("double"))


def trim_ws(c: Column) -> Column:
    """Strip blanks, tabs and line breaks at both ends."""
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def title_case(c: Column) -> Column:
    return F.initcap(c)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches null keys with each other; keys appear once."""
    lk = {k: f"__l_{i}" for i, k in enumerate(keys)}
    rk = {k: f"__r_{i}" for i, k in enumerate(keys)}
    lft = left.withColumnsRenamed(lk)
    rgt = right.withColumnsRenamed(rk)
    cond = reduce(lambda a, b: a & b, [F.col(lk[k]).eqNullSafe(F.col(rk[k])) for k in keys])
    joined = lft.join(rgt, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined.withColumnsRenamed({v: k for k, v in lk.items()})
    keyed = [F.coalesce(F.col(lk[k]), F.col(rk[k])).alias(k) if how in ("full", "full_outer", "outer", "right", "right_outer")
             else F.col(lk[k]).alias(k) for k in keys]
    rest = [col(c) for c in joined.columns if c not in lk.values() and c not in rk.values()]
    return joined.select(*keyed, *rest)


def union_all_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (presentation and cross-engine comparison)."""
    return df.select(*[
        F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else col(f.name) for f in df.schema.fields])
