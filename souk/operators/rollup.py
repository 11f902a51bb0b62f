"""The ``_global`` rows: medians of location-level indicators.

Inputs here are already aggregated to one row per location and item, so the
groups are bounded by the number of locations and Spark's built-in exact
``percentile`` is the right tool (it is *not* a rollup of interviews).
``method='v6'`` gives the older variant of prices, stock and shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sem import col, is_numeric, null_safe_join, union_all_by_name
from ..session import materialize
from ..sources.io import with_row_index
from .reshape import pivot_wide

LOC = "call_location"
GLOBAL = "_global"


def _median(c: str) -> F.Column:
    return F.percentile(col(c), 0.5)


def global_prices(prices: DataFrame, method: str = "v7", loc: str = LOC, vendor: str = "vendor_type") -> DataFrame:
    """One ``_global`` row per item and vendor type.

    v7: items with ``check`` only; median of the location q1, q3 and medians.
    v6: every item; q1 / median / q3 of the location medians. ``nv`` is the
    sum over rows, so an item sold by two vendor types counts twice.
    """
    src = prices.where(F.col("check")) if method == "v7" else prices
    if method == "v7":
        aggs = [F.sum("nv").alias("nv"), _median("q1").alias("q1"), _median("q3").alias("q3"),
                _median("median").alias("median")]
    elif method == "v6":
        aggs = [F.sum("nv").alias("nv"), F.percentile(F.col("median"), 0.25).alias("q1"),
                F.percentile(F.col("median"), 0.75).alias("q3"), _median("median").alias("median")]
    else:
        raise ValueError(f"unknown method {method!r}")
    g = src.groupBy("item").agg(*aggs)
    vt = src.select("item", col(vendor)).distinct()
    return (g.join(vt, "item")
             .select("item", F.lit(GLOBAL).alias(loc), "nv", "q1", "q3", "median", col(vendor)))


def global_stock(stock: DataFrame, method: str = "v7", loc: str = LOC, vendor: str = "vendor_type") -> DataFrame:
    """Median of every numeric stock column per item (v7: checked rows only)."""
    src = stock.where(F.col("check")) if method == "v7" else stock
    nums = [f.name for f in src.schema.fields if is_numeric(f.dataType)]
    g = src.groupBy("item").agg(*[_median(c).alias(c) for c in nums])
    vt = src.select("item", col(vendor)).distinct()
    return g.join(vt, "item").select("item", F.lit(GLOBAL).alias(loc), *nums, col(vendor))


def shares_wide(shares: DataFrame, items: list[str] | None = None, loc: str = LOC) -> DataFrame:
    """Location rows of a share sheet: one column per item, missing shares 0."""
    return pivot_wide(shares, loc, "item", "pc", items, fill=0.0)


def global_shares_wide(shares: DataFrame, items: list[str] | None = None, loc: str = LOC) -> DataFrame:
    """v7 share sheet: zero-filled location rows plus a ``_global`` row of medians.

    Columns are sorted by name with the location first.
    """
    wide = shares_wide(shares, items, loc)
    item_cols = [c for c in wide.columns if c != loc]
    glob = wide.agg(*[_median(c).alias(c) for c in item_cols]).withColumn(loc, F.lit(GLOBAL))
    out = union_all_by_name([wide, glob])
    return out.select(col(loc), *[col(c) for c in sorted(item_cols)])


def global_shares_parts(shares: DataFrame, loc: str = LOC, width: int = 1000) -> list[DataFrame]:
    """``global_shares_wide`` in parts of at most ``width`` answer columns (sorted by name over all
    parts), each with the same location rows and the ``_global`` row, for any number of answers.

    Medians are formed in the long table; the names are numbered in Spark, and those of
    one part at a time come to the driver.
    """
    places = materialize(shares.select(col(loc)).distinct())
    n = places.count()
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two rows for one cell: names collide"))).otherwise(F.max("pc"))
    cells = shares.where(F.col("item").isNotNull()).groupBy(col(loc), "item").agg(one.alias("pc"))
    names = with_row_index(cells.select("item").distinct(), ["item"], "at").select("item", F.floor((F.col("at") - 1) / width).cast("int").alias("part"))
    cells = materialize(cells.join(names, "item"))
    # a location without the answer counts as 0: so many zeros come before the shares
    ranked = cells.groupBy("item", "part").agg(F.array_sort(F.collect_list(F.coalesce("pc", F.lit(0.0)))).alias("up"))
    at = lambda k: F.coalesce(F.get("up", F.lit(k) - (F.lit(n) - F.size("up"))), F.lit(0.0))
    glob = ranked.select(F.lit(GLOBAL).alias(loc), "item", (at((n - 1) // 2) * 0.5 + at(n // 2) * 0.5).alias("pc"), "part")
    rows = materialize(cells.select(col(loc), "item", "pc", "part").unionByName(glob))
    places = places.unionByName(places.sparkSession.createDataFrame([(GLOBAL,)], places.schema))
    parts = []
    for k in range((rows.agg(F.max("part")).first()[0] or 0) + 1):
        here = rows.where(F.col("part") == k)
        items = sorted(r["item"] for r in here.select("item").distinct().collect())
        wide = here.groupBy(col(loc)).pivot("item", items).agg(F.max("pc"))
        # a location without any answer of this part has zeros in it
        parts.append(null_safe_join(places, wide, [loc], "left").fillna(0.0, subset=items).select(col(loc), *[col(c) for c in items]))
    return parts


def global_shares_v6(shares: DataFrame, loc: str = LOC) -> DataFrame:
    """v6 ``_global`` rows (long): median n over the locations that have the
    answer, share = n / sum of those medians over the question's answers."""
    g = shares.groupBy("item").agg(_median("n").alias("n"))
    parts = F.split(F.col("item"), "__")
    question = F.get(parts, 0)
    answer = F.get(parts, 1)
    g = g.select(question.alias("question"), answer.alias("answer"), "n")
    t = g.groupBy("question").agg(F.sum("n").alias("t"))
    item = F.concat(F.col("question"), F.lit("__"), F.coalesce(F.col("answer"), F.lit("NA")))
    return (g.join(t, "question")
             .select(F.lit(GLOBAL).alias(loc), item.alias("item"), "n", (F.col("n") / F.col("t")).alias("pc")))


def global_suppliers(shares: DataFrame, loc: str = LOC) -> DataFrame:
    return (shares.groupBy("item").agg(F.sum("n").alias("n"), _median("pc").alias("pc"))
                  .select("item", F.lit(GLOBAL).alias(loc), "n", "pc"))


def global_supplier_numbers(sn: DataFrame, loc: str = LOC, vendor: str = "vendor_type") -> DataFrame:
    return (sn.groupBy(col(vendor)).agg(*[_median(c).alias(c) for c in ("median", "q1", "q3")])
              .select(col(vendor), F.lit(GLOBAL).alias(loc), "median", "q1", "q3"))


def global_credit_numbers(cn: DataFrame, loc: str = LOC) -> DataFrame:
    nums = [f.name for f in cn.schema.fields
            if f.name != loc and isinstance(f.dataType, (T.DoubleType, T.LongType, T.IntegerType))]
    return cn.agg(*[_median(c).alias(c) for c in nums]).select(F.lit(GLOBAL).alias(loc), *nums)


def with_global(local: DataFrame, glob: DataFrame) -> DataFrame:
    """Append the ``_global`` rows to the location rows (missing columns null)."""
    return union_all_by_name([local, glob])
