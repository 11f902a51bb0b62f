"""The comparison run: two analysed bundles in, one summary per shared sheet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sem import union_all_by_name
from ..operators.compare import compare_bundles
from ..sources.io import read_bundle

# Row keys of the analysis sheets (sheets are compared on these, not on position).
SHEET_KEYS = {
    "items": ["call_location", "item", "vendor_type"],
    "stock": ["call_location", "item", "vendor_type"],
    "barrier": ["call_location"],
    "payment": ["call_location"],
    "supplier1": ["call_location", "item"],
    "supplier2": ["call_location", "vendor_type"],
    "credit1": ["call_location"],
    "credit2": ["call_location"],
}


def compare_runs(spark: SparkSession, path_a: str, path_b: str, tol: float = 1.5e-8, keyed: bool = True) -> DataFrame:
    """Summary rows ``sheet, item, value`` for every sheet of ``a`` that ``b`` also has.

    Rows are matched by the sheets' keys, or (``keyed=False``) by their place in the sheet.

    Sheets only in one bundle are reported with item ``sheet_missing``.
    """
    a, b = read_bundle(spark, path_a), read_bundle(spark, path_b)
    parts = [df.select(F.lit(name).alias("sheet"), "item", "value")
             for name, df in compare_bundles(a, b, SHEET_KEYS if keyed else None, tol).items()]
    missing = [(s, "sheet_missing_in_b", 1) for s in a if s not in b] + \
              [(s, "sheet_missing_in_a", 1) for s in b if s not in a]
    if missing:
        parts.append(spark.createDataFrame(missing, "sheet string, item string, value long"))
    return union_all_by_name(parts)
