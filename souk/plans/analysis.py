"""The analysis run: survey in, the eight indicator sheets out.

``analyse`` returns the sheets as an ordered dict of DataFrames; ``write_analysis``
writes them as one bundle. The wide survey is read once: all cells that the sheets
need are counted in one job (``operators/cells.py``), and the sheets are formed
from the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import indicators as I
from ..operators import rollup as R
from ..operators.cells import Cells
from ..operators.reshape import pivot_wide
from ..session import materialize
from ..sources.io import Sheet, write_bundle

SHEETS = ("items", "stock", "barrier", "payment", "supplier1", "supplier2", "credit1", "credit2")


MOST_COLUMNS = 1000


def _share_sheet(shares: DataFrame, most_columns: int) -> Sheet:
    """A wide share sheet: one table, or parts of ``most_columns`` answers where there are more."""
    found = shares.select("item").distinct().limit(most_columns + 1).count()
    return R.global_shares_wide(shares) if found <= most_columns else R.global_shares_parts(shares, width=most_columns)


def analyse(survey: DataFrame, location: str = "all", date: str = "2008", method: str = "v7",
            most_columns: int = MOST_COLUMNS) -> dict[str, Sheet]:
    """The eight sheets. A v7 share sheet with more than ``most_columns`` different answers is a
    list of tables of that many columns (``write_bundle`` and ``compare_bundles`` take both)."""
    cells = Cells(I.filter_round(survey, location, date))
    # each location table feeds its own rows and the _global ones: computed once
    prices = materialize(cells.price_table())
    stock = materialize(cells.stock_table())
    sn = materialize(cells.supplier_numbers())
    cn = materialize(cells.credit_numbers())
    barriers, payments, suppliers, credits = (materialize(cells.shares(f)) for f in ("barrier", "payment", "supplier", "credit"))
    if method == "v7":
        barrier, payment, credit = (_share_sheet(s, most_columns) for s in (barriers, payments, credits))
    else:
        # v6: location and _global rows pivoted wide, no zero fill, every column
        # (the location too) sorted by name
        barrier, payment, credit = (
            _sorted_columns(pivot_wide(R.with_global(s, R.global_shares_v6(s)), "call_location", "item", "pc"))
            for s in (barriers, payments, credits))
    return {
        "items": I.ordered(R.with_global(prices, R.global_prices(prices, method)), "vendor_type", "item"),
        "stock": I.ordered(R.with_global(stock, R.global_stock(stock, method)), "vendor_type", "item"),
        "barrier": barrier,
        "payment": payment,
        "supplier1": R.with_global(suppliers, R.global_suppliers(suppliers)),
        "supplier2": R.with_global(sn, R.global_supplier_numbers(sn)),
        "credit1": credit,
        "credit2": R.with_global(cn, R.global_credit_numbers(cn)),
    }


def _sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*[df[f"`{c}`"] for c in sorted(df.columns)])


def write_analysis(sheets: dict[str, Sheet], path: str, fmt: str = "parquet") -> None:
    write_bundle({k: sheets[k] for k in SHEETS if k in sheets}, path, fmt=fmt)
