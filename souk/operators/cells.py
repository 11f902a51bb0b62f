"""Every cell that the eight sheets need, counted in one read of the survey.

The sheets take prices, stock, answers and amounts from hundreds of columns of
the same interviews. Here one job reads the survey, turns all those columns long
at once, each cell tagged with the part of the sheets it feeds, and counts equal
cells by (part, location, vendor type, question, value); duplicates combine
before the shuffle. The counts are stored by part, so a sheet reads its own part
only, and every indicator is formed from counts, never from interviews again.

The vendor type is part of the key only where a sheet needs it (prices, numbers
of suppliers). Null cells are counted like others: a location whose interviews
left a question empty still has its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.sem import col, render_text, safe_number
from ..session import materialize, stored
from . import indicators as I
from .reshape import share_items

SUPPLIER_NUMBER = "supplier_number"


def cell_counts(df: DataFrame, loc: str = I.LOC, vendor: str = I.VENDOR) -> DataFrame:
    """``part, loc, vendor, name, num, text, n``: how often each cell occurs."""
    df = I.with_other_effects(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    no_vendor, no_num, no_text = F.lit(None).cast(types[vendor]), F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = []

    def add(part: str, columns: list[str], num=None, text=None, by_vendor: bool = False) -> None:
        if not columns:
            raise ValueError(f"no columns for {part}")
        for c in columns:
            cells.append(F.struct(
                F.lit(part).alias("part"), (col(vendor) if by_vendor else no_vendor).alias(vendor), F.lit(c).alias("name"),
                (num(c) if num else no_num).alias("num"), (text(c) if text else no_text).alias("text")))

    def answer(c):
        return render_text(col(c), types[c])
    add("price", I.price_columns(df), num=lambda c: col(c).cast("double"), by_vendor=True)
    add("stock", I.stock_columns(df), num=lambda c: col(c).cast("double"))
    add("difficulty", I.difficulty_columns(df), text=lambda c: I.fold_difficulty(col(c)))
    add("barrier", I.barrier_columns(df), text=answer)
    add("payment", I.payment_columns(df), text=answer)
    add("supplier", I.supplier_columns(df), text=answer)
    add("credit", I.credit_columns(df), text=answer)
    add("supplier_number", [SUPPLIER_NUMBER], num=lambda c: safe_number(answer(c)), by_vendor=True)
    add("credit_number", I.credit_number_columns(df), num=lambda c: safe_number(answer(c)))
    long = df.select(col(loc), F.inline(F.array(*cells)))
    return long.groupBy("part", col(loc), col(vendor), "name", "num", "text").agg(F.count(F.lit(1)).alias("n"))


class Cells:
    """The location tables of the sheets, formed from the stored counts of one survey."""

    def __init__(self, df: DataFrame, loc: str = I.LOC, vendor: str = I.VENDOR):
        self.loc, self.vendor = loc, vendor
        self.amounts = I.credit_number_columns(df)
        self.counts = stored(cell_counts(df, loc, vendor), "cells", "part")
        self.sold = materialize(self._part("price").where(F.col("num").isNotNull()).select(
            col(vendor), F.col("name").alias("item")).distinct())

    def _part(self, part: str) -> DataFrame:
        return self.counts.where(F.col("part") == part)

    def _quantiles(self, part: str, keys: list[str], count_name: str | None = "nv") -> DataFrame:
        values = self._part(part).withColumnRenamed("name", "item")
        return exact_quantiles(values, keys, "num", count_name=count_name, weight="n")

    def _answers(self, part: str) -> DataFrame:
        return self._part(part).select(col(self.loc), "name", F.col("text").alias("value"), "n")

    def price_table(self) -> DataFrame:
        return I.price_rows(self._quantiles("price", [self.loc, "item"]), self.sold, self.loc, self.vendor)

    def stock_table(self) -> DataFrame:
        return I.stock_rows(self._quantiles("stock", [self.loc, "item"]), I.difficulty_rows(self._answers("difficulty"), self.loc),
                            I.without_unit(self.sold, self.vendor), self.loc, self.vendor)

    def shares(self, family: str) -> DataFrame:
        """Answer shares of ``barrier``, ``payment``, ``supplier`` or ``credit``."""
        return share_items(self._answers(family), self.loc)

    def supplier_numbers(self) -> DataFrame:
        return I.supplier_number_rows(self._quantiles("supplier_number", [self.loc, self.vendor], None), self.loc, self.vendor)

    def credit_numbers(self) -> DataFrame:
        return I.credit_number_rows(self._quantiles("credit_number", [self.loc, "item"], None), self.amounts, self.loc)
