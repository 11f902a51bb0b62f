"""Per-location market indicators: prices, stock, answer shares, numbers.

Each function takes the wide survey DataFrame and returns one long or wide
indicator table. Groups are (location, item); the heavy step in each is one
aggregation over the unpivoted columns, with exact quantiles computed by
``exact_quantiles`` so that no location has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.quantiles import exact_quantiles
from ..functions.sem import col, null_safe_join, render_text, safe_number, title_case
from ..session import materialize
from .reshape import answer_counts, answer_shares, long_values, shares_from_counts

LOC = "call_location"
VENDOR = "vendor_type"

# Item-name parts for which two prices already make a valid
# indicator (water sellers); every other item needs three.
WATER_ITEM_MARKS = ("truck", "communal", "piped")


def check_flag(item: F.Column, nv: F.Column) -> F.Column:
    water = item.contains(WATER_ITEM_MARKS[0])
    for mark in WATER_ITEM_MARKS[1:]:
        water = water | item.contains(mark)
    return F.when(water, nv > 1).otherwise(nv > 2)


def filter_round(df: DataFrame, location: str = "all", date: str = "2008",
                 loc: str = LOC, date_col: str = "jmmi_date") -> DataFrame:
    """Keep one location and / or one round (YYMM); ``all`` / ``2008`` keep everything."""
    if location != "all":
        df = df.where(col(loc) == location)
    if date != "2008":
        df = df.where(col(date_col) == date)
    return df


def interviews_per_location(df: DataFrame, loc: str = LOC) -> DataFrame:
    return df.groupBy(col(loc)).agg(F.count(F.lit(1)).alias("nn"))


def price_columns(df: DataFrame) -> list[str]:
    cols = N.starts_with(df.columns, "price_usd_")
    return N.drop_names(cols, N.ends_with(cols, "_other"))


def vendor_items(df: DataFrame, vendor: str = VENDOR) -> DataFrame:
    """Distinct (vendor type, price column) pairs with at least one price."""
    long = long_values(df, [vendor], price_columns(df), "item", "value")
    return long.where(F.col("value").isNotNull()).select(col(vendor), "item").distinct()


def vendor_items_no_unit(df: DataFrame, vendor: str = VENDOR) -> DataFrame:
    """Vendor items with the unit cut at the last ``_`` and the prefix removed."""
    return without_unit(vendor_items(df, vendor), vendor)


def without_unit(sold: DataFrame, vendor: str = VENDOR) -> DataFrame:
    item = F.replace(F.regexp_extract(F.col("item"), r"^(.*)_[^_]*$", 1), F.lit("price_usd_"), F.lit(""))
    return sold.select(col(vendor), item.alias("item")).distinct()


def price_table(df: DataFrame, loc: str = LOC, vendor: str = VENDOR) -> DataFrame:
    """Per location and price item: nv, median, q1, q3, check, vendor type.

    The grid is complete (items nobody priced have nv 0). An item sold by
    several vendor types appears once per type.
    """
    long = long_values(df, [loc], price_columns(df), "item", "value")
    return price_rows(exact_quantiles(long, [loc, "item"], "value"), vendor_items(df, vendor), loc, vendor)


def price_rows(stats: DataFrame, sold: DataFrame, loc: str = LOC, vendor: str = VENDOR) -> DataFrame:
    """The price table of quantiles per location and price column and of the ``vendor_items``."""
    stats = stats.withColumn("check", check_flag(F.col("item"), F.col("nv")))
    joined = stats.join(sold, "item", "left")
    shown = title_case(F.replace(F.replace(F.col("item"), F.lit("price_usd_"), F.lit("")), F.lit("_"), F.lit(" ")))
    return joined.select(col(loc), shown.alias("item"), "nv", "median", "q1", "q3", "check", col(vendor))


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Sheet order: ascending, nulls last."""
    return df.orderBy(*[col(k).asc_nulls_last() for k in keys])


def availability_table(prices: DataFrame, loc: str = LOC, vendor: str = VENDOR) -> DataFrame:
    return prices.select(col(loc), "item", "nv", col(vendor))


def stock_columns(df: DataFrame) -> list[str]:
    return N.starts_with(df.columns, ("stock_len_", "stock_time_"))


def stock_quantiles(df: DataFrame, loc: str = LOC) -> DataFrame:
    long = long_values(df, [loc], stock_columns(df), "item", "value")
    return exact_quantiles(long, [loc, "item"], "value")


def stock_length(stock_q: DataFrame, loc: str = LOC) -> DataFrame:
    return (stock_q.where(F.col("item").contains("stock_len_"))
            .select(col(loc), F.replace("item", F.lit("stock_len_"), F.lit("")).alias("item"), "nv",
                    F.col("median").alias("len_m"), F.col("q1").alias("len_q1"), F.col("q3").alias("len_q3")))


def stock_time(stock_q: DataFrame, loc: str = LOC) -> DataFrame:
    return (stock_q.where(F.col("item").contains("stock_time_"))
            .select(col(loc), F.replace("item", F.lit("stock_time_"), F.lit("")).alias("item"),
                    F.col("median").alias("tim_m"), F.col("q1").alias("tim_q1"), F.col("q3").alias("tim_q3")))


def stock_difficulty(df: DataFrame, loc: str = LOC) -> DataFrame:
    """Share of vendors who find restocking difficult, per location and item.

    ``dk`` and ``pnta`` count as ``no``. Where every answer is no, a ``yes``
    row with 0 is made so the item still shows.
    """
    cols = difficulty_columns(df)
    folded = df.select(col(loc), *[fold_difficulty(col(c)).alias(c) for c in cols])
    return difficulty_rows(answer_counts(folded, cols, loc), loc)


def difficulty_columns(df: DataFrame) -> list[str]:
    return N.starts_with(df.columns, "stock_dif_")


def fold_difficulty(answer: F.Column) -> F.Column:
    return F.replace(F.replace(answer, F.lit("dk"), F.lit("no")), F.lit("pnta"), F.lit("no"))


def difficulty_rows(counts: DataFrame, loc: str = LOC) -> DataFrame:
    """Difficulty per location and item of the folded answers' counts."""
    counts = counts.where(F.col("value").isNotNull())
    yes, no, nn = (F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (F.col("value") == "yes", F.col("value") == "no", F.lit(True)))
    found = counts.groupBy(col(loc), "name").agg(yes.alias("dif"), no.alias("no"), nn.alias("nn"))
    item = F.replace(F.col("name"), F.lit("stock_dif_"), F.lit(""))
    return found.where((F.col("dif") > 0) | (F.col("no") == F.col("nn"))).select(
        col(loc), item.alias("item"), "dif", (F.col("dif") / F.col("nn")).alias("dif_pc"))


def stock_table(df: DataFrame, loc: str = LOC, vendor: str = VENDOR) -> DataFrame:
    """Stock sheet: length, time and difficulty per location and item, with vendor type."""
    return stock_rows(stock_quantiles(df, loc), stock_difficulty(df, loc), vendor_items_no_unit(df, vendor), loc, vendor)


def stock_rows(quantiles: DataFrame, difficulty: DataFrame, sold: DataFrame, loc: str = LOC, vendor: str = VENDOR) -> DataFrame:
    """The stock sheet of its three tables and of the ``vendor_items_no_unit``."""
    sq = materialize(quantiles)  # location-level: feeds the length and the time side
    both = null_safe_join(stock_length(sq, loc), stock_time(sq, loc), [loc, "item"], "full")
    both = null_safe_join(both, difficulty, [loc, "item"], "full")
    both = both.join(sold, "item", "left")
    both = both.where(F.col("len_m").isNotNull())
    return both.select(col(loc), "item", "nv", "len_m", "len_q1", "len_q3", "tim_m", "tim_q1", "tim_q3",
                       "dif", "dif_pc", col(vendor), check_flag(F.col("item"), F.col("nv")).alias("check"))


# Question families of the answer-share sheets (fixed prefixes of the form).
BARRIER_PREFIXES = ("barrier_",)
PAYMENT_PREFIXES = ("currency_", "payment_", "barter_")
SUPPLIER_PREFIXES = ("supplier_", "transportation_")
CREDIT_PREFIXES = ("credit_", "cva_", "customer_", "gender_")
CREDIT_NUMBER_PREFIXES = ("credit_max", "credit_total")


def barrier_columns(df: DataFrame) -> list[str]:
    return N.question_columns(df, BARRIER_PREFIXES)


def payment_columns(df: DataFrame) -> list[str]:
    return N.question_columns(df, PAYMENT_PREFIXES)


def supplier_columns(df: DataFrame) -> list[str]:
    return N.question_columns(df, SUPPLIER_PREFIXES, exclude_contains=("supplier_number",))


def credit_columns(df: DataFrame) -> list[str]:
    return N.question_columns(df, CREDIT_PREFIXES, exclude_prefixes=CREDIT_NUMBER_PREFIXES)


def credit_number_columns(df: DataFrame) -> list[str]:
    return N.starts_with(df.columns, CREDIT_NUMBER_PREFIXES)


def with_other_effects(df: DataFrame) -> DataFrame:
    """The free text of ``cva_effect_other`` once more, under a name that the share sheets keep."""
    return df.withColumn("cva_effect_others", col("cva_effect_other")) if "cva_effect_other" in df.columns else df


def barrier_shares(df: DataFrame, loc: str = LOC) -> DataFrame:
    return answer_shares(df, barrier_columns(df), loc)


def payment_shares(df: DataFrame, loc: str = LOC) -> DataFrame:
    return answer_shares(df, payment_columns(df), loc)


def supplier_shares(df: DataFrame, loc: str = LOC) -> DataFrame:
    return answer_shares(df, supplier_columns(df), loc)


def credit_shares(df: DataFrame, loc: str = LOC) -> DataFrame:
    """Credit, cash-assistance, customer and gender questions.

    The free text of ``cva_effect_other`` is kept under ``cva_effect_others``.
    """
    df = with_other_effects(df)
    return answer_shares(df, credit_columns(df), loc)


def supplier_numbers(df: DataFrame, loc: str = LOC, vendor: str = VENDOR,
                     column: str = "supplier_number") -> DataFrame:
    """Quartiles of the number of suppliers per location and vendor type (no water sellers)."""
    num = df.select(col(loc), col(vendor), safe_number(render_text(col(column), df.schema[column].dataType))
                    .alias("_x"))
    return supplier_number_rows(exact_quantiles(num, [loc, vendor], "_x", count_name=None), loc, vendor)


def supplier_number_rows(q: DataFrame, loc: str = LOC, vendor: str = VENDOR) -> DataFrame:
    return q.where(~F.col(vendor).contains("water")).select(col(loc), col(vendor), "median", "q1", "q3")


def credit_numbers(df: DataFrame, loc: str = LOC) -> DataFrame:
    """Wide: per location, ``<column>_median``, ``_q1``, ``_q3`` of every credit amount."""
    cols = credit_number_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    num = df.select(col(loc), *[safe_number(render_text(col(c), types[c])).alias(c) for c in cols])
    long = long_values(num, [loc], cols, "item", "value")
    return credit_number_rows(exact_quantiles(long, [loc, "item"], "value", count_name=None), cols, loc)


def credit_number_rows(q: DataFrame, cols: list[str], loc: str = LOC) -> DataFrame:
    """Quantiles per location and amount laid out wide."""
    aggs = []
    for c in cols:
        for stat in ("median", "q1", "q3"):
            aggs.append(F.first(F.when(F.col("item") == c, F.col(stat)), ignorenulls=True).alias(f"{c}_{stat}"))
    return q.groupBy(col(loc)).agg(*aggs)


def supply_origin(df: DataFrame) -> F.Column:
    return F.coalesce(col("supplier_district"), col("supplier_country"))


def supply_pairs(df: DataFrame) -> DataFrame:
    """Route shares per (destination, origin) pair; origin = district, else country."""
    pairs = df.select(col("supplier_destination"), supply_origin(df).alias("supplier_origin"),
                      col("supplier_route"))
    pair = F.concat(F.col("supplier_destination"), F.lit("__"), F.col("supplier_origin"))
    counts = answer_counts(pairs.select(pair.alias("pair"), "supplier_route"), ["supplier_route"], "pair")
    shares = shares_from_counts(counts, ["pair"])
    return shares.select("pair", F.concat(F.col("name"), F.lit("__"), F.col("value")).alias("item"), "n", "pc")


def supply_items(df: DataFrame, prefix: str = "supplier_items.") -> DataFrame:
    """Per origin, how many supply records carry each item (non-zero only)."""
    cols = [c for c in df.columns if prefix in c]
    sums = (df.select(supply_origin(df).alias("supplier_origin"), *[col(c) for c in cols])
              .groupBy("supplier_origin").agg(*[F.sum(col(c)).alias(c) for c in cols]))
    long = sums.unpivot(["supplier_origin"], [col(c) for c in cols], "item", "value")
    return (long.where(F.col("value") != 0)
                .select("supplier_origin", F.replace("item", F.lit(prefix), F.lit("")).alias("item"), "value"))
