"""Exact quantiles (linear interpolation, "type 7") without a whole group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer and
merges all of it in one task; one hot group (a location holding a third of the
interviews) would then sit in a single executor. Here the rank search is split
in two equi-keyed passes instead:

1. distinct values with their multiplicity, ``(keys, v) -> c``; duplicates
   collapse map-side and the shuffle spreads one group over many tasks by value;
2. every value falls in a coarse, order-preserving bucket (exponent and the top
   8 mantissa bits, so at most ~2^20 buckets per group); bucket counts and their
   running sum per group give, for each wanted rank, the bucket holding it;
3. only the values of those few buckets (<= 2 x number of probabilities per
   group) are ordered, inside their bucket, to read off the ranked values; a bucket with too
   many distinct values for a task is split by further mantissa bits first, as often as needed;
4. ``lo + (h - floor(h)) * (hi - lo)`` with ``h = (n - 1) p``.

Groups with no value still appear (count 0, quantiles null) when ``grid=True``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sem import col, null_safe_join

DEFAULT_PROBS = (0.25, 0.5, 0.75)
DEFAULT_NAMES = ("q1", "median", "q3")
MANTISSA_BITS = 8
FURTHER_BITS = (20, 32, 44, 50)
_EXP_OFFSET = 1100
NULL_BUCKET = -(1 << 62) - 1


def order_bucket(v: Column, bits: int = MANTISSA_BITS) -> Column:
    """Monotone (non-decreasing) bucket of a double: its exponent and ``bits`` bits of its mantissa.

    ``e = floor(log2|v|)`` may be off by one next to a power of two; the
    bucket formula gives the same result either way there, so order holds.
    """
    a = F.abs(v)
    e = F.floor(F.log2(a))
    m = F.floor((a / F.pow(F.lit(2.0), e) - F.lit(1.0)) * F.lit(float(1 << bits)))
    mag = (e + F.lit(_EXP_OFFSET)).cast("long") * F.lit(1 << bits) + m.cast("long")
    # infinities and NaN (which Spark orders above everything) get sentinel buckets
    top = F.lit(1 << 62)
    return (F.when(F.isnan(v), top + 1).when(v == float("inf"), top).when(v == float("-inf"), -top)
             .when(v > 0, mag).when(v < 0, -mag).when(v.isNotNull(), F.lit(0).cast("long")))


def _holding(buckets: DataFrame, group: list[str]) -> DataFrame:
    """The buckets (_b, _bc values, _m distinct ones) that hold wanted ranks (_w; _from: the rank of
    the group's first value), with the ranks each holds and _lo, the rank of its first value."""
    running = Window.partitionBy(*[col(k) for k in group]).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.col("_from") + F.sum("_bc").over(running)
    placed = buckets.withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col("_bc"))
    held = F.filter("_w", lambda w: (w["r"] >= F.col("_lo")) & (w["r"] < F.col("_hi")))
    return placed.select(*[col(k) for k in group], "_b", "_m", "_lo", held.alias("_w")).where(F.size("_w") > 0)


def _ranked(vals: DataFrame, targets: DataFrame, keys: list[str], task_values: int) -> DataFrame:
    """``keys, p, side, _v``: the values at the wanted ranks.

    A target bucket of up to ``task_values`` distinct values is ordered; a larger one is split by
    further mantissa bits until the buckets that hold ranks are small, or hold next to equal
    values (at the last step four neighbouring doubles at most)."""
    k_cols = [col(k) for k in keys]

    def ordered(values: DataFrame, found: DataFrame) -> DataFrame:
        in_bucket = Window.partitionBy(*k_cols, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (null_safe_join(values, found, keys + ["_b"], "inner")
                .withColumn("_cum", F.sum("_c").over(in_bucket))
                .select(*k_cols, "_v", "_lo", (F.col("_cum") - F.col("_c")).alias("_from"), F.col("_cum").alias("_to"), "_w")
                .select(*k_cols, "_v", F.explode(F.filter(
                    "_w", lambda w: ((w["r"] - F.col("_lo")) >= F.col("_from")) & ((w["r"] - F.col("_lo")) < F.col("_to")))).alias("w"))
                .select(*k_cols, F.col("w.p").alias("p"), F.col("w.side").alias("side"), "_v"))
    out = None
    for bits in (*FURTHER_BITS, None):
        targets = materialize(targets)
        large = targets.where(F.col("_m") > task_values)
        done = bits is None or large.isEmpty()
        part = ordered(vals, (targets if done else targets.where(F.col("_m") <= task_values)).drop("_m"))
        out = part if out is None else out.unionByName(part)
        if done:
            return out
        inside = null_safe_join(vals, large.select(*k_cols, "_b", F.col("_lo").alias("_from"), "_w"), keys + ["_b"], "inner")
        # buckets of one width are told apart by their own numbers: those of the step before are not needed
        fine = materialize(inside.withColumn("_up", F.col("_b")).withColumn("_b", order_bucket(F.col("_v"), bits)))
        counted = fine.groupBy(*keys, "_up", "_b", "_from", "_w").agg(F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_m"))
        targets = _holding(counted, keys + ["_up"]).drop("_up")
        vals = fine.select(*k_cols, "_v", "_c", "_b")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float] = DEFAULT_PROBS,
                    names: Sequence[str] = DEFAULT_NAMES,
                    count_name: str | None = "nv", grid: bool = True, task_values: int = 500_000,
                    weight: str | None = None) -> DataFrame:
    """Per group of ``keys``: non-null count and exact quantiles of ``value``.

    Null keys form a group of their own. Returns ``keys + [count_name] + names``. No task
    orders more than ``task_values`` distinct values of a group. ``weight``: column with the
    number of times that a row counts (default: once).
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    if len(names) != len(probs):
        raise ValueError("one name per probability")
    k_cols = [col(k) for k in keys]

    # 1. distinct values and multiplicities; nulls are a bucket of their own, which
    # holds no rank but keeps its group
    times = F.lit(1) if weight is None else col(weight)
    vals = materialize(df.select(*k_cols, col(value).cast("double").alias("_v"), times.cast("long").alias("_c"))
                       .groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
                       .withColumn("_b", F.coalesce(order_bucket(F.col("_v")), F.lit(NULL_BUCKET))))

    # 2. buckets: counts, running sum, and the wanted ranks each one holds
    n_of = F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(F.lit(0)))
    bk = materialize(vals.groupBy(*keys, "_b").agg(n_of.alias("_bc"), F.count(F.lit(1)).alias("_m")))
    # group sizes from the (small) bucket table
    sizes = bk.groupBy(*keys).agg(F.sum("_bc").cast("long").alias("_n"))
    wanted = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        r0 = F.floor(h).cast("long")
        r1 = F.least(r0 + 1, F.col("_n") - 1)
        wanted.append(F.struct(F.lit(i).alias("p"), F.lit(0).alias("side"), r0.alias("r")))
        wanted.append(F.struct(F.lit(i).alias("p"), F.lit(1).alias("side"), r1.alias("r")))
    by_group = Window.partitionBy(*k_cols)
    first = bk.withColumn("_n", F.sum("_bc").over(by_group)).withColumn("_w", F.array(*wanted)).withColumn("_from", F.lit(0).cast("long"))
    picked = _ranked(vals, _holding(first, keys), keys, task_values)

    # 4. interpolate and lay the probabilities out as columns
    aggs = []
    for i in range(len(probs)):
        aggs.append(F.max(F.when((F.col("p") == i) & (F.col("side") == 0), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when((F.col("p") == i) & (F.col("side") == 1), F.col("_v"))).alias(f"_hi{i}"))
    ranked = picked.groupBy(*keys).agg(*aggs)
    base = sizes if grid else sizes.where(F.col("_n") > 0)
    out = null_safe_join(base, ranked, keys, "left")
    cols = [col(k) for k in keys]
    if count_name:
        cols.append(F.col("_n").alias(count_name))
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("_n") - 1) * F.lit(p)
        frac = h - F.floor(h)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        # a whole rank returns the ranked value itself (no 0 * inf)
        cols.append(F.when(F.col("_n") > 0, F.when(frac == 0, lo).otherwise(lo + frac * (hi - lo))).alias(name))
    return out.select(*cols)
