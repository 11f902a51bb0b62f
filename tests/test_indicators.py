"""Analysis operators on hand-made tables with hand-worked results."""

import pytest
from pyspark.sql import functions as F

from souk.functions import quantiles
from souk.functions.quantiles import exact_quantiles
from souk.functions.sem import render_text
from souk.functions import names as N
from souk.operators import indicators as I
from souk.operators import reshape
from souk.operators import rollup as R


def test_quartiles_type7(spark):
    df = spark.createDataFrame([("L", v) for v in (1.0, 2.0, 3.0, 10.0, None)], "loc string, v double")
    r = exact_quantiles(df, ["loc"], "v").collect()[0]
    assert (r["nv"], r["q1"], r["median"], r["q3"]) == (4, 1.75, 2.5, 4.75)


def test_all_null_group_kept(spark):
    df = spark.createDataFrame([("L", None), ("L", None)], "loc string, v double")
    r = exact_quantiles(df, ["loc"], "v").collect()[0]
    assert r["nv"] == 0 and r["median"] is None and r["q1"] is None


def test_exact_quantiles_match_percentile_on_many_groups(spark):
    rows = [(f"g{i % 7}", float((i * 7919) % 101) / (1 + i % 3)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q1"], r["median"], r["q3"]) for r in exact_quantiles(df, ["g"], "v").collect()}
    ref = {r["g"]: tuple(r["p"]) for r in
           df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("p")).collect()}
    for g in ref:
        assert got[g] == pytest.approx(ref[g], abs=1e-12)


def test_quantiles_with_infinities_and_nan(spark):
    vals = [1.0, float("inf"), float("-inf"), 3.0, float("nan"), 2.0, 1e308, -5e-324]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    got = exact_quantiles(df, ["g"], "v", probs=(0.0, 0.25, 0.5, 0.75, 1.0),
                          names=("p0", "p25", "p50", "p75", "p100")).collect()[0]
    ref = df.groupBy("g").agg(F.percentile("v", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("p")).collect()[0]["p"]
    for name, want in zip(("p0", "p25", "p50", "p75", "p100"), ref):
        g = got[name]
        assert (g != g and want != want) or g == want


def _survey(spark, rows, extra_schema=""):
    schema = "call_location string, vendor_type string, price_usd_rice_1kg double, price_usd_water_truck_20l double"
    return spark.createDataFrame(rows, schema + extra_schema)


def test_check_flag_water_needs_two(spark):
    rows = []
    for loc, n in (("A", 1), ("B", 2), ("C", 3)):
        rows += [(loc, "shop", 1.0, 5.0)] * n
    out = {(r["call_location"], r["item"]): r["check"] for r in I.price_table(_survey(spark, rows)).collect()}
    assert [out[(x, "Rice 1kg")] for x in "ABC"] == [False, False, True]
    assert [out[(x, "Water Truck 20l")] for x in "ABC"] == [False, True, True]


def test_vendor_fan_out_and_global_nv(spark):
    rows = []
    for loc in ("A", "B"):
        rows += [(loc, "shop", 1.0, None)] * 3 + [(loc, "kiosk", 2.0, None)] * 3
    prices = I.price_table(_survey(spark, rows))
    rice = prices.where(F.col("item") == "Rice 1kg").collect()
    assert len(rice) == 4  # 2 locations x 2 vendor types
    assert all(r["nv"] == 6 for r in rice)
    glob = R.global_prices(prices).where(F.col("item") == "Rice 1kg").collect()
    assert sorted(r["vendor_type"] for r in glob) == ["kiosk", "shop"]
    assert all(r["nv"] == 24 for r in glob)  # sum over the fanned-out rows, as the sheets do


def test_null_location_is_one_group(spark):
    rows = [(None, "shop", 1.0, None), (None, "shop", 3.0, None), ("A", "shop", 2.0, None)]
    out = I.price_table(_survey(spark, rows)).where(F.col("item") == "Rice 1kg").collect()
    by_loc = {r["call_location"]: (r["nv"], r["median"]) for r in out}
    assert by_loc == {None: (2, 2.0), "A": (1, 2.0)}


def test_shares_of_non_missing_answers(spark):
    df = spark.createDataFrame([("L", v) for v in ("yes", "yes", "no", None)], "call_location string, q string")
    got = {r["item"]: (r["n"], r["pc"]) for r in reshape.answer_shares(df, ["q"]).collect()}
    assert got == {"q__yes": (2, pytest.approx(2 / 3)), "q__no": (1, pytest.approx(1 / 3))}


def test_option_names_drop_zero_and_rename(spark):
    df = spark.createDataFrame([("L", 1), ("L", 0)], "call_location string, `barrier_t.road` int")
    got = {r["item"]: r["pc"] for r in reshape.answer_shares(df, ["barrier_t.road"]).collect()}
    assert got == {"barrier_t__road": 0.5}


def test_text_rendering_of_whole_doubles(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (2.5,), (None,)], "x double")
    got = [r[0] for r in df.select(render_text(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == ["1", "0", "2.5", None]


def test_difficulty_all_no_gives_yes_zero(spark):
    df = spark.createDataFrame([("L", "dk"), ("L", "pnta"), ("L", "no"), ("M", "yes"), ("M", "no")],
                               "call_location string, stock_dif_rice string")
    got = {(r["call_location"], r["item"]): (r["dif"], r["dif_pc"]) for r in I.stock_difficulty(df).collect()}
    assert got == {("L", "rice"): (0, 0.0), ("M", "rice"): (1, 0.5)}


def test_zero_filled_global_median(spark):
    shares = spark.createDataFrame([("A", "q__x", 3, 0.6), ("B", "q__y", 1, 1.0), ("C", "q__y", 1, 1.0)],
                                   "call_location string, item string, n long, pc double")
    wide = {r["call_location"]: r.asDict() for r in R.global_shares_wide(shares).collect()}
    assert wide["_global"]["q__x"] == 0.0  # median of 0.6, 0, 0
    assert wide["B"]["q__x"] == 0.0
    assert list(R.global_shares_wide(shares).columns) == ["call_location", "q__x", "q__y"]


def test_v6_global_shares(spark):
    shares = spark.createDataFrame([("A", "q__x", 3, 0.6), ("B", "q__x", 5, 0.5), ("A", "q__y", 2, 0.4)],
                                   "call_location string, item string, n long, pc double")
    got = {r["item"]: (r["n"], r["pc"]) for r in R.global_shares_v6(shares).collect()}
    assert got == {"q__x": (4.0, pytest.approx(4 / 6)), "q__y": (2.0, pytest.approx(2 / 6))}


def test_select_multiple_parents():
    cols = ["a", "barrier_t", "barrier_t.road", "barrier_t.cost", "x.y"]
    assert N.select_multiple_parents(cols) == ["barrier_t"]


def test_question_columns_rules(spark):
    df = spark.createDataFrame([], "call_location string, supplier_a string, supplier_number int, "
                                   "supplier_a_other string, Supplier_b string")
    assert N.question_columns(df, ("supplier_",), exclude_contains=("supplier_number",)) == \
        ["supplier_a", "Supplier_b"]


def test_supplier_numbers_drop_water_and_null(spark):
    df = spark.createDataFrame([("A", "shop", 1), ("A", "shop", 3), ("A", "water_truck", 2), ("A", None, 4)],
                               "call_location string, vendor_type string, supplier_number int")
    got = [(r["vendor_type"], r["median"]) for r in I.supplier_numbers(df).collect()]
    assert got == [("shop", 2.0)]


@pytest.mark.parametrize("task_values", [500_000, 50, 1])
def test_quantiles_of_many_values_in_one_bucket(spark, task_values):
    import numpy as np

    rnd = np.random.default_rng(1)
    # group a: all within 1/256 of a binade; b: neighbouring doubles; c: signs, zero, infinities, ties
    groups = {"a": 1 + rnd.random(3000) / 300, "b": -(5 + np.arange(700) * np.spacing(5.0)), "d": np.full(40, 2.5),
              "c": np.concatenate([rnd.normal(size=500), [0.0, np.inf, -np.inf, 1e-310, -1e300], np.repeat(0.125, 60), 2.0 ** np.arange(-40, 40)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", task_values=task_values).collect()}
    for g, vs in groups.items():
        assert got[g]["nv"] == len(vs)
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-15)
    assert got["e"]["nv"] == 0 and got["e"]["median"] is None


def test_no_task_orders_a_large_bucket(spark, monkeypatch):
    ordered = []
    held = quantiles._holding

    def seen(buckets, group):
        out = held(buckets, group)
        ordered.append(out.agg(F.max("_m")).first()[0])
        return out
    monkeypatch.setattr(quantiles, "_holding", seen)
    df = spark.range(200_000).select((F.lit(1.0) + F.col("id") / 1e8).alias("v"))
    got = quantiles.exact_quantiles(df.withColumn("g", F.lit(1)), ["g"], "v", task_values=1000).first()
    assert ordered[0] > 100_000 and ordered[-1] <= 1000
    assert got["median"] == pytest.approx(1 + 99_999.5 / 1e8, rel=1e-15)
