"""Survey-shaped views derived from the driver's TPC-H-like tables.

The engine works on wide market-survey tables (one row per vendor interview).
The test data holds orders, lines, parts and customers instead, so each view
below is one SQL statement that turns them into survey form: one interview per
order, its location the customer's nation, its prices and stock the order's
lines by part type, and its categorical answers integer rules on the keys.

The text is kept to a dialect both Spark SQL and DuckDB run, so the DuckDB
oracle reads exactly the same view; only identifier quoting differs
(``dialect='spark'`` uses back-ticks, ``'duckdb'`` double quotes). Column names
with a dot are select-multiple options (``barrier_transport.road``).

Everything scales with the inputs: lines are joined to parts and aggregated per
order (one shuffle on the order key), then joined to orders, which the
aggregate already partitions by that key; customers join on their key and the
25-row nation table is broadcast by Spark's size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Fixed values of the derived survey (part types become price / stock items).
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
VENDOR_TYPES = ("shop", "wholesaler", "water_truck", "kiosk")
DIFFICULTY_ANSWERS = ("yes", "no", "no", "dk", "pnta")


def quoter(dialect: str):
    if dialect == "spark":
        return lambda name: f"`{name}`"
    if dialect == "duckdb":
        return lambda name: f'"{name}"'
    raise ValueError(f"unknown dialect {dialect!r}")


def _clock(sec: str) -> str:
    """hh:mm:ss text of an integer second-of-day expression."""
    def two(expr: str) -> str:
        return f"lpad(CAST(CAST(floor({expr}) AS BIGINT) AS STRING), 2, '0')"
    return (f"{two(f'({sec}) / 3600')} || ':' || {two(f'(({sec}) % 3600) / 60')}"
            f" || ':' || {two(f'({sec}) % 60')}")


SUPPLIER_SOURCES = {"A": "local", "N": "regional", "R": "import"}


def _least_flag(dialect: str) -> str:
    """The least return flag of an order. Spark aggregates the least of a text by sorting all lines;
    the flag's place among those that are told apart is a number, which it aggregates by hashing."""
    if dialect != "spark":
        return "min(l.l_returnflag)"
    places = " ".join(f"WHEN l.l_returnflag < '{f}' THEN {2 * i} WHEN l.l_returnflag = '{f}' THEN {2 * i + 1}" for i, f in enumerate(sorted(SUPPLIER_SOURCES)))
    return f"min(CASE {places} WHEN l.l_returnflag IS NOT NULL THEN {2 * len(SUPPLIER_SOURCES)} END)"


def _flag_value(flag: str, dialect: str) -> str:
    return f"'{flag}'" if dialect != "spark" else str(2 * sorted(SUPPLIER_SOURCES).index(flag) + 1)


def survey_sql(dialect: str = "spark") -> str:
    """The ``survey`` view: one interview per order (deleted interviews removed)."""
    q = quoter(dialect)
    t = [p.lower() for p in PART_TYPES]
    line_aggs = []
    for p, low in zip(PART_TYPES, t):
        line_aggs.append(f"max(CASE WHEN p.p_type = '{p}' THEN l.l_extendedprice END) AS pr_{low}")
        line_aggs.append(f"sum(CASE WHEN p.p_type = '{p}' THEN l.l_quantity END) AS qt_{low}")
        line_aggs.append(f"avg(CASE WHEN p.p_type = '{p}' THEN l.l_linenumber END) AS ln_{low}")
    line_aggs += [
        "sum(l.l_quantity) AS qty_all",
        f"{_least_flag(dialect)} AS flag",
    ]
    # distinct suppliers per order: its own two-step aggregate (order, supplier)
    # -> order, so the conditional sums above need no distinct expansion
    supp = ("SELECT okey, count(*) AS n_supp FROM (SELECT DISTINCT l_orderkey AS okey, l_suppkey "
            "FROM lineitem) ds GROUP BY okey")
    lines = ("SELECT a.*, s.n_supp FROM (SELECT l.l_orderkey AS okey, " + ", ".join(line_aggs)
             + " FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey) a "
             f"LEFT JOIN ({supp}) s ON s.okey = a.okey")

    day = "CAST(CAST(b.o_orderdate AS DATE) AS STRING)"
    next_day = "CAST(CAST(CAST(b.o_orderdate AS DATE) + INTERVAL '1' DAY AS DATE) AS STRING)"
    start_sec = "(21600 + (b.k * 37) % 36000)"
    end_sec = f"({start_sec} + ((b.k * 7) % 120 + 1) * 60 + b.k % 50 - 25)"

    cols = [
        f"'S' || CAST(b.k AS STRING) AS {q('uuid')}",
        f"b.k + 1 AS {q('index')}",
        f"substr({day}, 3, 2) || substr({day}, 6, 2) AS {q('jmmi_date')}",
        f"CASE WHEN b.k % 499 = 0 THEN NULL ELSE concat(b.n_name, '') END AS {q('call_location')}",
        "CASE WHEN b.c % 40 = 0 THEN NULL " + " ".join(
            f"WHEN b.c % 4 = {i} THEN '{v}'" for i, v in enumerate(VENDOR_TYPES))
        + f" END AS {q('vendor_type')}",
        f"'E' || CAST(b.c % 6 AS STRING) AS {q('enumerator')}",
        f"'ORG' || CAST(b.c % 3 AS STRING) AS {q('enumerator_org')}",
        f"{day} || 'T' || {_clock(start_sec)} || '.000+03:00' AS {q('start')}",
        f"CASE WHEN b.k % 97 = 0 THEN {next_day} ELSE {day} END || 'T' || {_clock(end_sec)}"
        f" || '.000+03:00' AS {q('end')}",
    ]
    for low in t:
        cols.append(f"b.pr_{low} AS {q(f'price_usd_{low}_1kg')}")
    cols += [
        f"CASE WHEN b.k % 200 = 0 THEN b.o_totalprice END AS {q('price_usd_rare_1kg')}",
        f"CASE WHEN b.k % 250 = 0 THEN b.o_totalprice / 100 END AS {q('price_usd_water_truck_20l')}",
        f"CAST(1 AS DOUBLE) AS {q('price_usd_rice_other')}",
        f"CASE WHEN b.k % 3 = 0 THEN 'no' ELSE 'yes' END AS {q('avail_shop_rice')}",
    ]
    for low in t:
        cols.append(f"b.qt_{low} AS {q(f'stock_len_{low}')}")
    for low in t:
        cols.append(f"b.ln_{low} AS {q(f'stock_time_{low}')}")
    for i, low in enumerate(t):
        regular = ("CASE (b.k + %d) %% 6 " % i + " ".join(
            f"WHEN {j} THEN '{a}'" for j, a in enumerate(DIFFICULTY_ANSWERS)) + " ELSE NULL END")
        if i == 1:
            # one location answers only no / dk for this item: share of yes is 0
            expr = (f"CASE WHEN b.c_nationkey = 7 THEN (CASE b.k % 3 WHEN 0 THEN 'no' "
                    f"WHEN 1 THEN 'dk' ELSE NULL END) ELSE {regular} END")
        else:
            expr = regular
        cols.append(f"{expr} AS {q(f'stock_dif_{low}')}")
    cols += [
        "CASE WHEN b.k % 7 = 0 THEN NULL WHEN b.k % 2 = 1 AND b.k % 3 = 0 THEN 'road cost' "
        "WHEN b.k % 2 = 1 THEN 'road' WHEN b.k % 3 = 0 THEN 'cost' ELSE 'none' END"
        f" AS {q('barrier_transport')}",
        f"CASE WHEN b.k % 7 = 0 THEN NULL ELSE CAST(b.k % 2 AS INT) END AS {q('barrier_transport.road')}",
        f"CASE WHEN b.k % 7 = 0 THEN NULL WHEN b.k % 3 = 0 THEN 1 ELSE 0 END AS {q('barrier_transport.cost')}",
        "CASE WHEN b.k % 11 = 0 THEN NULL WHEN b.c % 2 = 0 THEN 'yes' ELSE 'no' END"
        f" AS {q('barrier_finance')}",
        f"CASE WHEN b.k % 11 = 0 THEN 'bank closed' END AS {q('barrier_finance_other')}",
        "CASE b.o_orderstatus WHEN 'F' THEN 'usd' WHEN 'O' THEN 'sos' ELSE 'usd_sos' END"
        f" AS {q('currency_used')}",
        "CASE WHEN b.k % 13 = 0 THEN NULL WHEN b.k % 5 < 2 THEN 'cash mobile' ELSE 'cash' END"
        f" AS {q('payment_mode')}",
        "CASE WHEN b.k % 13 = 0 THEN NULL WHEN b.o_orderpriority IN ('1-URGENT', '2-HIGH') "
        f"THEN 1 ELSE 0 END AS {q('payment_mode.cash')}",
        f"CASE WHEN b.k % 13 = 0 THEN NULL WHEN b.k % 5 < 2 THEN 1 ELSE 0 END AS {q('payment_mode.mobile')}",
        f"CASE WHEN b.k % 5 = 0 THEN 'yes' ELSE 'no' END AS {q('barter_accept')}",
        "CASE b.flag " + " ".join(f"WHEN {_flag_value(f, dialect)} THEN '{v}'" for f, v in SUPPLIER_SOURCES.items()) + " END"
        f" AS {q('supplier_source')}",
        f"CASE WHEN b.k % 150 = 0 THEN 'cousin' END AS {q('supplier_source_other')}",
        "CASE substr(b.o_orderpriority, 1, 1) WHEN '1' THEN 'truck' WHEN '2' THEN 'truck' "
        f"WHEN '3' THEN 'boat' WHEN '4' THEN 'donkey' END AS {q('transportation_mode')}",
        f"coalesce(b.n_supp, 0) AS {q('supplier_number')}",
        f"CASE b.k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'dk' END AS {q('credit_offer')}",
        "CASE WHEN b.k % 4 = 0 AND b.k % 6 = 0 THEN 'prices stock' WHEN b.k % 4 = 0 THEN 'prices' "
        f"WHEN b.k % 6 = 0 THEN 'stock' ELSE 'none' END AS {q('cva_effect')}",
        f"CAST(CASE WHEN b.k % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS {q('cva_effect.prices')}",
        f"CASE WHEN b.k % 6 = 0 THEN 1 ELSE 0 END AS {q('cva_effect.stock')}",
        "CASE WHEN b.k % 50 = 0 THEN (CASE b.k % 3 WHEN 0 THEN 'fewer customers' "
        f"WHEN 1 THEN 'more credit' ELSE 'none' END) END AS {q('cva_effect_other')}",
        "CASE b.c % 3 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' ELSE 'same' END"
        f" AS {q('customer_change')}",
        f"CASE WHEN b.c % 2 = 0 THEN 'male' ELSE 'female' END AS {q('gender_vendor')}",
        f"CASE WHEN b.k % 3 = 0 THEN NULL ELSE b.o_totalprice / 1000 END AS {q('credit_max_usd')}",
        f"b.qty_all * CAST(2.5 AS DOUBLE) AS {q('credit_total_usd')}",
    ]
    base = ("SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderstatus, o.o_orderpriority, "
            "o.o_totalprice, o.o_orderdate, cu.c_nationkey, n.n_name, li.* "
            "FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey "
            "JOIN nation n ON cu.c_nationkey = n.n_nationkey "
            f"LEFT JOIN ({lines}) li ON li.okey = o.o_orderkey "
            # interviews listed for deletion are gone, except k % 1000 = 1 (still there)
            "WHERE NOT (o.o_orderkey % 250 = 1 AND o.o_orderkey % 1000 <> 1)")
    return f"SELECT {', '.join(cols)} FROM ({base}) b"


def survey_columns() -> list[str]:
    """Column names of the survey view, in order."""
    import re
    sel = survey_sql("spark")
    outer = sel[: sel.rindex(" FROM (SELECT o.o_orderkey")]
    return re.findall(r" AS `([^`]+)`(?=, |$)", outer)


# Form definition of the survey (fixed values): question name -> type.
TOOL_TYPES = {
    "uuid": "calculate", "index": "calculate", "jmmi_date": "calculate", "start": "start", "end": "end",
    "call_location": "select_one", "vendor_type": "select_one", "enumerator": "text",
    "enumerator_org": "text", "avail_shop_rice": "select_one", "barrier_transport": "select_multiple",
    "barrier_finance": "select_one", "barrier_finance_other": "text", "currency_used": "select_one",
    "payment_mode": "select_multiple", "barter_accept": "select_one", "supplier_source": "select_one",
    "supplier_source_other": "text", "transportation_mode": "select_one", "supplier_number": "integer",
    "credit_offer": "select_one", "cva_effect": "select_multiple", "cva_effect_other": "text",
    "customer_change": "select_one", "gender_vendor": "select_one", "credit_max_usd": "decimal",
    "credit_total_usd": "decimal", "note_intro": "note", "today": "today", "deviceid": "deviceid",
}


def tool_rows() -> list[tuple[str, str]]:
    rows = []
    for t in PART_TYPES:
        low = t.lower()
        rows += [(f"price_usd_{low}_1kg", "decimal"), (f"stock_len_{low}", "integer"),
                 (f"stock_time_{low}", "decimal"), (f"stock_dif_{low}", "select_one")]
    rows += [("price_usd_rare_1kg", "decimal"), ("price_usd_water_truck_20l", "decimal"),
             ("price_usd_rice_other", "decimal")]
    rows += list(TOOL_TYPES.items())
    return rows


def tool_sql(dialect: str = "spark") -> str:
    """The ``tool`` view: one row per question of the form (name, type)."""
    q = quoter(dialect)
    vals = ", ".join(f"('{n}', '{t}')" for n, t in tool_rows())
    return f"SELECT * FROM (VALUES {vals}) AS tool({q('name')}, {q('type')})"


def survey_copies_sql(dialect: str = "spark", source: str | None = None) -> str:
    """The ``survey_copies`` view: every interview plus copies of some of them.

    k % 70 = 0: a near copy (new uuid) with 1-3 answers changed;
    k % 210 = 0: an exact second submission (same uuid, new index).
    """
    q = quoter(dialect)
    names = survey_columns()
    k = f"({q('index')} - 1)"
    changed = {
        "uuid": f"{q('uuid')} || 'c'",
        "index": f"{q('index')} + 1000000000",
        "price_usd_economy_1kg": f"CASE WHEN {k} % 140 = 0 THEN {q('price_usd_economy_1kg')} + 1 "
                                 f"ELSE {q('price_usd_economy_1kg')} END",
        "barrier_finance": f"CASE WHEN {q('barrier_finance')} = 'yes' THEN 'no' ELSE 'yes' END",
        "credit_offer": f"CASE WHEN {k} % 280 = 0 THEN 'dk' ELSE {q('credit_offer')} END",
    }
    near = ", ".join(f"{changed.get(n, q(n))} AS {q(n)}" for n in names)
    exact = ", ".join((f"{q('index')} + 2000000000" if n == "index" else q(n)) + f" AS {q(n)}" for n in names)
    s = source or f"({survey_sql(dialect)})"
    return (f"SELECT * FROM {s} s "
            f"UNION ALL SELECT {near} FROM {s} s WHERE {k} % 70 = 0 "
            f"UNION ALL SELECT {exact} FROM {s} s WHERE {k} % 210 = 0")


def survey_edited_sql(dialect: str = "spark", source: str | None = None) -> str:
    """The ``survey_edited`` view: a second team's copy of the survey.

    price_usd_economy_1kg + 1 where k % 333 = 0 and null where k % 444 = 0;
    avail_shop_rice dropped, extra_note added, supplier_number stored as text,
    interviews with k % 997 = 5 missing.
    """
    q = quoter(dialect)
    k = f"({q('index')} - 1)"
    out = []
    for n in survey_columns():
        if n == "avail_shop_rice":
            continue
        if n == "price_usd_economy_1kg":
            out.append(f"CASE WHEN {k} % 444 = 0 THEN NULL WHEN {k} % 333 = 0 THEN {q(n)} + 1 "
                       f"ELSE {q(n)} END AS {q(n)}")
        elif n == "supplier_number":
            out.append(f"CAST({q(n)} AS STRING) AS {q(n)}")
        else:
            out.append(f"{q(n)} AS {q(n)}")
    out.append(f"'checked' AS {q('extra_note')}")
    src = source or f"({survey_sql(dialect)})"
    return f"SELECT {', '.join(out)} FROM {src} s WHERE {k} % 997 <> 5"


def supply_sql(dialect: str = "spark") -> str:
    """The ``supply`` view: one supply record per order line.

    destination = customer nation; district = supplier nation (null where
    s_suppkey % 5 = 0); country = supplier region; route = return flag; item
    flags from the quantity.
    """
    q = quoter(dialect)
    return (f"SELECT cn.n_name AS {q('supplier_destination')}, "
            f"CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE sn.n_name END AS {q('supplier_district')}, "
            f"r.r_name AS {q('supplier_country')}, l.l_returnflag AS {q('supplier_route')}, "
            f"CASE WHEN l.l_quantity > 25 THEN 1 ELSE 0 END AS {q('supplier_items.rice')}, "
            f"CASE WHEN l.l_quantity % 3 = 0 THEN 1 ELSE 0 END AS {q('supplier_items.oil')}, "
            f"CASE WHEN l.l_linenumber = 1 THEN 1 ELSE 0 END AS {q('supplier_items.soap')} "
            "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
            "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey "
            "JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey "
            "JOIN region r ON sn.n_regionkey = r.r_regionkey")


def deletions_sql(dialect: str = "spark") -> str:
    """The ``deletions`` view: interviews marked for removal (uuid)."""
    q = quoter(dialect)
    return (f"SELECT 'S' || CAST(o_orderkey AS STRING) AS {q('uuid')} FROM orders "
            "WHERE o_orderkey % 250 = 1")


# Questions the cleaning log edits, in turn (fixed values of the derived log).
LOG_QUESTIONS = ("vendor_type", "barrier_finance", "price_usd_economy_1kg", "credit_max_usd",
                 "barrier_transport.road")


def log_sql(dialect: str = "spark", source: str | None = None) -> str:
    """The ``log`` view: one cleaning-log edit per 20th interview, plus stray rows.

    The new value equals the cell (applied), is the cell padded with blanks
    (applied), differs (k % 60 = 0, not applied), or is null for a null cell.
    Extra rows point at deleted interviews and at an unknown question.
    """
    q = quoter(dialect)
    s = source or f"({survey_sql(dialect)})"
    kk = f"(s.{q('index')} - 1)"
    turn = f"CAST(floor({kk} / 20) AS BIGINT) % 5"
    cell = (f"CASE {turn} " + " ".join(
        f"WHEN {j} THEN {render_sql('s.' + q(c), _LOG_TYPES[c])}"
        for j, c in enumerate(LOG_QUESTIONS)) + " END")
    question = (f"CASE {turn} " + " ".join(
        f"WHEN {j} THEN '{c}'" for j, c in enumerate(LOG_QUESTIONS)) + " END")
    edited = (f"SELECT s.{q('uuid')} AS {q('uuid')}, {question} AS {q('question')}, "
              f"'old' AS {q('old_value')}, "
              f"CASE WHEN {kk} % 60 = 0 THEN 'changed' WHEN {kk} % 40 = 0 THEN '  ' || {cell} || ' ' "
              f"ELSE {cell} END AS {q('new_value')} "
              f"FROM {s} s WHERE {kk} % 20 = 0")
    deleted = (f"SELECT 'S' || CAST(o_orderkey AS STRING) AS {q('uuid')}, 'vendor_type' AS {q('question')}, "
               f"'old' AS {q('old_value')}, 'shop' AS {q('new_value')} FROM orders "
               "WHERE o_orderkey % 500 = 1")
    unknown = (f"SELECT 'S' || CAST(o_orderkey AS STRING) AS {q('uuid')}, 'no_such_question' AS {q('question')}, "
               f"'a' AS {q('old_value')}, 'b' AS {q('new_value')} FROM orders "
               "WHERE o_orderkey % 700 = 3")
    return f"{edited} UNION ALL {deleted} UNION ALL {unknown}"


_LOG_TYPES = {"vendor_type": "string", "barrier_finance": "string",
              "price_usd_economy_1kg": "double", "credit_max_usd": "double",
              "barrier_transport.road": "int"}


def render_sql(expr: str, dtype: str) -> str:
    """SQL text rendering of a cell, as the engine's ``render_text`` does it."""
    if dtype == "double":
        return (f"CASE WHEN {expr} = floor({expr}) AND abs({expr}) < 1e15 "
                f"THEN CAST(CAST({expr} AS BIGINT) AS STRING) ELSE CAST({expr} AS STRING) END")
    return f"CAST({expr} AS STRING)"


def register_base_tables(spark: SparkSession, sf_dir: str) -> None:
    for name in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


_MATERIALIZED: dict[tuple[str, str, str], str] = {}


def _view(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived view, written once per application as Parquet and read back.

    The views stand in for the survey tables a user would load from storage;
    writing them once (under the session's checkpoint folder, shared on a
    cluster) keeps every query from re-deriving them from the raw tables.
    """
    from ..session import ensure_checkpoint_dir

    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _MATERIALIZED.get(key)
    if path is None:
        register_base_tables(spark, sf_dir)
        base = ensure_checkpoint_dir(spark).rstrip("/")
        tag = abs(hash(sf_dir)) % 10**8
        path = f"{base}/views/{spark.sparkContext.applicationId}/{name}-{tag}"
        build().write.mode("overwrite").parquet(path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "survey", lambda: spark.sql(survey_sql("spark")))


def _survey_source(spark: SparkSession, sf_dir: str) -> str:
    survey(spark, sf_dir).createOrReplaceTempView("souk_survey")
    return "souk_survey"


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "deletions", lambda: spark.sql(deletions_sql("spark")))


def cleaning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "log", lambda: spark.sql(log_sql("spark", _survey_source(spark, sf_dir))))


def tool(spark: SparkSession) -> DataFrame:
    return spark.sql(tool_sql("spark"))


def survey_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # formed row by row from the stored survey: reading that again costs less than storing the rows once more
    return spark.sql(survey_copies_sql("spark", _survey_source(spark, sf_dir)))


def survey_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(survey(spark, sf_dir))


def edited(df: DataFrame) -> DataFrame:
    """The second team's copy of a survey, formed row by row: rows stay in their order."""
    df.createOrReplaceTempView("souk_survey_to_edit")
    return df.sparkSession.sql(survey_edited_sql("spark", "souk_survey_to_edit"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supply", lambda: spark.sql(supply_sql("spark")))
