"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code, as plain SQL over the same
survey-shaped views (``souk.sources.demo`` in the DuckDB dialect) on the
driver's tables. Column names and types are aligned with the Spark results;
doubles are rounded to 6 decimals in the final SELECT only.
"""

from __future__ import annotations

import re

from ..sources import demo

q = demo.quoter("duckdb")
TYPES = [t.lower() for t in demo.PART_TYPES]

PRICE_COLS = [f"price_usd_{t}_1kg" for t in TYPES] + ["price_usd_rare_1kg", "price_usd_water_truck_20l"]
STOCK_COLS = [f"stock_len_{t}" for t in TYPES] + [f"stock_time_{t}" for t in TYPES]
DIF_COLS = [f"stock_dif_{t}" for t in TYPES]
# question columns per sheet, with their storage type
BARRIER_COLS = {"barrier_transport.road": "int", "barrier_transport.cost": "int", "barrier_finance": "string"}
PAYMENT_COLS = {"currency_used": "string", "payment_mode.cash": "int", "payment_mode.mobile": "int",
                "barter_accept": "string"}
SUPPLIER_COLS = {"supplier_source": "string", "transportation_mode": "string"}
CREDIT_COLS = {"credit_offer": "string", "cva_effect.prices": "double", "cva_effect.stock": "int",
               "customer_change": "string", "gender_vendor": "string", "cva_effect_others": "string"}
CREDIT_NUM_COLS = ["credit_max_usd", "credit_total_usd"]
# expected answer items of the wide sheets (what the survey view can produce)
BARRIER_ITEMS = ["barrier_finance__no", "barrier_finance__yes", "barrier_transport__cost", "barrier_transport__road"]
PAYMENT_ITEMS = ["barter_accept__no", "barter_accept__yes", "currency_used__sos", "currency_used__usd",
                 "currency_used__usd_sos", "payment_mode__cash", "payment_mode__mobile"]
CREDIT_ITEMS = ["credit_offer__dk", "credit_offer__no", "credit_offer__yes", "customer_change__decrease",
                "customer_change__increase", "customer_change__same", "cva_effect__prices", "cva_effect__stock",
                "cva_effect_others__fewer customers", "cva_effect_others__more credit", "cva_effect_others__none",
                "gender_vendor__female", "gender_vendor__male"]

LOC = q("call_location")


def with_survey(body: str, extra: str = "", materialized: tuple[str, ...] = ()) -> str:
    src = (f"survey0 AS ({demo.survey_sql('duckdb')}), "
           f"survey AS (SELECT *, {q('cva_effect_other')} AS {q('cva_effect_others')} FROM survey0)")
    sql = f"WITH {src}{', ' + extra if extra else ''} {body}"
    # CTEs are inlined except the ones read many times (DuckDB 2.0 failed on
    # some self-joined materialised CTEs over dictionary-encoded text)
    sql = re.sub(r"(\b[a-z0-9_]+) AS \((SELECT|WITH)", r"\1 AS NOT MATERIALIZED (\2", sql)
    for name in ("survey0", "stock", "sq", "olong", "prices", "s_sh") + tuple(materialized):
        # read many times: computed once
        sql = sql.replace(f"{name} AS NOT MATERIALIZED (", f"{name} AS MATERIALIZED (", 1)
    return sql


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) AS {q(name)}" if name else f"round({expr}, 6)"


def title(expr: str) -> str:
    return ("array_to_string(list_transform(string_split(" + expr + ", ' '), "
            "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


def unpivot(cols, keys=(LOC,), text=False, types=None, value_expr=None, src="survey") -> str:
    parts = []
    for c in cols:
        if value_expr:
            v = value_expr(q(c))
        elif text:
            v = demo.render_sql(q(c), (types or {}).get(c, "string"))
        else:
            v = f"CAST({q(c)} AS DOUBLE)"
        parts.append(f"SELECT {', '.join(keys)}, '{c}' AS name, {v} AS value FROM {src}")
    return " UNION ALL ".join(parts)


def quartiles(value: str = "value") -> str:
    return (f"count({value}) AS nv, quantile_cont({value}, 0.5) AS median, "
            f"quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3")


def check_expr(item: str, nv: str) -> str:
    return (f"CASE WHEN contains({item}, 'truck') OR contains({item}, 'communal') OR contains({item}, 'piped') "
            f"THEN {nv} > 1 ELSE {nv} > 2 END")


# ---- prices ------------------------------------------------------------------

_PRICE_ITEM = title("replace(replace(pst.item, 'price_usd_', ''), '_', ' ')")
PRICE_CTES = (
    f"plong AS ({unpivot(PRICE_COLS)}), "
    f"pst AS (SELECT {LOC}, name AS item, {quartiles()} FROM plong GROUP BY ALL), "
    f"vlong AS ({unpivot(PRICE_COLS, keys=(q('vendor_type'),))}), "
    f"vi AS (SELECT DISTINCT {q('vendor_type')}, name AS item FROM vlong WHERE value IS NOT NULL), "
    f"prices AS (SELECT pst.{LOC}, {_PRICE_ITEM} AS item, "
    f"nv, median, q1, q3, {check_expr('pst.item', 'nv')} AS {q('check')}, vi.{q('vendor_type')} "
    f"FROM pst LEFT JOIN vi ON pst.item = vi.item)"
)


def _prices_global(v6: bool) -> str:
    if v6:
        stats = ("CAST(sum(nv) AS BIGINT) AS nv, quantile_cont(median, 0.25) AS q1, "
                 "quantile_cont(median, 0.75) AS q3, quantile_cont(median, 0.5) AS median")
        where = ""
    else:
        stats = ("CAST(sum(nv) AS BIGINT) AS nv, quantile_cont(q1, 0.5) AS q1, "
                 "quantile_cont(q3, 0.5) AS q3, quantile_cont(median, 0.5) AS median")
        where = f"WHERE {q('check')}"
    return with_survey(
        f"SELECT g.item, '_global' AS {LOC}, nv, {r6('q1', 'q1')}, {r6('q3', 'q3')}, {r6('median', 'median')}, "
        f"vt.{q('vendor_type')} FROM (SELECT item, {stats} FROM prices {where} GROUP BY item) g "
        f"JOIN (SELECT DISTINCT item, {q('vendor_type')} FROM prices {where}) vt ON g.item = vt.item",
        PRICE_CTES)


# ---- stock -------------------------------------------------------------------

def _dif_value(c: str) -> str:
    return f"replace(replace({c}, 'dk', 'no'), 'pnta', 'no')"


STOCK_CTES = (
    f"slong AS ({unpivot(STOCK_COLS)}), "
    f"sq AS (SELECT {LOC}, name AS item, {quartiles()} FROM slong GROUP BY ALL), "
    f"sl AS (SELECT {LOC}, replace(item, 'stock_len_', '') AS item, nv, median AS len_m, q1 AS len_q1, "
    f"q3 AS len_q3 FROM sq WHERE contains(item, 'stock_len_')), "
    f"stt AS (SELECT {LOC}, replace(item, 'stock_time_', '') AS item, median AS tim_m, q1 AS tim_q1, "
    f"q3 AS tim_q3 FROM sq WHERE contains(item, 'stock_time_')), "
    f"dlong AS ({unpivot(DIF_COLS, value_expr=_dif_value)}), "
    f"dcnt AS (SELECT {LOC}, name, value, count(*) AS n FROM dlong GROUP BY ALL), "
    f"dsh AS (SELECT *, n / sum(CASE WHEN value IS NOT NULL THEN n END) OVER "
    f"(PARTITION BY {LOC}, name) AS pc FROM dcnt), "
    f"dif AS (SELECT {LOC}, replace(name, 'stock_dif_', '') AS item, n AS dif, pc AS dif_pc FROM dsh "
    f"WHERE value = 'yes' UNION ALL SELECT {LOC}, replace(name, 'stock_dif_', '') AS item, "
    f"CAST(0 AS BIGINT) AS dif, CAST(0 AS DOUBLE) AS dif_pc FROM dsh WHERE value = 'no' AND pc = 1), "
    f"vlong AS ({unpivot(PRICE_COLS, keys=(q('vendor_type'),))}), "
    f"vinu AS (SELECT DISTINCT {q('vendor_type')}, replace(regexp_extract(name, '^(.*)_[^_]*$', 1), "
    f"'price_usd_', '') AS item FROM vlong WHERE value IS NOT NULL), "
    f"keys AS (SELECT {LOC}, item FROM sl UNION SELECT {LOC}, item FROM stt UNION SELECT {LOC}, item FROM dif), "
    f"j2 AS (SELECT keys.{LOC}, keys.item, nv, len_m, len_q1, len_q3, tim_m, tim_q1, tim_q3, dif, dif_pc "
    f"FROM keys LEFT JOIN sl ON keys.{LOC} IS NOT DISTINCT FROM sl.{LOC} AND keys.item = sl.item "
    f"LEFT JOIN stt ON keys.{LOC} IS NOT DISTINCT FROM stt.{LOC} AND keys.item = stt.item "
    f"LEFT JOIN dif ON keys.{LOC} IS NOT DISTINCT FROM dif.{LOC} AND keys.item = dif.item), "
    f"stock AS (SELECT j2.*, vinu.{q('vendor_type')}, {check_expr('j2.item', 'nv')} AS {q('check')} "
    f"FROM j2 LEFT JOIN vinu ON j2.item = vinu.item WHERE len_m IS NOT NULL)"
)
STOCK_NUMS = ["nv", "len_m", "len_q1", "len_q3", "tim_m", "tim_q1", "tim_q3", "dif", "dif_pc"]


def _stock_global(v6: bool) -> str:
    where = "" if v6 else f"WHERE {q('check')}"
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in STOCK_NUMS)
    outs = ", ".join(r6(c, c) for c in STOCK_NUMS)
    return with_survey(
        f"SELECT g.item, '_global' AS {LOC}, {outs}, vt.{q('vendor_type')} FROM "
        f"(SELECT item, {meds} FROM stock {where} GROUP BY item) g JOIN "
        f"(SELECT DISTINCT item, {q('vendor_type')} FROM stock {where}) vt ON g.item = vt.item", STOCK_CTES)


# ---- shares ------------------------------------------------------------------

def share_ctes(cols: dict[str, str], prefix: str) -> str:
    return (f"{prefix}long AS ({unpivot(list(cols), text=True, types=cols)}), "
            f"{prefix}cnt AS (SELECT {LOC}, name, value, count(*) AS n FROM {prefix}long GROUP BY ALL), "
            f"{prefix}sh0 AS (SELECT *, n / sum(CASE WHEN value IS NOT NULL THEN n END) OVER "
            f"(PARTITION BY {LOC}, name) AS pc, name || '__' || value AS k FROM {prefix}cnt), "
            f"{prefix}sh AS (SELECT {LOC}, replace(replace(k, '__1', ''), '.', '__') AS item, n, pc "
            f"FROM {prefix}sh0 WHERE value IS NOT NULL AND NOT contains(k, '__0'))")


def shares_sql(cols: dict[str, str]) -> str:
    return with_survey(f"SELECT {LOC}, item, n, {r6('pc', 'pc')} FROM s_sh", share_ctes(cols, "s_"))


def wide_sql(cols: dict[str, str], items: list[str]) -> str:
    piv = ", ".join(f"coalesce(max(CASE WHEN item = '{i}' THEN pc END), 0) AS {q(i)}" for i in items)
    meds = ", ".join(f"quantile_cont({q(i)}, 0.5) AS {q(i)}" for i in items)
    outs = ", ".join(r6(q(i), i) for i in items)
    return with_survey(
        f"SELECT {LOC}, {outs} FROM (SELECT * FROM w UNION ALL SELECT '_global' AS {LOC}, {meds} FROM w) u",
        share_ctes(cols, "s_") + f", w AS (SELECT {LOC}, {piv} FROM s_sh GROUP BY {LOC})")


def shares_v6_sql(cols: dict[str, str]) -> str:
    return with_survey(
        f"SELECT '_global' AS {LOC}, question || '__' || coalesce(answer, 'NA') AS item, {r6('n', 'n')}, "
        f"{r6('n / sum(n) OVER (PARTITION BY question)', 'pc')} FROM "
        f"(SELECT split_part(item, '__', 1) AS question, nullif(split_part(item, '__', 2), '') AS answer, "
        f"quantile_cont(n, 0.5) AS n FROM s_sh GROUP BY item) g",
        share_ctes(cols, "s_"))


def global_suppliers_sql() -> str:
    return with_survey(
        f"SELECT item, '_global' AS {LOC}, CAST(sum(n) AS BIGINT) AS n, {r6('quantile_cont(pc, 0.5)', 'pc')} "
        f"FROM s_sh GROUP BY item", share_ctes(SUPPLIER_COLS, "s_"))


# ---- numbers -----------------------------------------------------------------

SN_CTES = (f"sn AS (SELECT {LOC}, {q('vendor_type')}, quantile_cont(x, 0.5) AS median, "
           f"quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT {LOC}, "
           f"{q('vendor_type')}, CAST({q('supplier_number')} AS DOUBLE) AS x FROM survey) s "
           f"GROUP BY ALL HAVING NOT contains({q('vendor_type')}, 'water'))")
CN_CTES = (f"cn AS (SELECT {LOC}, " + ", ".join(
    f"quantile_cont({q(c)}, 0.5) AS {q(c + '_median')}, quantile_cont({q(c)}, 0.25) AS {q(c + '_q1')}, "
    f"quantile_cont({q(c)}, 0.75) AS {q(c + '_q3')}" for c in CREDIT_NUM_COLS) + f" FROM survey GROUP BY {LOC})")
CN_OUT = [f"{c}_{s}" for c in CREDIT_NUM_COLS for s in ("median", "q1", "q3")]


def oracle_sql() -> dict[str, str]:
    vt = q("vendor_type")
    return {
        "interviews_per_location": with_survey(f"SELECT {LOC}, count(*) AS nn FROM survey GROUP BY {LOC}"),
        "vendor_items": with_survey(f"SELECT {vt}, item FROM vi", PRICE_CTES),
        "price_table": with_survey(
            f"SELECT {LOC}, item, nv, {r6('median', 'median')}, {r6('q1', 'q1')}, {r6('q3', 'q3')}, "
            f"{q('check')}, {vt} FROM prices", PRICE_CTES),
        "availability": with_survey(f"SELECT {LOC}, item, nv, {vt} FROM prices", PRICE_CTES),
        "global_prices": _prices_global(False),
        "global_prices_v6": _prices_global(True),
        "stock_quantiles": with_survey(
            f"SELECT {LOC}, name AS item, nv, {r6('median', 'median')}, {r6('q1', 'q1')}, {r6('q3', 'q3')} FROM "
            f"(SELECT {LOC}, name, {quartiles()} FROM slong GROUP BY ALL) x", f"slong AS ({unpivot(STOCK_COLS)})"),
        "stock_length": with_survey(
            f"SELECT {LOC}, item, nv, {r6('len_m', 'len_m')}, {r6('len_q1', 'len_q1')}, {r6('len_q3', 'len_q3')} "
            f"FROM sl", STOCK_CTES),
        "stock_time": with_survey(
            f"SELECT {LOC}, item, {r6('tim_m', 'tim_m')}, {r6('tim_q1', 'tim_q1')}, {r6('tim_q3', 'tim_q3')} "
            f"FROM stt", STOCK_CTES),
        "stock_difficulty": with_survey(f"SELECT {LOC}, item, dif, {r6('dif_pc', 'dif_pc')} FROM dif", STOCK_CTES),
        "vendor_items_no_unit": with_survey(f"SELECT {vt}, item FROM vinu", STOCK_CTES),
        "stock_table": with_survey(
            f"SELECT {LOC}, item, nv, " + ", ".join(r6(c, c) for c in STOCK_NUMS[1:7]) + ", dif, "
            f"{r6('dif_pc', 'dif_pc')}, {vt}, {q('check')} FROM stock", STOCK_CTES),
        "global_stock": _stock_global(False),
        "global_stock_v6": _stock_global(True),
        "barrier_shares": shares_sql(BARRIER_COLS),
        "payment_shares": shares_sql(PAYMENT_COLS),
        "supplier_shares": shares_sql(SUPPLIER_COLS),
        "credit_shares": shares_sql(CREDIT_COLS),
        "global_barrier_wide": wide_sql(BARRIER_COLS, BARRIER_ITEMS),
        "global_payment_wide": wide_sql(PAYMENT_COLS, PAYMENT_ITEMS),
        "global_credit_wide": wide_sql(CREDIT_COLS, CREDIT_ITEMS),
        "global_shares_v6": shares_v6_sql(BARRIER_COLS),
        "global_shares_v6_payment": shares_v6_sql(PAYMENT_COLS),
        "global_shares_v6_credit": shares_v6_sql(CREDIT_COLS),
        "filter_round": with_survey(f"SELECT {LOC}, count(*) AS nn FROM survey WHERE {q('jmmi_date')} = '9506' GROUP BY {LOC}"),
        "global_suppliers": global_suppliers_sql(),
        "supplier_numbers": with_survey(
            f"SELECT {LOC}, {vt}, {r6('median', 'median')}, {r6('q1', 'q1')}, {r6('q3', 'q3')} FROM sn", SN_CTES),
        "global_supplier_numbers": with_survey(
            f"SELECT {vt}, '_global' AS {LOC}, {r6('quantile_cont(median, 0.5)', 'median')}, "
            f"{r6('quantile_cont(q1, 0.5)', 'q1')}, {r6('quantile_cont(q3, 0.5)', 'q3')} FROM sn GROUP BY {vt}",
            SN_CTES),
        "credit_numbers": with_survey(f"SELECT {LOC}, " + ", ".join(r6(q(c), c) for c in CN_OUT) + " FROM cn",
                                      CN_CTES),
        "global_credit_numbers": with_survey(
            f"SELECT '_global' AS {LOC}, " + ", ".join(r6(f"quantile_cont({q(c)}, 0.5)", c) for c in CN_OUT)
            + " FROM cn", CN_CTES),
    }


# ---- supply ------------------------------------------------------------------------

def _supply_sql() -> dict[str, str]:
    sup = f"supply AS ({demo.supply_sql('duckdb')})"
    origin = f"coalesce({q('supplier_district')}, {q('supplier_country')})"
    items = ["supplier_items.rice", "supplier_items.oil", "supplier_items.soap"]
    sums = ", ".join(f"CAST(sum({q(i)}) AS BIGINT) AS {q(i)}" for i in items)
    unp = " UNION ALL ".join(
        f"SELECT supplier_origin, '{i.replace('supplier_items.', '')}' AS item, {q(i)} AS value FROM g" for i in items)
    return {
        "supply_pairs": with_survey(
            "SELECT pair, 'supplier_route__' || route AS item, n, "
            "round(n / sum(n) OVER (PARTITION BY pair), 6) AS pc FROM c",
            f"{sup}, c AS (SELECT {q('supplier_destination')} || '__' || {origin} AS pair, "
            f"{q('supplier_route')} AS route, count(*) AS n FROM supply GROUP BY ALL)"),
        "supply_items": with_survey(
            f"SELECT supplier_origin, item, value FROM ({unp}) u WHERE value <> 0",
            f"{sup}, g AS (SELECT {origin} AS supplier_origin, {sums} FROM supply GROUP BY ALL)"),
    }


# ---- validation -----------------------------------------------------------------------

def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


NUMERIC_ANSWER_COLS = PRICE_COLS + ["price_usd_rice_other"] + STOCK_COLS + [
    "supplier_number", "credit_max_usd", "credit_total_usd"]
OTHER_COLS = {"price_usd_rice_other": "double", "barrier_finance_other": "string",
              "supplier_source_other": "string", "cva_effect_other": "string"}


def _minutes_sql(ts: str) -> str:
    t = f"substr(split_part({ts}, 'T', 2), 1, 8)"
    return (f"round(CAST(split_part({t}, ':', 1) AS DOUBLE) * 60 + CAST(split_part({t}, ':', 2) AS DOUBLE) "
            f"+ CAST(split_part({t}, ':', 3) AS DOUBLE) / 60, 2)")


def _outlier_ctes(src: str = "survey") -> str:
    idx = q("index")
    long = " UNION ALL ".join(f"SELECT {idx}, '{c}' AS variable, CAST({q(c)} AS DOUBLE) AS value FROM {src}"
                              for c in NUMERIC_ANSWER_COLS)
    return (f"olong AS (SELECT * FROM ({long}) u WHERE value IS NOT NULL), "
            f"ost AS (SELECT variable, avg(value) AS m, stddev_samp(value) AS s, "
            f"avg(CASE WHEN value > 0 THEN ln(value) END) AS lm, "
            f"stddev_samp(CASE WHEN value > 0 THEN ln(value) END) AS ls FROM olong GROUP BY variable), "
            f"outl AS (SELECT {idx}, value, variable, true AS has_issue, '{_outlier_normal()}' AS issue_type "
            f"FROM olong JOIN ost USING (variable) WHERE abs(value - m) > 3 * s UNION ALL "
            f"SELECT {idx}, value, variable, true AS has_issue, '{_outlier_log()}' AS issue_type FROM olong "
            f"JOIN ost USING (variable) WHERE value > 0 AND abs(ln(value) - lm) > 3 * ls)")


def _outlier_normal():
    from ..operators.quality import OUTLIER_NORMAL
    return OUTLIER_NORMAL


def _outlier_log():
    from ..operators.quality import OUTLIER_LOG
    return OUTLIER_LOG


def _sensitive_sql() -> str:
    from ..operators.quality import SENSITIVE, SENSITIVE_WORDS
    names = [c for c in demo.survey_columns() if any(w in c.lower() for w in SENSITIVE_WORDS)]
    return "".join(f" UNION ALL SELECT NULL, NULL, '{c}', true, '{SENSITIVE}'" for c in names)


def _validation_sql() -> dict[str, str]:
    uid, quest, idx = q("uuid"), q("question"), q("index")
    logc = f"log AS ({demo.log_sql('duckdb')})"
    dele = f"deletions AS ({demo.deletions_sql('duckdb')})"
    names = ", ".join(f"'{c}'" for c in demo.survey_columns())
    rlog = (f"rlog AS (SELECT * FROM log WHERE {uid} IN (SELECT {uid} FROM survey) "
            f"AND {quest} IN ({names}))")
    cell = ("CASE l." + quest + " " + " ".join(
        f"WHEN '{c}' THEN {demo.render_sql('s.' + q(c), t)}" for c, t in demo._LOG_TYPES.items()) + " END")
    na = "'N/A'"
    check_log = with_survey(
        f"SELECT * FROM (SELECT coalesce({uid}, {na}) AS {uid}, {quest}, "
        f"coalesce({_trim(q('old_value'))}, {na}) AS {q('old_value')}, "
        f"coalesce({_trim(q('new_value'))}, {na}) AS {q('new_value')}, {_trim(f'coalesce(cell, {na})')} AS "
        f"value_extracted, 'Please check log' AS {q('check')} FROM j) x WHERE {q('new_value')} <> value_extracted",
        f"{logc}, {rlog}, j AS (SELECT l.*, {cell} AS cell FROM rlog l LEFT JOIN survey s ON l.{uid} = s.{uid})")
    sm, em = _minutes_sql(q("start")), _minutes_sql(q("end"))
    days = (f"date_diff('day', CAST(split_part({q('start')}, 'T', 1) AS DATE), "
            f"CAST(split_part({q('end')}, 'T', 1) AS DATE))")
    check_time = with_survey(
        f"SELECT {uid}, round(d, 6) AS value, 'Completion Duration (min)' AS variable, 'TRUE' AS has_issue, "
        f"CASE WHEN d <= 5 THEN 'form duration too short' ELSE 'form duration too long' END AS issue_type "
        f"FROM (SELECT {uid}, {em} - {sm} AS d FROM survey WHERE {days} = 0) t WHERE d <= 5 OR d >= 60")
    other_long = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {demo.render_sql(q(c), t)} AS value FROM survey" for c, t in OTHER_COLS.items())
    sample = f"sample AS ({demo.survey_copies_sql('duckdb', source='survey0')})"
    owner = (f"SELECT o.{idx}, round(o.value, 6) AS value, o.variable, o.has_issue, o.issue_type, s.{uid}, "
             f"s.{q('enumerator_org')} AS ngo FROM outl o LEFT JOIN survey s ON o.{idx} = s.{idx}")
    return {
        "check_log": check_log,
        "log_unknown_uuids": with_survey(
            f"SELECT * FROM log WHERE {uid} NOT IN (SELECT {uid} FROM survey) "
            f"AND {uid} IN (SELECT {uid} FROM deletions)", f"{logc}, {dele}"),
        "log_unknown_questions": with_survey(f"SELECT * FROM log WHERE {quest} NOT IN ({names})", logc),
        "restrict_log": with_survey("SELECT * FROM rlog", f"{logc}, {rlog}"),
        "undeleted": with_survey(f"SELECT * FROM deletions WHERE {uid} IN (SELECT {uid} FROM survey)", dele),
        "check_time": check_time,
        "find_outliers": with_survey(
            f"SELECT {idx}, round(value, 6) AS value, variable, has_issue, issue_type FROM outl", _outlier_ctes()),
        "find_duplicates": with_survey(
            f"SELECT {idx}, {uid} AS value, 'uuid' AS variable, true AS has_issue, 'duplicated value' AS issue_type "
            f"FROM sample WHERE {uid} IN (SELECT {uid} FROM sample GROUP BY {uid} HAVING count(*) > 1)", sample),
        "find_other_responses": with_survey(
            f"SELECT CAST(NULL AS BIGINT) AS {idx}, value, variable, true AS has_issue, "
            f"'''other'' response. may need recoding.' AS issue_type, count(*) AS n FROM ({other_long}) u "
            f"WHERE value IS NOT NULL GROUP BY ALL"),
        "inspect_all": with_survey(
            f"SELECT {idx}, {demo.render_sql('value', 'double')} AS value, variable, has_issue, issue_type FROM outl UNION ALL "
            f"SELECT {idx}, {uid}, 'uuid', true, 'duplicated value' FROM survey WHERE {uid} IN "
            f"(SELECT {uid} FROM survey GROUP BY {uid} HAVING count(*) > 1) UNION ALL "
            f"SELECT NULL, value, variable, true, '''other'' response. may need recoding.' FROM ({other_long}) u "
            f"WHERE value IS NOT NULL GROUP BY value, variable{_sensitive_sql()}", _outlier_ctes()),
        "attach_issue_owner": with_survey(
            f"SELECT * FROM ({owner}) w WHERE {uid} NOT IN (SELECT {uid} FROM log)", f"{logc}, {_outlier_ctes()}"),
        "attach_issue_owner_logged": with_survey(
            f"SELECT * FROM ({owner}) w WHERE {idx} IS NOT NULL AND {uid} IN (SELECT {uid} FROM log)",
            f"{logc}, {_outlier_ctes()}"),
        "convert_col_types": with_survey("SELECT " + ", ".join(
            _converted(c) for c in demo.survey_columns()) + " FROM survey0"),
    }


def _survey_type(c: str) -> str:
    ints = {"barrier_transport.road", "barrier_transport.cost", "payment_mode.cash", "payment_mode.mobile",
            "cva_effect.stock", "supplier_number", "index"}
    doubles = set(PRICE_COLS) | set(STOCK_COLS) | {"price_usd_rice_other", "cva_effect.prices",
                                                   "credit_max_usd", "credit_total_usd"}
    return "int" if c in ints else "double" if c in doubles else "string"


def _converted(c: str) -> str:
    tool = dict(demo.tool_rows())
    text = demo.render_sql(q(c), _survey_type(c))
    if tool.get(c) in ("integer", "decimal", "calculate"):
        return f"TRY_CAST(trim({text}) AS DOUBLE) AS {q(c)}"
    return f"{text} AS {q(c)}"


# ---- comparison ----------------------------------------------------------------------------

def _compare_sql(positional: bool = False) -> dict[str, str]:
    """Rows are aligned by grouping the union of both sides on the key (no join): the uuid, or the
    row's place by uuid (which is then compared like other columns)."""
    uid = "place" if positional else q("uuid")
    key = f"row_number() OVER (ORDER BY {q('uuid')}) AS place" if positional else uid
    cols = [c for c in demo.survey_columns() if c not in ("uuid",) * (not positional) + ("avail_shop_rice", "supplier_number")]
    xs = ", ".join(f"{q(c)} AS {q('x:' + c)}, NULL AS {q('y:' + c)}" for c in cols)
    ys = ", ".join(f"NULL AS {q('x:' + c)}, {q(c)} AS {q('y:' + c)}" for c in cols)
    picks = ", ".join(f"max({q('x:' + c)}) AS {q('x:' + c)}, max({q('y:' + c)}) AS {q('y:' + c)}" for c in cols)
    ctes = (f"y AS ({demo.survey_edited_sql('duckdb', source='survey0')}), "
            f"u AS (SELECT {key}, 1 AS in_x, 0 AS in_y, {xs} FROM survey0 UNION ALL "
            f"SELECT {key}, 0 AS in_x, 1 AS in_y, {ys} FROM y), "
            f"g AS (SELECT {uid}, max(in_x) AS in_x, max(in_y) AS in_y, {picks} FROM u GROUP BY {uid})")

    def differs(c: str) -> str:
        a, b = q("x:" + c), q("y:" + c)
        t = _survey_type(c)
        neq = f"abs(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) > 1.5e-8" if t != "string" else f"{a} <> {b}"
        return f"(({a} IS NULL) <> ({b} IS NULL) OR ({a} IS NOT NULL AND {b} IS NOT NULL AND {neq}))"

    cells = " UNION ALL ".join(
        f"SELECT {uid}, '{c}' AS variable, {demo.render_sql(q('x:' + c), _survey_type(c))} AS value_x, "
        f"{demo.render_sql(q('y:' + c), _survey_type(c))} AS value_y FROM g "
        f"WHERE in_x = 1 AND in_y = 1 AND {differs(c)}" for c in cols)
    diffs = ", ".join(f"CAST(sum(CASE WHEN in_x = 1 AND in_y = 1 AND {differs(c)} THEN 1 ELSE 0 END) AS BIGINT) "
                      f"AS {q('diff:' + c)}" for c in cols)
    counts = (f"SELECT sum(in_x) AS nrow_x, sum(in_y) AS nrow_y, sum(CASE WHEN in_y = 0 THEN 1 ELSE 0 END) "
              f"AS rows_only_x, sum(CASE WHEN in_x = 0 THEN 1 ELSE 0 END) AS rows_only_y, "
              f"sum(in_x * in_y) AS rows_both, {diffs}, 60 AS ncol_x, 60 AS ncol_y, {58 + positional} AS ncol_shared, "
              f"1 AS ncol_not_compared, 1 AS ncol_only_x, 1 AS ncol_only_y, 1 AS {q('not_compared:supplier_number')}, "
              f"1 AS {q('only_x:avail_shop_rice')}, 1 AS {q('only_y:extra_note')} FROM g")
    names = (["nrow_x", "nrow_y", "rows_only_x", "rows_only_y", "rows_both"] + [f"diff:{c}" for c in cols]
             + ["ncol_x", "ncol_y", "ncol_shared", "ncol_not_compared", "ncol_only_x", "ncol_only_y",
                "not_compared:supplier_number", "only_x:avail_shop_rice", "only_y:extra_note"])
    unp = " UNION ALL ".join(f"SELECT '{n}' AS item, CAST({q(n)} AS BIGINT) AS value FROM cnt" for n in names)
    return {
        "compare_tables": with_survey(cells, ctes, materialized=("g",)),
        "compare_unmatched": with_survey(
            f"SELECT {uid}, CASE WHEN in_x = 1 THEN 'x' ELSE 'y' END AS side FROM g WHERE in_x + in_y = 1", ctes, materialized=("g",)),
        "compare_summary": with_survey(unp, f"{ctes}, cnt AS ({counts})", materialized=("g", "cnt")),
    }


# ---- falsification: independent exact SQL (one-level pigeonhole join; pairwise Gower) ----

def _answer_cols() -> list[str]:
    from ..operators.quality import NON_ANSWER_TYPES
    tool = dict(demo.tool_rows())
    return [c for c in demo.survey_columns()
            if tool.get(c) not in NON_ANSWER_TYPES and not c.startswith("_") and "/" not in c]


def _silhouette_cols() -> list[str]:
    """All answer columns (option columns too) but the area, the enumerator and the row index."""
    from ..operators.quality import NON_ANSWER_TYPES
    tool = dict(demo.tool_rows())
    return [c for c in demo.survey_columns() if tool.get(c) not in NON_ANSWER_TYPES and not c.startswith("_")
            and c not in (LOC.strip('"'), "enumerator", "index")]


def _nearest_sql(max_diff: int, copies: bool = True) -> str:
    cols = _answer_cols()
    idx = q("index")
    vals = ", ".join(f"coalesce({demo.render_sql(q(c), _survey_type(c))}, 'NA') AS {q(c)}" for c in cols)
    bands = []
    for b in range(max_diff):
        on = " AND ".join(f"a.{q(c)} = b.{q(c)}" for c in cols[b::max_diff])
        bands.append(f"SELECT a.id AS i, b.id AS j FROM m a JOIN m b ON {on} WHERE a.id < b.id")
    dist = " + ".join(f"CASE WHEN a.{q(c)} = b.{q(c)} THEN 0 ELSE 1 END" for c in cols)
    not_na = " + ".join(f"CASE WHEN {q(c)} <> 'NA' THEN 1 ELSE 0 END" for c in cols)
    source = demo.survey_copies_sql("duckdb", source="survey0") if copies else "SELECT * FROM survey0"
    ctes = (f"sample AS ({source}), "
            f"m AS (SELECT CAST({idx} AS BIGINT) AS id, {vals} FROM sample), "
            f"cand AS (SELECT DISTINCT i, j FROM ({' UNION ALL '.join(bands)}) u), "
            f"scored AS (SELECT cand.i, cand.j, {dist} AS d FROM cand JOIN m a ON a.id = cand.i "
            f"JOIN m b ON b.id = cand.j), "
            f"both_dir AS (SELECT i, j, d FROM scored WHERE d < {max_diff} UNION ALL "
            f"SELECT j AS i, i AS j, d FROM scored WHERE d < {max_diff}), "
            f"best AS (SELECT i, min(d) AS d FROM both_dir GROUP BY i), "
            f"nearest AS (SELECT b.i, b.d, min(x.j) AS j FROM best b JOIN both_dir x ON x.i = b.i AND x.d = b.d "
            f"GROUP BY b.i, b.d)")
    body = (f"SELECT " + ", ".join(f"m.{q(c)}" for c in cols) + f", {not_na} AS n_col_not_na, m.id AS survey_id, "
            f"nearest.j AS most_similar_survey, CAST(nearest.d AS BIGINT) AS number_different_columns "
            f"FROM m JOIN nearest ON nearest.i = m.id")
    return with_survey(body, ctes, materialized=("sample", "m", "scored", "both_dir"))


def _search_sql(asked: str = "id % 100 = 0") -> str:
    """The asked interviews (every hundredth) against all others."""
    cols = _answer_cols()
    vals = ", ".join(f"coalesce({demo.render_sql(q(c), _survey_type(c))}, 'NA') AS {q(c)}" for c in cols)
    dist = " + ".join(f"CASE WHEN a.{q(c)} = b.{q(c)} THEN 0 ELSE 1 END" for c in cols)
    codes = ", ".join(f"dense_rank() OVER (ORDER BY {q(c)}) AS {q(c)}" for c in cols)
    not_na = " + ".join(f"CASE WHEN {q(c)} <> 'NA' THEN 1 ELSE 0 END" for c in cols)
    ctes = (f"sample AS ({demo.survey_copies_sql('duckdb', source='survey0')}), "
            f"m AS (SELECT CAST({q('index')} AS BIGINT) AS id, {vals} FROM sample), "
            f"asked AS (SELECT * FROM m WHERE {asked}), "
            # answers as numbers, and the distance and the other id in one: no pair is kept
            f"coded AS (SELECT id, {codes} FROM m), "
            f"best AS (SELECT a.id AS i, min(CAST({dist} AS BIGINT) * 1000000000000 + b.id) AS best FROM coded a JOIN coded b ON a.id <> b.id "
            f"WHERE a.id IN (SELECT id FROM asked) GROUP BY a.id), "
            f"nearest AS (SELECT i, best // 1000000000000 AS d, best % 1000000000000 AS j FROM best)")
    body = (f"SELECT " + ", ".join(f"m.{q(c)}" for c in cols) + f", {not_na} AS n_col_not_na, m.id AS survey_id, "
            f"nearest.j AS most_similar_survey, CAST(nearest.d AS BIGINT) AS number_different_columns "
            f"FROM asked m LEFT JOIN nearest ON nearest.i = m.id")
    return with_survey(body, ctes, materialized=("sample", "m", "coded", "best"))


def _silhouette_sql(columns: list[str]) -> str:
    tool = dict(demo.tool_rows())
    num = [c for c in columns if tool.get(c) in ("integer", "decimal", "calculate")] + ["n"]
    cat = [LOC.strip('"')] + [c for c in columns if c not in num]
    conv = ", ".join(
        (f"TRY_CAST(trim({demo.render_sql(q(c), _survey_type(c))}) AS DOUBLE) AS {q(c)}" if c in num
         else f"{demo.render_sql(q(c), _survey_type(c))} AS {q(c)}") for c in cat + num if c != "n")
    feats = cat + num
    parts_num, parts_den = [], []
    for c in feats:
        a, b = f"a.{q(c)}", f"b.{q(c)}"
        both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
        if c in num:
            d = f"CASE WHEN r.{q('r_' + c)} > 0 THEN abs({a} - {b}) / r.{q('r_' + c)} ELSE 0 END"
        else:
            d = f"CASE WHEN {a} = {b} THEN 0 ELSE 1 END"
        parts_num.append(f"CASE WHEN {both} THEN {d} ELSE 0 END")
        parts_den.append(f"CASE WHEN {both} THEN 1 ELSE 0 END")
    ranges = ", ".join(f"max({q(c)}) - min({q(c)}) AS {q('r_' + c)}" for c in num)
    enum = q("enumerator")
    ctes = (f"t AS (SELECT CAST({q('index')} AS BIGINT) AS id, {enum} AS enum, {conv} FROM survey "
            f"WHERE {LOC} IS NOT NULL AND {enum} IS NOT NULL), "
            f"sz AS (SELECT {LOC}, enum, count(*) AS n FROM t GROUP BY ALL), "
            f"k AS (SELECT {LOC} FROM sz WHERE n >= 5 GROUP BY {LOC} HAVING count(*) > 1), "
            f"rows AS (SELECT t.*, CAST(sz.n AS DOUBLE) AS n, sz.n AS nc FROM t JOIN sz USING ({LOC}, enum) "
            f"WHERE sz.n >= 5 AND {LOC} IN (SELECT {LOC} FROM k)), "
            f"r AS (SELECT {LOC}, {ranges} FROM rows GROUP BY {LOC}), "
            f"pairs AS (SELECT a.id AS i, a.{LOC} AS area, a.enum AS own, a.nc AS nown, b.enum AS c, b.nc AS nc, "
            f"({' + '.join(parts_num)}) / ({' + '.join(parts_den)}) AS d FROM rows a JOIN rows b "
            f"ON a.{LOC} = b.{LOC} AND a.id <> b.id JOIN r ON r.{LOC} = a.{LOC}), "
            f"per AS (SELECT i, area, own, nown, c, sum(d) / max(CASE WHEN c = own THEN nc - 1 ELSE nc END) AS md "
            f"FROM pairs GROUP BY ALL), "
            f"ab AS (SELECT i, area, own, nown, max(CASE WHEN c = own THEN md END) AS a, "
            f"min(CASE WHEN c <> own THEN md END) AS b FROM per GROUP BY ALL), "
            f"s AS (SELECT area, own, CASE WHEN nown > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) "
            f"ELSE 0 END AS s FROM ab)")
    body = (f"SELECT s.area AS {LOC}, s.own AS {enum}, sz.n AS num_surveys, round(avg(s.s), 6) AS si "
            f"FROM s JOIN sz ON sz.{LOC} = s.area AND sz.enum = s.own GROUP BY s.area, s.own, sz.n")
    return with_survey(body, ctes, materialized=("t", "rows", "pairs"))


_base_oracle_sql = oracle_sql


def oracle_sql() -> dict[str, str]:  # noqa: F811
    out = _base_oracle_sql()
    out.update(_supply_sql())
    out.update(_validation_sql())
    out.update(_compare_sql())
    out["near_duplicates"] = _nearest_sql(5)
    out["nearest_survey"] = _search_sql()
    out["nearest_survey_all"] = _search_sql("true")
    out["enumerator_similarity"] = _silhouette_sql(_silhouette_cols())
    for sheet, local, glob in (("sheet_items", "price_table", "global_prices"),
                               ("sheet_stock", "stock_table", "global_stock"),
                               ("sheet_supplier1", "supplier_shares", "global_suppliers"),
                               ("sheet_supplier2", "supplier_numbers", "global_supplier_numbers"),
                               ("sheet_credit2", "credit_numbers", "global_credit_numbers")):
        out[sheet] = f"SELECT * FROM ({out[local]}) l UNION ALL BY NAME SELECT * FROM ({out[glob]}) g"
    out["compare_bundles"] = f"SELECT 'data' AS sheet, item, value FROM ({out['compare_summary']}) c"
    every = ", ".join(q(c) for c in demo.survey_columns())
    out["row_index"] = with_survey(f"SELECT {every}, row_number() OVER (ORDER BY {q('uuid')}) AS position FROM survey")
    # a text column is a number once read where all its cells are written as one
    read = [f"CAST({q(c)} AS BIGINT) AS {q(c)}" if c == "jmmi_date" else
            f"CASE WHEN {q(c)} IN ('', ' ', 'NA') THEN NULL ELSE {q(c)} END AS {q(c)}" if _survey_type(c) == "string" else q(c) for c in demo.survey_columns()]
    remark = f"'seen' || chr(10) || 'by ' || {q('enumerator')} || ', \"' || {q('uuid')} || '\"' AS remark"
    out["read_csv"] = with_survey(f"SELECT {', '.join(read)}, {remark} FROM survey")
    out["drop_all_null_columns"] = with_survey(f"SELECT {every} FROM survey")
    counts = {"deleted_still_in_data": "undeleted", "uuid_not_in_dataset": "log_unknown_uuids",
              "questions_not_in_dataset": "log_unknown_questions", "cleaning_log_not_applied": "check_log",
              "cleaning_check": "attach_issue_owner", "enumerator_similarity": "enumerator_similarity"}
    sql = {name: out[query] for name, query in counts.items()} | {"similar_surveys": _nearest_sql(5, copies=False), "most_similar_surveys": with_survey("SELECT * FROM survey")}
    # name findings have no row index, so they belong to no logged interview
    more = {"cleaning_check": _sensitive_sql().count("UNION ALL")}
    out["validation_outputs"] = " UNION ALL ".join(
        f"SELECT '{name}' AS output, (SELECT count(*) FROM ({text}) v{i}) + {more.get(name, 0)} AS n" for i, (name, text) in enumerate(sql.items()))
    from .analysis import SHEETS
    of = {"items": "sheet_items", "stock": "sheet_stock", "barrier": "global_barrier_wide", "payment": "global_payment_wide",
          "supplier1": "sheet_supplier1", "supplier2": "sheet_supplier2", "credit1": "global_credit_wide", "credit2": "sheet_credit2"}
    from .registry import SHEET_ROW_KEYS
    sheet_keys = {"barrier": ("call_location",), "payment": ("call_location",), "credit1": ("call_location",), "credit2": ("call_location",),
                  "supplier1": ("call_location", "item"), "supplier2": ("call_location", "vendor_type")}
    cells = []
    for i, name in enumerate(SHEETS):
        keys = sheet_keys.get(name, SHEET_ROW_KEYS)
        listed = ", ".join(keys)
        shown = ", ".join(k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}" for k in SHEET_ROW_KEYS)
        rows = f"SELECT {listed}, CAST(COLUMNS(* EXCLUDE ({listed})) AS DOUBLE) FROM ({out[of[name]]}) x{i}"
        cells.append(f"SELECT {i} AS position, '{name}' AS sheet, {shown}, variable, value "
                     f"FROM (UNPIVOT ({rows}) ON COLUMNS(* EXCLUDE ({listed})) INTO NAME variable VALUE value) u{i}")
    out["analysis_bundle"] = " UNION ALL ".join(cells)
    out["read_sheet_first"] = with_survey("SELECT * FROM log", f"log AS ({demo.log_sql('duckdb')})")
    out["read_sheet_position"] = with_survey("SELECT * FROM deletions", f"deletions AS ({demo.deletions_sql('duckdb')})")
    out["read_sheet_named"] = with_survey(f"SELECT {every} FROM survey")
    out["sheet_order"] = ("SELECT *, row_number() OVER (ORDER BY vendor_type NULLS LAST, item NULLS LAST, call_location NULLS LAST) AS place "
                          f"FROM ({out['sheet_items']}) o")
    out["similarity_order"] = f"SELECT *, row_number() OVER (ORDER BY si DESC, call_location, enumerator) AS place FROM ({out['enumerator_similarity']}) o"
    out["dated_csv"] = out["check_time"]
    out["compare_positions"] = _compare_sql(positional=True)["compare_summary"]
    return out
