"""The same results in plain SQL, written independently of the Spark code."""

from __future__ import annotations

TABLES = {
    "benchmark": 2, "conversations": 4, "customer": 5, "documents": 5, "embeddings": 3, "events": 6, "labels": 3,
    "lineitem": 11, "nation": 3, "orders": 6, "pages": 3, "part": 6, "region": 2, "supplier": 4,
}
ZONE_OF_PORT = """CASE
    WHEN port IN ('NATION_1', 'NATION_2', 'NATION_3') THEN 'North'
    WHEN port IN ('NATION_4', 'NATION_5', 'NATION_6', 'NATION_7') THEN 'South-West'
    WHEN port IN ('NATION_8', 'NATION_9', 'NATION_10') THEN 'South-East'
    WHEN port IN ('NATION_11', 'NATION_12', 'NATION_13') THEN 'West Islands'
    WHEN port IN ('NATION_14', 'NATION_15', 'NATION_16') THEN 'East Islands'
    ELSE 'otro' END"""
CUSTOMERS = f"""customers AS (
  SELECT id, port, {ZONE_OF_PORT} AS zona FROM (
    SELECT c_custkey AS id, nullif(n_name, 'NATION_24') AS port
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey))"""
SUPPLIERS = f"""suppliers AS (
  SELECT id, port, {ZONE_OF_PORT} AS zona FROM (
    SELECT s_suppkey AS id, nullif(n_name, 'NATION_24') AS port
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey))"""


def _raw(value: str, b1, b2, b3, b4, na: str, null: str) -> str:
    return (f"CASE WHEN {null} THEN NULL WHEN {na} THEN 'NA' WHEN {value} <= {b1} THEN 'much less' "
            f"WHEN {value} <= {b2} THEN 'less' WHEN {value} <= {b3} THEN 'same' "
            f"WHEN {value} <= {b4} THEN 'more' ELSE 'much more' END")


DISCOUNT, TAX = "CAST(floor(l_discount * 100 + 0.5) AS INTEGER)", "CAST(floor(l_tax * 100 + 0.5) AS INTEGER)"
ANSWERS = f"""answers AS (
  SELECT l_suppkey AS id, l_orderkey, l_linenumber,
    {_raw('l_quantity', 10, 20, 30, 40, 'l_quantity >= 49', 'l_quantity >= 50')} AS quantity,
    {_raw(DISCOUNT, 1, 3, 5, 7, f'{DISCOUNT} >= 10', 'false')} AS discount,
    {_raw(TAX, 0, 2, 4, 6, 'false', f'{TAX} >= 8')} AS tax,
    {_raw('l_extendedprice', 20000, 40000, 60000, 80000, 'l_extendedprice >= 103000', 'l_extendedprice >= 104000')} AS price
  FROM lineitem)"""


def _lev(item: str) -> str:
    return (f"CASE {item} WHEN 'much less' THEN 'Very Negative' WHEN 'less' THEN 'Negative' "
            f"WHEN 'same' THEN 'Neutral' WHEN 'more' THEN 'Positive' WHEN 'much more' THEN 'Very Positive' END")


ITEMS = ("quantity", "discount", "tax", "price")
LEVEL_ANSWERS = f"""{SUPPLIERS}, {ANSWERS}, levelled AS (
  SELECT l_orderkey, l_linenumber, a.id, zona, {', '.join(f'{_lev("a." + i)} AS {i}' for i in ITEMS)}
  FROM answers a LEFT JOIN suppliers s ON a.id = s.id)"""
LEVELS = """levels(level, ordinal) AS (VALUES ('Very Negative', 1), ('Negative', 2), ('Neutral', 3),
  ('Positive', 4), ('Very Positive', 5))"""
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT zona, '{i}' AS item, {i} AS level FROM levelled" for i in ITEMS) + ")"
LIKERT = f"""{LEVEL_ANSWERS}, {LEVELS}, {LONG},
  pairs AS (SELECT DISTINCT zona, item FROM long),
  counted AS (SELECT zona, item, level, count(*) AS n FROM long WHERE level IS NOT NULL GROUP BY ALL),
  cells AS (SELECT p.zona, p.item, l.level, l.ordinal, coalesce(c.n, 0) AS n
    FROM pairs p CROSS JOIN levels l LEFT JOIN counted c
    ON c.zona = p.zona AND c.item = p.item AND c.level = l.level)"""
CELL_SHARES = """SELECT zona, item, level, CAST(ordinal AS INTEGER) AS ordinal, CAST(n AS BIGINT) AS n,
  n::DOUBLE / nullif(sum(n) OVER (PARTITION BY zona, item), 0)::DOUBLE * 100 AS percent FROM cells"""
OPINIONS = f"""{CUSTOMERS}, opinions AS (
  SELECT o_orderkey, o_custkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE o_orderstatus END AS answer,
    CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS sub_answer
  FROM orders), zoned AS (SELECT o.*, c.port, c.zona FROM opinions o LEFT JOIN customers c ON o.id = c.id)"""
REPORTS = f"""{SUPPLIERS}, reports AS (
  SELECT l_suppkey AS id, CASE WHEN p_brand = 'Brand#7' THEN 'NA' ELSE p_brand END AS sp_cien,
    CASE WHEN l_linenumber = 7 THEN 'NA' ELSE l_returnflag END AS abundancia
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
  zoned AS (SELECT r.*, s.zona FROM reports r LEFT JOIN suppliers s ON r.id = s.id),
  denominators AS (SELECT zona, count(*) AS respondents FROM suppliers WHERE zona <> 'otro' GROUP BY zona)"""
MONTH_NAMES = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre",
               "Noviembre", "Diciembre"]
MONTHS = "months(m, mes) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(MONTH_NAMES, 1)) + ")"
MONTHLY = f"""{MONTHS}, monthly AS (
  SELECT o_custkey AS id, mes, count(*)::DOUBLE AS n FROM orders LEFT JOIN months ON m = month(o_orderdate) GROUP BY ALL),
  grid AS (SELECT id, mes FROM (SELECT DISTINCT o_custkey AS id FROM orders) CROSS JOIN months)"""
GEARS = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}
TRIPS = """trips AS (SELECT o_custkey AS id, CAST(month(o_orderdate) AS VARCHAR) AS mes, """ + ", ".join(
    f"CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {g}"
    for g, p in GEARS.items()) + " FROM orders)"
SUM_GEARS = ", ".join(f"sum({g}) AS {g}" for g in GEARS)
FILL_GEARS = ", ".join(f"coalesce({g}, 0.0::DOUBLE) AS {g}" for g in GEARS)
ROW_SUM = " + ".join(f"coalesce({g}, 0)" for g in GEARS)
PRIORITIES = "priorities AS (SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS answer FROM orders)"
RECODED = f"""WITH {PRIORITIES} SELECT o_orderkey, CASE answer WHEN '1-URGENT' THEN 'Very Negative'
  WHEN '2-HIGH' THEN 'Negative' WHEN '5-LOW' THEN 'Very Positive' ELSE answer END AS answer FROM priorities"""
COORDS = """coords AS (SELECT vec_id, label, embedding[1]::DOUBLE AS lon, embedding[2]::DOUBLE AS lat FROM embeddings)"""
SUPPLIER_RATIO = """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(*) AS n_all,
  count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*)::DOUBLE * 100 AS percent FROM lineitem GROUP BY l_suppkey"""
MIRRORED = """mirrored AS (SELECT event_id, event_type,
  CASE WHEN event_type = 'error' THEN -abs(value) ELSE abs(value) END AS value FROM events)"""
PRIORITY_LEVELS = """levels(level, ordinal) AS (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3),
  ('4-NOT SPECIFIED', 4), ('5-LOW', 5), ('6-NEVER', 6))"""


def _species(where: str) -> str:
    listed = [f"Brand#{i}" for i in range(1, 24)] + ["Absent#1", "Absent#2", "Absent#3"]
    values = ", ".join(f"('{s}')" for s in listed)
    return f"""WITH {REPORTS}, species(sp_cien) AS (VALUES {values}),
      ways(abundancia, flag, sign) AS (VALUES ('Decrease', 'A', -1), ('Increase', 'R', 1)),
      counted AS (SELECT zona, sp_cien, abundancia AS flag, count(*) AS n FROM zoned
        WHERE sp_cien <> 'NA' AND abundancia <> 'NA' GROUP BY ALL)
      SELECT d.zona, s.sp_cien, w.abundancia,
        CASE WHEN w.sign < 0 THEN -(coalesce(c.n, 0)::DOUBLE / nullif(d.respondents, 0)::DOUBLE * 100)
          ELSE coalesce(c.n, 0)::DOUBLE / nullif(d.respondents, 0)::DOUBLE * 100 END AS percent
      FROM denominators d CROSS JOIN species s CROSS JOIN ways w
      LEFT JOIN counted c ON c.zona = d.zona AND c.sp_cien = s.sp_cien AND c.flag = w.flag {where}"""


def _rotation(zone: str) -> str:
    names = {**{g: g for g in GEARS}, "urgent": "Urgent", "unspecified": "Not Specified", "none": "No Fishing"}
    methods = " UNION ALL ".join(
        f"SELECT zona, mes, '{names[g]}' AS fishing_method, sum({g}) AS total_value FROM flagged GROUP BY zona, mes"
        for g in [*GEARS, "none"])
    return f"""WITH {CUSTOMERS}, {MONTHS}, {TRIPS},
      zoned AS (SELECT t.* EXCLUDE (mes), m.mes, c.zona AS trip_zone FROM trips t
        LEFT JOIN months m ON m.m = CAST(t.mes AS INTEGER) LEFT JOIN customers c ON c.id = t.id),
      grid AS (SELECT id, mes FROM (SELECT DISTINCT id FROM zoned) CROSS JOIN months),
      dense AS (SELECT g.id, g.mes, z.trip_zone, {', '.join(f'coalesce(z.{g}, 0) AS {g}' for g in GEARS)}
        FROM grid g LEFT JOIN zoned z ON z.id = g.id AND z.mes = g.mes),
      flagged AS (SELECT {zone} AS zona, d.*, CASE WHEN {ROW_SUM} = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS none
        FROM dense d LEFT JOIN customers c ON c.id = d.id),
      long AS ({methods})
      SELECT zona, mes, fishing_method, total_value::DOUBLE AS total_value,
        (sum(total_value) OVER (PARTITION BY zona, mes))::DOUBLE AS total,
        total_value::DOUBLE / nullif(sum(total_value) OVER (PARTITION BY zona, mes), 0)::DOUBLE * 100 AS percent
      FROM long"""


def _donut(outer: str, where: str = "") -> str:
    return f"""WITH {OPINIONS}, cells AS (SELECT zona, answer, sub_answer, count(*) AS n FROM zoned {where} GROUP BY ALL),
      sums AS (SELECT *, sum(n) OVER (PARTITION BY zona, answer) AS ring, sum(n) OVER (PARTITION BY zona) AS whole FROM cells)
      SELECT zona, answer, sub_answer, n, ring::DOUBLE / whole::DOUBLE * 100 AS pie_share,
        n::DOUBLE / ({outer})::DOUBLE * 100 AS donut_share FROM sums"""


STACK = f"""WITH {OPINIONS}, cells AS (SELECT zona, answer, sub_answer, count(*) AS n FROM zoned GROUP BY ALL)
  SELECT zona, answer, sub_answer, n, CAST(sum(n) OVER (PARTITION BY zona, answer) AS BIGINT) AS total,
    n::DOUBLE / (sum(n) OVER (PARTITION BY zona, answer))::DOUBLE * 1.0::DOUBLE AS share FROM cells"""

ORACLES: dict[str, str] = {
    "src_load_all": " UNION ALL ".join(
        f"SELECT '{t}' AS name, {c}::INTEGER AS n_columns, count(*) AS n_rows FROM {t}" for t, c in TABLES.items()),
    "src_load_table": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "src_sound_and_rejected": """WITH o AS (SELECT *, o_orderkey % 41 AS kind,
          CASE WHEN o_orderkey % 41 = 5 THEN '' WHEN o_orderkey % 41 = 6 THEN '"a, b"' ELSE o_orderpriority END AS p FROM orders)
        SELECT CASE WHEN kind NOT IN (1, 2, 3, 4) THEN o_orderkey END AS o_orderkey,
          CASE WHEN kind NOT IN (1, 2, 3, 4) THEN o_totalprice END AS o_totalprice,
          CASE WHEN kind = 6 THEN 'a, b' WHEN kind NOT IN (1, 2, 3, 4, 5) THEN o_orderpriority END AS o_orderpriority,
          CASE kind WHEN 1 THEN 'o_totalprice: no double' WHEN 2 THEN 'too many fields' WHEN 3 THEN 'too few fields'
            WHEN 4 THEN 'o_orderkey: no bigint' END AS reason,
          CASE kind WHEN 1 THEN o_orderkey || ',unknown,' || p WHEN 2 THEN o_orderkey || ',' || price || ',' || p || ',more'
            WHEN 3 THEN o_orderkey || ',' || price WHEN 4 THEN 'k' || o_orderkey || ',' || price || ',' || p END AS line
        FROM (SELECT *, CAST(o_totalprice AS VARCHAR) AS price FROM o)""",
    "src_inline_table": f"""WITH {PRIORITY_LEVELS}
        SELECT level AS o_orderpriority, ordinal::INTEGER AS ordinal, 0::INTEGER AS "Decrease",
          count(o_orderkey) AS n FROM levels LEFT JOIN orders ON o_orderpriority = level GROUP BY ALL""",
    "sink_csv": """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN 'NA'
          WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END AS segment,
        'He said "' || c_name || '", twice' AS remark, c_acctbal FROM customer""",
    "sink_csv_indexed": """SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS "row", o_orderkey,
        o_totalprice, o_orderpriority FROM orders""",
    "sink_partitioned": f"WITH {CUSTOMERS} SELECT id, port, zona FROM customers",
    "sink_replace_partitions": f"""WITH {CUSTOMERS} SELECT id, CASE WHEN zona IN ('North', 'otro') THEN 'again' ELSE port END AS port,
        zona FROM customers WHERE zona NOT IN ('North', 'otro') OR id % 2 = 0""",
    "preview_head": """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
        ORDER BY o_totalprice, o_orderkey LIMIT 6""",
    "level_domain_report": f"WITH {ANSWERS}, raw AS (" + " UNION ALL ".join(
        f"SELECT '{i}' AS item, {i} AS answer FROM answers" for i in ITEMS) + """)
        SELECT item, answer, count(*) AS n FROM raw
        WHERE answer IS NULL OR answer NOT IN ('much less', 'less', 'same', 'more', 'much more') GROUP BY ALL""",
    "bbox_tag_filter": """SELECT event_id, value AS x, user_id::DOUBLE AS y FROM events
        WHERE value BETWEEN 5 AND 250 AND user_id BETWEEN 10 AND 120 AND json_extract_string(props, '$.k') = '69'""",
    "project_names": "SELECT c_custkey, c_mktsegment FROM customer",
    "project_range": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
    "project_drop": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "project_positions": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "drop_by_position": "SELECT p_partkey, p_brand, p_retailprice FROM part",
    "rename_one": "SELECT c_custkey, c_mktsegment AS sector FROM customer",
    "rename_all": """SELECT s_suppkey AS id, s_name AS "Full Name", s_nationkey AS "Home Port", s_acctbal AS "Balance"
        FROM supplier""",
    "duplicate_headers": "SELECT s_suppkey, s_acctbal AS s_acctbal_2, s_nationkey AS s_acctbal_3 FROM supplier",
    "relocate_front": "SELECT c_mktsegment, c_nationkey, c_custkey, c_name, c_acctbal FROM customer",
    "ratio_percent": SUPPLIER_RATIO,
    "band_numeric": """WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE AS n,
          count(*) FILTER (WHERE value < 50) AS small, count(*) FILTER (WHERE value > 150) AS large
          FROM events GROUP BY user_id),
        p AS (SELECT user_id, n / nullif(small, 0)::DOUBLE * 100 AS a, n / nullif(large, 0)::DOUBLE * 100 AS b FROM n)
        SELECT user_id, CASE WHEN a < 20 THEN 'red' WHEN a <= 30 THEN 'yellow' WHEN a > 30 THEN 'green' END AS band,
          CASE WHEN b < 100 THEN 'under' WHEN b <= 200 THEN 'same' WHEN b > 200 THEN 'over' END AS large_band FROM p""",
    "rollup_zone": f"WITH {CUSTOMERS} SELECT id, port, zona FROM customers",
    "rollup_zone_lookup": f"WITH {CUSTOMERS} SELECT id, port, zona FROM customers",
    "zone_filter_pushdown": f"WITH {CUSTOMERS} SELECT id, port, zona FROM customers WHERE zona IN ('North', 'otro')",
    "recode_passthrough": RECODED,
    "recode_lookup": RECODED,
    "ordered_levels": f"""WITH {PRIORITIES} SELECT o_orderkey,
        CASE WHEN answer IN ('5-LOW', '4-NOT SPECIFIED', '2-HIGH') THEN answer END AS level,
        CASE answer WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 0 END::INT AS ordinal,
        coalesce(answer NOT IN ('5-LOW', '4-NOT SPECIFIED', '2-HIGH'), TRUE) AS unlisted FROM priorities""",
    "ordered_relabel": """SELECT l_orderkey, l_linenumber,
        CASE l_returnflag WHEN 'A' THEN 'Decrease' WHEN 'R' THEN 'Increase' END AS level,
        CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END::INT AS ordinal,
        coalesce(l_returnflag NOT IN ('A', 'R'), TRUE) AS unlisted FROM lineitem""",
    "apply_columns": f"WITH {ANSWERS} SELECT id, l_orderkey, l_linenumber, "
        + ", ".join(f"{_lev(i)} AS {i}" for i in ITEMS) + " FROM answers",
    "filter_eq": "SELECT event_id, user_id FROM events WHERE event_type = 'error'",
    "filter_not_na_text": f"""WITH {OPINIONS} SELECT * FROM opinions
        WHERE answer IS NOT NULL AND answer <> 'NA' AND sub_answer IS NOT NULL AND sub_answer <> 'NA'""",
    "filter_in": "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#3', 'Brand#17')",
    "semi_join_list": """SELECT o_orderkey, o_custkey FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "dropna_any": f"WITH {ANSWERS} SELECT * FROM answers WHERE " + " AND ".join(f"{i} IS NOT NULL" for i in ITEMS),
    "fill_null": f"WITH {TRIPS}, s AS (SELECT id, mes, {SUM_GEARS} FROM trips GROUP BY id, mes) SELECT id, mes, {FILL_GEARS} FROM s",
    "row_sum_flag": f"""WITH {TRIPS}, s AS (SELECT id, mes, {SUM_GEARS} FROM trips GROUP BY id, mes)
        SELECT id, mes, {FILL_GEARS}, CASE WHEN {ROW_SUM} = 0 THEN 1 ELSE 0 END AS no_fishing FROM s""",
    "mirror_sign": f"WITH {MIRRORED} SELECT * FROM mirrored",
    "range_censor": f"WITH {MIRRORED} SELECT * FROM mirrored WHERE value >= -60 AND value <= 60",
    "range_censor_report": f"""WITH {MIRRORED} SELECT event_type, count(*) FILTER (WHERE abs(value) <= 60) AS kept,
        count(*) FILTER (WHERE abs(value) > 60) AS dropped FROM mirrored GROUP BY event_type""",
    "range_censor_losses": f"""WITH {MIRRORED}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE value < -60) AS below,
          count(*) FILTER (WHERE value > 60) AS above, count(*) FILTER (WHERE value IS NULL) AS missing FROM mirrored)
        SELECT 'censor' AS analysis, 'below' AS loss, total, below AS lost FROM c UNION ALL SELECT 'censor', 'above', total, above FROM c
        UNION ALL SELECT 'censor', 'missing', total, missing FROM c""",
    "make_point": f"WITH {COORDS} SELECT vec_id, lon AS x, lat AS y, 4326 AS srid FROM coords",
    "layer_union": """SELECT c_custkey AS id, c_acctbal AS balance, 'customers' AS layer FROM customer
        UNION ALL SELECT s_suppkey, s_acctbal, 'suppliers' FROM supplier""",
    "rescale_area": """WITH c AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey),
        r AS (SELECT min(n_orders)::DOUBLE AS lo, max(n_orders)::DOUBLE AS hi FROM c)
        SELECT o_custkey, n_orders, 3.0::DOUBLE + 7.0::DOUBLE * sqrt(CASE WHEN hi = lo THEN 0.5::DOUBLE
          ELSE (n_orders::DOUBLE - lo) / (hi - lo) END) AS size FROM c, r""",
    "left_join_one": """SELECT o_custkey, o_orderkey, c_mktsegment FROM orders
        LEFT JOIN customer ON o_custkey = c_custkey""",
    "left_join_nullsafe": """SELECT nullif(o_custkey, 5)::VARCHAR AS id, o_orderkey, c_mktsegment FROM orders
        LEFT JOIN customer ON nullif(o_custkey, 5) IS NOT DISTINCT FROM nullif(c_custkey, 5)""",
    "left_join_composite": """WITH l AS (SELECT user_id + 1 AS user_id, event_type, max(value) AS largest FROM events
          GROUP BY ALL)
        SELECT e.event_id, e.user_id, e.event_type, l.largest FROM events e
        LEFT JOIN l ON l.user_id = e.user_id AND l.event_type = e.event_type""",
    "merge_left_suffix": """WITH r AS (SELECT o_custkey AS id, max(o_totalprice) AS amount FROM orders
          GROUP BY o_custkey)
        SELECT c_custkey AS id, c_acctbal AS amount_x, r.amount AS amount_y
        FROM customer LEFT JOIN r ON r.id = c_custkey ORDER BY id""",
    "key_grid": f"WITH {MONTHLY} SELECT id, mes FROM grid",
    "densify": f"""WITH {MONTHLY} SELECT g.id, g.mes, m.n FROM grid g
        LEFT JOIN monthly m ON m.id = g.id AND m.mes = g.mes""",
    "densify_attributes": f"""WITH {CUSTOMERS}, {MONTHLY} SELECT g.id, g.mes, m.n, c.port FROM grid g
        LEFT JOIN monthly m ON m.id = g.id AND m.mes = g.mes LEFT JOIN customers c ON c.id = g.id""",
    "densify_lost_rows": f"WITH {MONTHLY} SELECT count(*) AS lost FROM monthly WHERE mes IS NULL OR mes = 'Diciembre'",
    "complete_cells": f"""WITH {OPINIONS}, {PRIORITY_LEVELS},
        cells AS (SELECT zona, sub_answer, count(*) AS n FROM zoned GROUP BY ALL),
        grid AS (SELECT zona, level FROM (SELECT DISTINCT zona FROM cells) CROSS JOIN levels)
        SELECT coalesce(g.zona, c.zona) AS zona, coalesce(g.level, c.sub_answer) AS sub_answer, coalesce(c.n, 0) AS count
        FROM grid g FULL JOIN cells c ON c.zona = g.zona AND c.sub_answer = g.level""",
    "complete_cells_long_domain": f"""WITH {REPORTS},
        cells AS (SELECT id, nullif(sp_cien, 'NA') AS sp_cien, count(*) AS n FROM reports GROUP BY ALL),
        grid AS (SELECT id, 'Brand#' || i AS sp_cien FROM (SELECT DISTINCT id FROM cells)
          CROSS JOIN (SELECT unnest(range(1, 131)) AS i))
        SELECT coalesce(g.id, c.id) AS id, coalesce(g.sp_cien, c.sp_cien) AS sp_cien, coalesce(c.n, 0) AS n
        FROM grid g FULL JOIN cells c ON c.id = g.id AND c.sp_cien = g.sp_cien""",
    "complete_observed": f"""WITH {REPORTS}, cells AS (SELECT id, concat_ws(' ', sp_cien, abundancia) AS report, count(*) AS n
          FROM reports GROUP BY ALL)
        SELECT i.id, l.report, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT id FROM cells) i
        CROSS JOIN (SELECT DISTINCT report FROM cells) l LEFT JOIN cells c ON c.id = i.id AND c.report = l.report""",
    "count_by_group": f"WITH {CUSTOMERS} SELECT zona, count(*) AS recuento FROM customers GROUP BY zona",
    "count_two_keys": f"WITH {OPINIONS} SELECT zona, sub_answer, count(*) AS count FROM zoned GROUP BY ALL",
    "count_named": f"""WITH {OPINIONS} SELECT answer, sub_answer, count(*) AS "Freq" FROM opinions GROUP BY ALL""",
    "reaggregate": f"WITH {OPINIONS} SELECT answer, count(*) AS n FROM opinions GROUP BY ALL",
    "sum_ignore_null": """SELECT l_returnflag, CAST(coalesce(sum(CASE WHEN l_returnflag <> 'A' THEN l_linenumber END), 0)
        AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag""",
    "share_in_group": f"""WITH {OPINIONS}, cells AS (SELECT zona, sub_answer, count(*) AS n FROM zoned GROUP BY ALL)
        SELECT zona, sub_answer, n AS count, n::DOUBLE / (sum(n) OVER (PARTITION BY zona))::DOUBLE * 100 AS percent FROM cells""",
    "respondents_per_zone": f"""WITH {OPINIONS} SELECT zona, count(DISTINCT id) AS respondents FROM zoned
        GROUP BY zona""",
    "share_external_denominator": f"""WITH {REPORTS}, c AS (SELECT zona, count(*) FILTER (WHERE abundancia = 'A') AS a,
          count(*) FILTER (WHERE abundancia = 'R') AS r FROM zoned GROUP BY zona)
        SELECT c.zona, a::DOUBLE / nullif(respondents, 0)::DOUBLE * 100 AS "A",
          r::DOUBLE / nullif(respondents, 0)::DOUBLE * 100 AS "R" FROM c LEFT JOIN denominators d ON d.zona = c.zona""",
    "pivot_wide": f"WITH {OPINIONS} SELECT zona, " + ", ".join(
        f"""count(*) FILTER (WHERE sub_answer = '{p}') AS "{p}" """
        for p in [*GEARS.values(), "6-NEVER"]) + " FROM zoned GROUP BY zona",
    "unpivot_long": f"""WITH {OPINIONS} SELECT o_orderkey, 'answer' AS item, answer AS value FROM opinions
        UNION ALL SELECT o_orderkey, 'sub_answer', sub_answer FROM opinions""",
    "likert_items": f"""WITH {LIKERT}, overall AS (SELECT item, level, ordinal, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL)
        SELECT item, level, CAST(ordinal AS INTEGER) AS ordinal, n,
          n::DOUBLE / nullif(sum(n) OVER (PARTITION BY item), 0)::DOUBLE * 100 AS percent FROM overall""",
    "likert_grouped": f"WITH {LIKERT} {CELL_SHARES}",
    "likert_theme_subset": f"WITH {LIKERT} {CELL_SHARES} WHERE item IN ('quantity', 'tax', 'price')",
    "likert_low_neutral_high": f"""WITH {LIKERT} SELECT zona, item,
        (sum(n) FILTER (WHERE ordinal < 3))::DOUBLE / nullif(sum(n), 0)::DOUBLE * 100 AS low,
        (sum(n) FILTER (WHERE ordinal = 3))::DOUBLE / nullif(sum(n), 0)::DOUBLE * 100 AS neutral,
        (sum(n) FILTER (WHERE ordinal > 3))::DOUBLE / nullif(sum(n), 0)::DOUBLE * 100 AS high
        FROM cells GROUP BY zona, item""",
    "likert_centered_offsets": f"""WITH {LIKERT}, w AS (SELECT *,
          sum(n) OVER (PARTITION BY zona, item ORDER BY ordinal) AS upto, sum(n) OVER (PARTITION BY zona, item) AS total,
          sum(CASE WHEN ordinal < 3 THEN n ELSE 0 END) OVER (PARTITION BY zona, item) AS low,
          sum(CASE WHEN ordinal = 3 THEN n ELSE 0 END) OVER (PARTITION BY zona, item) AS mid FROM cells)
        SELECT zona, item, level, CAST(ordinal AS INTEGER) AS ordinal,
          ((upto - n)::DOUBLE - (low::DOUBLE + mid::DOUBLE / 2)) / nullif(total, 0)::DOUBLE * 100 AS bar_start,
          (upto::DOUBLE - (low::DOUBLE + mid::DOUBLE / 2)) / nullif(total, 0)::DOUBLE * 100 AS bar_end FROM w""",
    "likert_mean_sd": f"""WITH {LEVEL_ANSWERS}, {LEVELS}, {LONG}
        SELECT zona, item, count(ordinal) AS n, round(avg(ordinal), 9) AS mean, round(stddev_samp(ordinal), 9) AS sd
        FROM long LEFT JOIN levels ON levels.level = long.level GROUP BY zona, item""",
    "ordinal_density": f"""WITH {LEVEL_ANSWERS}, {LEVELS}, {LONG},
        counted AS (SELECT zona, item, ordinal, count(*) AS n FROM long JOIN levels ON levels.level = long.level GROUP BY ALL),
        grid AS (SELECT i / 4.0::DOUBLE AS x FROM (SELECT unnest(range(0, 25)) AS i))
        SELECT zona, item, x::DOUBLE AS x, round(sum(n * exp(-0.5 * ((x - ordinal) / 0.5) ** 2))
          / (sum(n) * 0.5 * sqrt(2 * pi())), 9) AS density FROM counted CROSS JOIN grid GROUP BY ALL""",
    "ordinal_density_auto": f"""WITH {LEVEL_ANSWERS}, {LEVELS}, {LONG},
        given AS (SELECT zona, item, ordinal FROM long JOIN levels ON levels.level = long.level),
        measured AS (SELECT zona, item, count(*) AS n, avg(ordinal) AS mean, stddev_samp(ordinal) AS sd,
          (quantile_cont(ordinal, 0.75) - quantile_cont(ordinal, 0.25)) / 1.34 AS spread FROM given GROUP BY ALL),
        ruled AS (SELECT zona, item, CASE WHEN n > 1 THEN 0.9 * n::DOUBLE ** -0.2::DOUBLE * CASE WHEN least(sd, spread) > 0
          THEN least(sd, spread) WHEN sd > 0 THEN sd ELSE mean END END AS h FROM measured),
        counted AS (SELECT zona, item, ordinal, count(*) AS n FROM given GROUP BY ALL),
        grid AS (SELECT i / 4.0::DOUBLE AS x FROM (SELECT unnest(range(0, 25)) AS i))
        SELECT zona, item, round(any_value(h), 9) AS bandwidth, x::DOUBLE AS x, round(sum(n * exp(-0.5 * ((x - ordinal) / h) ** 2))
          / (sum(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
        FROM counted JOIN ruled USING (zona, item) CROSS JOIN grid GROUP BY zona, item, x""",
    "pie_donut_by_group": _donut("ring"),
    "pie_donut_of_total": _donut("whole"),
    "pie_donut_ungrouped": f"""WITH {OPINIONS}, cells AS (SELECT answer, sub_answer, count(*) AS n FROM opinions GROUP BY ALL)
        SELECT answer, sub_answer, n,
          (sum(n) OVER (PARTITION BY answer))::DOUBLE / (sum(n) OVER ())::DOUBLE * 100 AS pie_share,
          n::DOUBLE / (sum(n) OVER ())::DOUBLE * 100 AS donut_share FROM cells""",
    "stack_fill_share": STACK,
    "distinct_values": f"WITH {CUSTOMERS} SELECT DISTINCT zona FROM customers",
    "quoted_values": f"""WITH {REPORTS}, s AS (SELECT DISTINCT sp_cien FROM reports WHERE sp_cien <> 'NA')
        SELECT '''' || sp_cien || '''' AS species_list FROM s""",
    "bbox_agg": f"WITH {COORDS} SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM coords",
    "bbox_agg_grouped": f"""WITH {COORDS} SELECT label, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax,
        max(lat) AS ymax FROM coords GROUP BY label""",
    "contradictory_by_zone": f"""WITH {REPORTS} SELECT * FROM (SELECT zona, sp_cien,
          count(*) FILTER (WHERE abundancia = 'A') AS n_down, count(*) FILTER (WHERE abundancia = 'R') AS n_up
          FROM zoned WHERE sp_cien <> 'NA' GROUP BY ALL) WHERE n_down > 0 AND n_up > 0""",
    "species_outside_list": f"""WITH {REPORTS} SELECT sp_cien, count(*) AS n FROM reports
        WHERE sp_cien <> 'NA' AND sp_cien NOT IN (SELECT 'Brand#' || unnest(range(1, 24))) GROUP BY sp_cien""",
    "likert_by_nation": f"""WITH {LEVEL_ANSWERS}, {LEVELS}, placed AS (
          SELECT l.*, s_nationkey AS n_nation FROM levelled l JOIN supplier ON s_suppkey = l.id),
        long AS ({" UNION ALL ".join(f"SELECT n_nation, '{i}' AS item, {i} AS level FROM placed" for i in ITEMS)}),
        cells AS (SELECT p.n_nation, p.item, v.level, v.ordinal, (SELECT count(*) FROM long x WHERE x.n_nation = p.n_nation
          AND x.item = p.item AND x.level = v.level) AS n
          FROM (SELECT DISTINCT n_nation, item FROM long) p CROSS JOIN levels v)
        SELECT n_nation, item, level, CAST(ordinal AS INTEGER) AS ordinal, CAST(n AS BIGINT) AS n,
          n::DOUBLE / nullif(sum(n) OVER (PARTITION BY n_nation, item), 0)::DOUBLE * 100 AS percent FROM cells""",
    "contradictory_items": f"""WITH {REPORTS} SELECT * FROM (SELECT id, sp_cien,
          count(*) FILTER (WHERE abundancia = 'A') AS n_down, count(*) FILTER (WHERE abundancia = 'R') AS n_up
          FROM reports GROUP BY id, sp_cien) WHERE n_down > 0 AND n_up > 0""",
    "sorted_distinct": "SELECT DISTINCT p_brand FROM part ORDER BY p_brand",
    "sorted_distinct_language": """SELECT word, row_number() OVER (ORDER BY word COLLATE es, word) AS "position"
        FROM (SELECT DISTINCT split_part(text, ' ', 1) AS word FROM documents)""",
    "reversed_levels": """SELECT p AS o_orderpriority, CAST(row_number() OVER (ORDER BY p DESC) AS INTEGER) AS "position"
        FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) ORDER BY p DESC""",
    "order_by_list": f"""WITH {LIKERT} SELECT zona, item,
        (sum(n) FILTER (WHERE ordinal < 3))::DOUBLE / nullif(sum(n), 0)::DOUBLE * 100 AS low,
        (sum(n) FILTER (WHERE ordinal = 3))::DOUBLE / nullif(sum(n), 0)::DOUBLE * 100 AS neutral,
        (sum(n) FILTER (WHERE ordinal > 3))::DOUBLE / nullif(sum(n), 0)::DOUBLE * 100 AS high,
        CASE item WHEN 'tax' THEN 1 WHEN 'price' THEN 2 WHEN 'quantity' THEN 3 WHEN 'discount' THEN 4 END AS "position"
        FROM cells GROUP BY zona, item ORDER BY "position" """,
    "percent_label": f"SELECT l_suppkey, printf('%.1f%%', percent) AS label FROM ({SUPPLIER_RATIO})",
    "percent_axis_label": f"SELECT zona, answer, sub_answer, printf('%.0f%%', share * 100) AS label FROM ({STACK})",
    "concat_title": f"WITH {CUSTOMERS} SELECT DISTINCT zona, 'Likert Chart for ' || zona AS title FROM customers",
    "qa_coverage_bands": """WITH v AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE AS n,
          count(*)::DOUBLE AS total FROM events GROUP BY user_id),
        s AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, n, total,
          n / total * 100 AS percent FROM embeddings LEFT JOIN v ON user_id = vec_id)
        SELECT *, CASE WHEN percent < 20 THEN 'red' WHEN percent <= 30 THEN 'yellow' WHEN percent > 30 THEN 'green' END AS band
        FROM s""",
    "qb_likert_by_zone": f"""WITH {LIKERT}, shares AS ({CELL_SHARES}), balance AS (
        SELECT zona, item, sum(n) FILTER (WHERE ordinal < 3) AS below, sum(n) FILTER (WHERE ordinal = 3) AS middle,
          sum(n) FILTER (WHERE ordinal > 3) AS above, nullif(sum(n), 0)::DOUBLE AS total FROM cells GROUP BY zona, item)
        SELECT s.*, below::DOUBLE / total * 100 AS low, middle::DOUBLE / total * 100 AS neutral,
          above::DOUBLE / total * 100 AS high
        FROM shares s JOIN balance b ON s.zona = b.zona AND s.item = b.item""",
    "qc_heatmap_cells": f"""WITH {LEVEL_ANSWERS}, {LEVELS},
        whole AS (SELECT * FROM levelled WHERE {' AND '.join(f'{i} IS NOT NULL' for i in ITEMS)}),
        long AS ({' UNION ALL '.join(f"SELECT zona, '{i}' AS item, {i} AS level FROM whole" for i in ITEMS)}),
        counted AS (SELECT zona, item, level, count(*) AS n FROM long GROUP BY ALL),
        cells AS (SELECT z.zona, z.item, l.level, l.ordinal, coalesce(n, 0) AS n
          FROM (SELECT DISTINCT zona, item FROM long) z CROSS JOIN levels l
          LEFT JOIN counted c ON c.zona = z.zona AND c.item = z.item AND c.level = l.level)
        SELECT zona, item, level, CAST(ordinal AS INTEGER) AS ordinal, CAST(n AS BIGINT) AS count,
          n::DOUBLE / (sum(n) OVER (PARTITION BY zona, item))::DOUBLE * 100 AS percent FROM cells""",
    "qd_species_change": _species(""),
    "qd_species_limits": f"""SELECT zona, count(*) FILTER (WHERE percent BETWEEN -60 AND 60) AS kept,
        count(*) FILTER (WHERE percent IS NULL OR percent NOT BETWEEN -60 AND 60) AS dropped
        FROM ({_species("")}) GROUP BY zona""",
    "qd_species_losses": f"""WITH bars AS (SELECT count(*) AS total, count(*) FILTER (WHERE percent < -60) AS below,
          count(*) FILTER (WHERE percent > 60) AS above, count(*) FILTER (WHERE percent IS NULL) AS missing FROM ({_species("")})),
        {REPORTS}, r AS (SELECT count(*) AS total,
          count(*) FILTER (WHERE sp_cien IS NULL OR sp_cien = 'NA' OR abundancia IS NULL OR abundancia = 'NA') AS unnamed,
          count(*) FILTER (WHERE sp_cien <> 'NA' AND abundancia <> 'NA'
            AND sp_cien NOT IN (SELECT 'Brand#' || unnest(range(1, 24)))) AS unlisted FROM reports)
        SELECT 'species' AS analysis, 'no species or direction' AS loss, total, unnamed AS lost FROM r
        UNION ALL SELECT 'species', 'species not listed', total, unlisted FROM r
        UNION ALL SELECT 'bars', 'below', total, below FROM bars UNION ALL SELECT 'bars', 'above', total, above FROM bars
        UNION ALL SELECT 'bars', 'missing', total, missing FROM bars""",
    "qe_gear_rotation_losses": """SELECT 'rotation' AS analysis, 'month not listed' AS loss, count(*) AS total,
        count(*) FILTER (WHERE month(o_orderdate) = 12) AS lost FROM orders""",
    "qd_species_shortlist": _species("WHERE s.sp_cien IN ('Brand#3', 'Brand#17', 'Absent#2')"),
    "qe_gear_rotation": _rotation("c.zona"),
    "qe_gear_rotation_parity": _rotation("d.trip_zone"),
    "qf_pie_donut": _donut("CASE WHEN zona IN ('South-West', 'East Islands') THEN whole ELSE ring END",
                           "WHERE answer <> 'NA'"),
}
ORACLES["order_by_level"] = ORACLES["likert_items"]
ORACLES["bbox_clustered"] = ORACLES["bbox_tag_filter"]
