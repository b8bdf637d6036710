"""The queries of ``catalog`` in DuckDB's SQL, from the same inputs, by plain joins and windows."""

from __future__ import annotations

from siltstone.plans.inputs import AS_OF, BRONZE, INGESTED_AT, LINES, NEW_CUSTOMERS, NEW_LINES, NEW_ORDERS, ORDERS

def _json(spec) -> str:
    """A bronze row as JSON text, NULL fields left out."""
    fields = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN concat('"{c}":"', {c}, '"') END""" for c in (*spec.headers, "batch_id", "load_timestamp", "_source_file"))
    return f"concat('{{', concat_ws(',', {fields}), '}}')"


def _versions(rows: str) -> str:
    """Versions of all rows of a table of clean ones."""
    return f"""SELECT * EXCLUDE (seq, changed, started), TRY_CAST(left(load_timestamp, 10) AS DATE) AS effective_start_date,
    coalesce(lead(TRY_CAST(left(load_timestamp, 10) AS DATE)) OVER v, DATE '9999-12-31') AS effective_end_date, lead(seq) OVER v IS NULL AS is_current
  FROM (SELECT *, row_number() OVER w AS seq,
    row_number() OVER w = 1 OR balance IS DISTINCT FROM lag(balance) OVER w OR segment IS DISTINCT FROM lag(segment) OVER w AS changed
  FROM (SELECT *, min(load_timestamp) OVER (PARTITION BY batch_id) AS started FROM ({rows})) WINDOW w AS (PARTITION BY customer_id ORDER BY started, load_timestamp, batch_id, _source_file))
  WHERE changed WINDOW v AS (PARTITION BY customer_id ORDER BY seq)"""


_CTES = f"""WITH cust_b AS ({BRONZE["customers"]}), ord_b AS ({BRONZE["orders"]}), lin_b AS ({BRONZE["lines"]}),
new_cust AS ({NEW_CUSTOMERS}), new_ord AS ({NEW_ORDERS}), new_lin AS ({NEW_LINES}),
cust_t AS (SELECT * REPLACE (TRY_CAST(balance AS DECIMAL(18,2)) AS balance, TRY_CAST(since AS DATE) AS since) FROM cust_b),
cust_ok AS (SELECT * FROM cust_t QUALIFY row_number() OVER (PARTITION BY customer_id, name, nation, segment, balance, since ORDER BY load_timestamp, batch_id, _source_file) = 1),
cust_w AS (SELECT *, row_number() OVER w AS seq,
    row_number() OVER w = 1 OR balance IS DISTINCT FROM lag(balance) OVER w OR segment IS DISTINCT FROM lag(segment) OVER w AS changed
  FROM (SELECT *, min(load_timestamp) OVER (PARTITION BY batch_id) AS started FROM cust_ok) WINDOW w AS (PARTITION BY customer_id ORDER BY started, load_timestamp, batch_id, _source_file)),
cust AS (SELECT * EXCLUDE (seq, changed, started), TRY_CAST(left(load_timestamp, 10) AS DATE) AS effective_start_date,
    coalesce(lead(TRY_CAST(left(load_timestamp, 10) AS DATE)) OVER v, DATE '9999-12-31') AS effective_end_date, lead(seq) OVER v IS NULL AS is_current
  FROM cust_w WHERE changed WINDOW v AS (PARTITION BY customer_id ORDER BY seq)),
cust_p AS (SELECT DISTINCT customer_id FROM cust WHERE CAST(customer_id AS BIGINT) % 7 <> 0),
ord_1 AS (SELECT *, {_json(ORDERS)} AS j, CASE WHEN trim(order_date) <> '' AND TRY_CAST(order_date AS DATE) IS NULL THEN 'invalid_date_format' END AS r1 FROM ord_b),
ord_2 AS (SELECT o.* REPLACE (TRY_CAST(order_date AS DATE) AS order_date, TRY_CAST(ship_by AS DATE) AS ship_by, TRY_CAST(total AS DECIMAL(18,2)) AS total),
    coalesce(r1, CASE WHEN p.customer_id IS NULL THEN 'orphan_foreign_key' END) AS r2,
    CASE WHEN r1 IS NOT NULL THEN concat('order_date=', order_date) WHEN p.customer_id IS NULL THEN concat('foreign key ''customer_id''=''', coalesce(o.customer_id, 'NULL'), ''' not found in customers.customer_id') END AS d2
  FROM ord_1 o LEFT JOIN cust_p p ON p.customer_id = o.customer_id),
ord_3 AS (SELECT *, row_number() OVER (PARTITION BY r2 IS NULL, order_id, customer_id, order_date, ship_by, status, total ORDER BY load_timestamp, batch_id, _source_file) AS rn FROM ord_2),
ord_r AS (SELECT 'orders' AS source_table, coalesce(r2, 'duplicate_primary_key') AS reject_reason, coalesce(d2, concat('duplicate order_id=''', order_id, ''' within incoming batch')) AS reject_detail, j AS original_row_data, '{INGESTED_AT}' AS rejected_at FROM ord_3 WHERE r2 IS NOT NULL OR rn > 1),
ord_ok AS (SELECT * EXCLUDE (r1, r2, d2, rn, j) FROM ord_3 WHERE r2 IS NULL AND rn = 1),
ord AS (SELECT * FROM ord_ok QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY load_timestamp DESC, batch_id DESC) = 1),
lin_1 AS (SELECT *, {_json(LINES)} AS j, CASE WHEN trim(ship_date) <> '' AND TRY_CAST(ship_date AS DATE) IS NULL THEN 'invalid_date_format' END AS r1 FROM lin_b),
lin_2 AS (SELECT l.* REPLACE (TRY_CAST(ship_date AS DATE) AS ship_date, TRY_CAST(quantity AS DECIMAL(18,2)) AS quantity, TRY_CAST(price AS DECIMAL(18,2)) AS price),
    coalesce(r1, CASE WHEN o.order_id IS NULL THEN 'orphan_foreign_key' END) AS r2,
    CASE WHEN r1 IS NOT NULL THEN concat('ship_date=', ship_date) WHEN o.order_id IS NULL THEN concat('foreign key ''order_id''=''', l.order_id, ''' not found in orders.order_id') END AS d2
  FROM lin_1 l LEFT JOIN ord o ON o.order_id = l.order_id),
lin_3 AS (SELECT *, row_number() OVER (PARTITION BY r2 IS NULL, order_id, line_number, ship_date, quantity, price, return_flag ORDER BY load_timestamp, batch_id, _source_file) AS rn FROM lin_2),
lin_r AS (SELECT 'lines' AS source_table, coalesce(r2, 'duplicate_primary_key') AS reject_reason, coalesce(d2, concat('duplicate order_id, line_number=''', order_id, ', ', line_number, ''' within incoming batch')) AS reject_detail, j AS original_row_data, '{INGESTED_AT}' AS rejected_at FROM lin_3 WHERE r2 IS NOT NULL OR rn > 1),
lin AS (SELECT * EXCLUDE (r1, r2, d2, rn, j) FROM lin_3 WHERE r2 IS NULL AND rn = 1),
lin_c AS (SELECT * EXCLUDE (r1) REPLACE (TRY_CAST(ship_date AS DATE) AS ship_date, TRY_CAST(quantity AS DECIMAL(18,2)) AS quantity, TRY_CAST(price AS DECIMAL(18,2)) AS price),
    row_number() OVER (PARTITION BY order_id, line_number, TRY_CAST(ship_date AS DATE), quantity, price, return_flag ORDER BY load_timestamp, batch_id, _source_file) AS rn FROM lin_1 WHERE r1 IS NULL),
lin_cr AS (SELECT 'lines' AS source_table, 'invalid_date_format' AS reject_reason, concat('ship_date=', ship_date) AS reject_detail, j AS original_row_data, '{INGESTED_AT}' AS rejected_at FROM lin_1 WHERE r1 IS NOT NULL),
new_lin_1 AS (SELECT *, {_json(LINES)} AS j, TRY_CAST(ship_date AS DATE) IS NULL AS bad FROM new_lin)
"""
_MONTHS = "SELECT strftime(ship_date, '%Y-%m') AS ship_month, count(line_number) AS count_line_number, sum(price) AS sum_price FROM lin GROUP BY 1"
_BY_ORDER = """SELECT o.o_orderkey, max(o_orderstatus) AS o_orderstatus, max(o_orderpriority) AS o_orderpriority, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS sum_price, count(l_linenumber) AS count_l_linenumber
  FROM orders o LEFT JOIN lineitem ON l_orderkey = o.o_orderkey GROUP BY o.o_orderkey"""


def _suite(rows: list[tuple[str, str, str, str]], table: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT 'expect_{k}' AS expectation_type, '{c}' AS column_name, {u} AS unexpected_count, {n} AS element_count FROM {table} WHERE {where}" for k, c, u, n in rows)


def _nulls(c: str) -> tuple[str, str, str, str]:
    return "column_values_to_not_be_null", c, f"count(*) FILTER ({c} IS NULL)", "count(*)"


def _if(kind: str, c: str, broken: str, there: str | None = None) -> tuple[str, str, str, str]:
    return kind, c, f"count(*) FILTER ({broken})", f"count({there or c})"


def _unique(c: str, table: str, where: str = "true") -> str:
    return f"SELECT 'expect_column_values_to_be_unique' AS expectation_type, '{c}' AS column_name, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS unexpected_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS element_count FROM (SELECT count(*) AS n FROM {table} WHERE {where} AND {c} IS NOT NULL GROUP BY {c})"


def _columns(n: int) -> str:
    return f"SELECT 'expect_table_columns_to_match_set' AS expectation_type, '' AS column_name, CAST(0 AS BIGINT) AS unexpected_count, CAST({n} AS BIGINT) AS element_count"


_ORDER_SUITE = " UNION ALL ".join([
    _columns(10), _unique("order_id", "ord"),
    _suite([
        *[_nulls(c) for c in ("order_id", "customer_id", "order_date", "total")], _if("column_values_to_be_between", "total", "total < 1000"), _if("column_values_to_be_in_set", "status", "status NOT IN ('F','O','P')"),
        ("column_pair_values_a_to_be_greater_than_b", "ship_by", "count(*) FILTER (NOT ship_by > order_date)", "count(*) FILTER (ship_by IS NOT NULL AND order_date IS NOT NULL)"),
    ], "ord"),
])
_CUSTOMER_SUITE = " UNION ALL ".join([
    _columns(13), _unique("customer_id", "cust", "is_current"),
    _suite([
        *[_nulls(c) for c in ("customer_id", "name", "since")], _if("column_values_to_be_between", "balance", "balance < 0"),
        _if("column_values_to_be_in_set", "segment", "segment NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')"), _if("column_values_to_be_between", "since", f"since > DATE '{AS_OF}'"),
    ], "cust", "is_current"),
])


def _rule(table: str, source: str, rule: str, broken: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) FILTER ({broken}) AS n_violations, count(*) AS total_row_count FROM {source}"


def _status(table: str, source: str, name: str, ok: str) -> str:
    return f"SELECT '{table}' AS table_name, '{name}' AS \"constraint\", CASE WHEN {ok} THEN 'Success' ELSE 'Failure' END AS status FROM {source}"


_RULES = " UNION ALL ".join([
    _rule("customers", "cust", "balance.min", "balance < 0"), _rule("customers", "cust", "segment.enum", "segment NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')"), _rule("customers", "cust", "since.max_date", f"since > DATE '{AS_OF}'"),
    _rule("orders", "ord", "total.min", "total < 1000"), _rule("orders", "ord", "total.max", "total > 400000"), _rule("orders", "ord", "ship_by.after", "ship_by < order_date"), _rule("orders", "ord", "status.enum", "status NOT IN ('F','O','P')"),
    _rule("lines", "lin", "price.min", "price < 0"), _rule("lines", "lin", "quantity.max", "quantity > 45"), _rule("lines", "lin", "return_flag.enum", "return_flag NOT IN ('A','N')"),
])
_now = "(SELECT * FROM cust WHERE is_current)"
_VERIFY = " UNION ALL ".join([
    *[_status("customers", _now, f"Completeness({c})", f"count({c}) = count(*)") for c in ("customer_id", "name", "since")], _status("customers", _now, "NonNegative(balance)", "count(*) FILTER (coalesce(balance, 0) < 0) = 0"),
    _status("customers", _now, "Uniqueness(customer_id)", "count(DISTINCT customer_id) = count(customer_id)"), _status("customers", _now, "Size", "count(*) > 0"),
    *[_status("orders", "ord", f"Completeness({c})", f"count({c}) = count(*)") for c in ("order_id", "customer_id", "order_date", "total")], _status("orders", "ord", "Compliance(total >= 1000)", "count(*) FILTER (total >= 1000) = count(*)"),
    _status("orders", "ord", "Uniqueness(order_id)", "count(DISTINCT order_id) = count(order_id)"), _status("orders", "ord", "Size", "count(*) > 0"),
    *[_status("lines", "lin", f"Completeness({c})", f"count({c}) = count(*)") for c in ("order_id", "ship_date", "return_flag")], _status("lines", "lin", "NonNegative(price)", "count(*) FILTER (coalesce(price, 0) < 0) = 0"),
    _status("lines", "lin", "Uniqueness(order_id, line_number)", "count(DISTINCT (order_id, line_number)) = count(*)"), _status("lines", "lin", "Size", "count(*) > 0"),
])


def _kept(name: str, b: str, s: str, r: str, op: str) -> str:
    return f"SELECT '{name}' AS table_name, *, n_bronze {op} n_silver + n_rejects AS conserved FROM (SELECT (SELECT count(*) FROM {b}) AS n_bronze, (SELECT count(*) FROM {s}) AS n_silver, (SELECT {r}) AS n_rejects)"


_COLUMNS = {  # columns and whether they are texts or numbers
    "nation": {"n_nationkey": "number", "n_name": "text", "n_regionkey": "number"},
    "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"},
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "text"},
}
_PROFILES = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, {kind == 'text'} AS text, {kind == 'number'} AS number, count(*) AS n, count({c}) AS m, count(DISTINCT {c}) AS d, {f'count(*) FILTER ({c} < 0) > 0' if kind == 'number' else 'false'} AS negative, "
    f"{f'CAST(min({c}) AS DOUBLE)' if kind == 'number' else 'NULL::DOUBLE'} AS minimum, {f'CAST(max({c}) AS DOUBLE)' if kind == 'number' else 'NULL::DOUBLE'} AS maximum FROM {t}"
    for t, columns in _COLUMNS.items() for c, kind in columns.items()
)
_SUGGESTIONS = """SELECT t AS table_name, c AS column_name, 'is complete' AS suggestion FROM p WHERE n = m UNION ALL SELECT t, c, 'is unique' FROM p WHERE n = m AND n > 1 AND d >= 0.95 * n
      UNION ALL SELECT t, c, 'is non-negative' FROM p WHERE number AND NOT negative UNION ALL SELECT t, c, 'is categorical' FROM p WHERE text AND d <= 10 AND n > 10 * d"""


_BODIES = {
    "bronze_align_union": """SELECT order_id, line_number, ship_date, quantity, price, return_flag, batch_id, load_timestamp, 'a.csv' AS _source_file, NULL::VARCHAR AS note FROM lin_b WHERE CAST(order_id AS BIGINT) % 3 = 0
      UNION ALL SELECT order_id, line_number, ship_date, quantity, price, NULL, batch_id, load_timestamp, 'b.csv', return_flag FROM lin_b WHERE CAST(order_id AS BIGINT) % 3 <> 0""",
    "bronze_source_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, _source_file, batch_id, count(*) AS n_rows, min(load_timestamp) AS first_load FROM {t} GROUP BY _source_file, batch_id" for n, t in (("customers", "cust_b"), ("orders", "ord_b"), ("lines", "lin_b"))),
    "cast_date_quarantine": f"SELECT 'orders' AS source_table, r1 AS reject_reason, concat('order_date=', order_date) AS reject_detail, j AS original_row_data, '{INGESTED_AT}' AS rejected_at FROM ord_1 WHERE r1 IS NOT NULL",
    "cast_decimal": "SELECT order_id, batch_id, TRY_CAST(total AS DECIMAL(18,2)) AS total FROM ord_1 WHERE r1 IS NULL",
    "cast_number_quarantine": f"SELECT 'orders' AS source_table, coalesce(r1, 'invalid_number_format') AS reject_reason, CASE WHEN r1 IS NOT NULL THEN concat('order_date=', order_date) ELSE concat('total=', total) END AS reject_detail, j AS original_row_data, '{INGESTED_AT}' AS rejected_at FROM ord_1 WHERE r1 IS NOT NULL OR (trim(total) <> '' AND TRY_CAST(total AS DECIMAL(18,2)) IS NULL)",
    "fk_clean": "SELECT * EXCLUDE (r1, r2, d2, j) FROM ord_2 WHERE r2 IS NULL",
    "fk_rejects": f"SELECT 'orders' AS source_table, r2 AS reject_reason, d2 AS reject_detail, j AS original_row_data, '{INGESTED_AT}' AS rejected_at FROM ord_2 WHERE r2 IS NOT NULL",
    "dedup_pass": "SELECT * EXCLUDE (rn, j) FROM lin_c WHERE rn = 1",
    "dedup_rejects": f"SELECT * FROM lin_cr UNION ALL SELECT 'lines', 'duplicate_primary_key', concat('duplicate order_id, line_number=''', order_id, ', ', line_number, ''' within incoming batch'), j, '{INGESTED_AT}' FROM lin_c WHERE rn > 1",
    "existing_pk_rejects": f"""SELECT 'lines' AS source_table, CASE WHEN bad THEN 'invalid_date_format' ELSE 'duplicate_primary_key' END AS reject_reason,
        CASE WHEN bad THEN concat('ship_date=', ship_date) WHEN CAST(order_id AS BIGINT) % 2 = 0 THEN concat('order_id, line_number=''', order_id, ', ', line_number, ''' already present in Silver (scd_type=none has no update semantics)')
          ELSE concat('duplicate order_id, line_number=''', order_id, ', ', line_number, ''' within incoming batch') END AS reject_detail, j AS original_row_data, '{INGESTED_AT}' AS rejected_at
      FROM (SELECT *, row_number() OVER (PARTITION BY bad, order_id, line_number, ship_date, quantity, price, return_flag) AS rn FROM new_lin_1) WHERE bad OR CAST(order_id AS BIGINT) % 2 = 0 OR rn > 1""",
    "quarantine_all": "SELECT * FROM ord_r UNION ALL SELECT * FROM lin_r",
    "reject_counts": "SELECT source_table, reject_reason, count(*) AS n_rows FROM (SELECT * FROM ord_r UNION ALL SELECT * FROM lin_r) GROUP BY source_table, reject_reason",
    "scd2_history": "SELECT * FROM cust",
    "scd2_current": "SELECT * FROM cust WHERE is_current",
    "scd2_breakdown": "SELECT count(*) FILTER (seq = 1) AS new_inserts, count(*) FILTER (changed AND seq > 1) AS new_versions, count(*) FILTER (NOT changed) AS unchanged FROM cust_w",
    "scd2_add_batch": _versions("SELECT * FROM cust_ok UNION ALL SELECT * REPLACE (TRY_CAST(balance AS DECIMAL(18,2)) AS balance, TRY_CAST(since AS DATE) AS since) FROM new_cust"),
    "scd1_latest": "SELECT * FROM ord",
    "scd1_merge": """SELECT o.* REPLACE (CASE WHEN n.order_id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.order_id IS NULL THEN o.total ELSE n.total END AS total)
      FROM ord o LEFT JOIN (SELECT order_id, status, TRY_CAST(total AS DECIMAL(18,2)) AS total FROM new_ord WHERE trim(order_date) = '' OR TRY_CAST(order_date AS DATE) IS NOT NULL) n ON n.order_id = o.order_id WHERE CAST(o.order_id AS BIGINT) % 48 <> 0
      UNION ALL SELECT * REPLACE (TRY_CAST(order_date AS DATE) AS order_date, TRY_CAST(ship_by AS DATE) AS ship_by, TRY_CAST(total AS DECIMAL(18,2)) AS total) FROM new_ord
      WHERE (trim(order_date) = '' OR TRY_CAST(order_date AS DATE) IS NOT NULL) AND order_id NOT IN (SELECT order_id FROM ord WHERE CAST(order_id AS BIGINT) % 48 <> 0)""",
    "none_append": """, kept AS (SELECT * FROM lin WHERE CAST(order_id AS BIGINT) % 50 <> 0) SELECT * FROM kept
      UNION ALL SELECT * EXCLUDE (bad, j) REPLACE (TRY_CAST(ship_date AS DATE) AS ship_date, TRY_CAST(quantity AS DECIMAL(18,2)) AS quantity, TRY_CAST(price AS DECIMAL(18,2)) AS price) FROM
      (SELECT * FROM new_lin_1 WHERE NOT bad AND (order_id, line_number) NOT IN (SELECT (order_id, line_number) FROM kept) QUALIFY row_number() OVER (PARTITION BY order_id, line_number, ship_date, quantity, price, return_flag) = 1)""",
    "gold_customer_360": """, f AS (SELECT o.customer_id, count(DISTINCT o.order_id) AS order_count, count(l.line_number) AS line_count, sum(l.price) AS total_price FROM ord o LEFT JOIN lin l ON l.order_id = o.order_id GROUP BY o.customer_id)
      SELECT c.*, coalesce(order_count, 0) AS order_count, coalesce(line_count, 0) AS line_count, CAST(coalesce(total_price, 0) AS DECIMAL(38,2)) AS total_price FROM cust c LEFT JOIN f ON f.customer_id = c.customer_id WHERE is_current""",
    "gold_summary_by_order": _BY_ORDER,
    "gold_summary_by_type": "SELECT o.order_id, max(o.status) AS status, CAST(coalesce(sum(l.price), 0) AS DECIMAL(38,2)) AS sum_price, count(l.line_number) AS count_line_number FROM ord o LEFT JOIN lin l ON l.order_id = o.order_id GROUP BY o.order_id",
    "gold_monthly_trend": _MONTHS,
    "gold_totals": f"SELECT sum(sum_price) AS sum_price, CAST(sum(count_l_linenumber) AS BIGINT) AS count_l_linenumber FROM ({_BY_ORDER})",
    "gold_probe": f"SELECT count(*) AS n_rows, sum(sum_price) AS sum_price, CAST(sum(count_l_linenumber) AS BIGINT) AS n_lines FROM ({_BY_ORDER})",
    "check_schema": "SELECT * FROM (VALUES ('status', 'Missing expected column: status'), ('note', 'Unexpected column found: note'), ('order_date', 'Column order_date expected type DATE, found string')) v(column_name, problem)",
    "check_file_format": "SELECT * FROM (VALUES ('union', 'Unexpected column found in landing files: note'), ('file', 'Missing expected column in ''b.csv'': return_flag'), ('file', 'Unexpected column found in ''b.csv'': note')) v(mode, issue)",
    "check_completeness": "SELECT count(*) AS total_row_count, count(*) FILTER (customer_id IS NULL) AS customer_id, count(*) FILTER (name IS NULL) AS name, count(*) FILTER (since IS NULL) AS since FROM cust",
    "check_uniqueness": "SELECT count(*) AS duplicate_key_count, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM lin GROUP BY order_id, line_number HAVING count(*) > 1)",
    "check_uniqueness_keys": "SELECT order_id, line_number, count(*) AS n_rows FROM lin GROUP BY order_id, line_number HAVING count(*) > 1",
    "check_fk": """SELECT 'orders.customer' AS reference, count(*) AS n_orphans FROM orders WHERE o_orderkey % 211 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
      UNION ALL SELECT 'orders.customer_with_null', count(*) FROM orders WHERE o_orderkey % 211 <> 0 AND o_custkey NOT IN (SELECT CASE WHEN c_custkey % 100 = 1 THEN NULL ELSE c_custkey END FROM customer WHERE c_custkey % 7 <> 0)
      UNION ALL SELECT 'lines.orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0)""",
    "check_rules": _RULES,
    "check_dates": "SELECT count(*) AS n_before FROM lin l JOIN ord o ON o.order_id = l.order_id WHERE l.ship_date < o.order_date",
    "check_scd": """, d AS (SELECT customer_id, CASE WHEN CAST(customer_id AS BIGINT) % 23 = 0 AND is_current THEN DATE '2030-01-01' ELSE effective_end_date END AS e, is_current AND CAST(customer_id AS BIGINT) % 29 <> 0 AS c FROM cust)
      SELECT (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY customer_id HAVING count(*) FILTER (c) <> 1)) AS keys_without_exactly_one_current, count(*) FILTER (c AND e <> DATE '9999-12-31') AS current_rows_with_wrong_end_date, count(*) FILTER (NOT c AND e = DATE '9999-12-31') AS historical_rows_with_open_end_date FROM d""",
    "check_reconcile": f""", m AS ({_MONTHS}), t AS (SELECT sum(price) AS p, CAST(count(line_number) AS DECIMAL(38,2)) AS n FROM lin), q AS (SELECT sum(l.price) AS p, CAST(count(l.line_number) AS DECIMAL(38,2)) AS n FROM ord o JOIN lin l ON l.order_id = o.order_id), g AS (
      SELECT 'whole' AS state, 'monthly_trend' AS gold_table, sum(sum_price) AS p, CAST(sum(count_line_number) AS DECIMAL(38,2)) AS n FROM m UNION ALL SELECT 'partial', 'monthly_trend', sum(sum_price), CAST(sum(count_line_number) AS DECIMAL(38,2)) FROM m WHERE ship_month <> '1995-03' UNION ALL SELECT 'whole', 'summary_by_order', p, n FROM q)
      SELECT state, gold_table, 'price.sum' AS measure, g.p AS gold_total, t.p AS silver_total, abs(g.p - t.p) < 0.01 AS matches FROM g, t UNION ALL SELECT state, gold_table, 'line_number.count', g.n, t.n, abs(g.n - t.n) < 0.01 FROM g, t
      UNION ALL SELECT 'whole', 'customer_360', 'rows', CAST(count(*) AS DECIMAL(38,2)), CAST(count(*) AS DECIMAL(38,2)), true FROM cust WHERE is_current""",
    "check_transformation": """, c AS (SELECT order_id, TRY_CAST(total AS DECIMAL(18,2)) AS total, status, load_timestamp FROM ord_b), f AS (SELECT order_id, total, status, min(load_timestamp) AS seen FROM c GROUP BY order_id, total, status),
      b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seen DESC) = 1)
      SELECT count(*) FILTER (CASE WHEN CAST(o.order_id AS BIGINT) % 17 = 0 THEN o.total + 1 ELSE o.total END IS DISTINCT FROM b.total) AS total, count(*) FILTER (o.status IS DISTINCT FROM b.status) AS status FROM ord o JOIN b ON b.order_id = o.order_id""",
    "expectations_suite": f"SELECT *, unexpected_count = 0 AS success FROM ({_ORDER_SUITE})",
    "expectations_current": f"SELECT *, unexpected_count = 0 AS success FROM ({_CUSTOMER_SUITE})",
    "verification_suite": _VERIFY,
    "row_conservation": " UNION ALL ".join([_kept("customers", "cust_b", "cust", "(SELECT count(*) FROM cust_b) - (SELECT count(*) FROM cust_ok)", "="), _kept("orders", "ord_b", "ord", "(SELECT count(*) FROM ord_r)", ">="), _kept("lines", "lin_b", "lin", "(SELECT count(*) FROM lin_r)", "=")]),
    "constraint_suggestions": f", p AS ({_PROFILES}) {_SUGGESTIONS}",
    "constraint_suggestions_top": f", p AS ({_PROFILES}) SELECT * FROM ({_SUGGESTIONS}) QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY column_name, suggestion) <= 3",
    "column_profile": f", p AS ({_PROFILES}) SELECT t AS table_name, c AS column_name, n AS n_rows, n - m AS n_null, d AS n_distinct, number AND NOT negative AS non_negative, minimum, maximum FROM p",
    "validation_report": f"""SELECT table_name, validator_name, n = 0 AS passed, CAST(n AS INTEGER) AS n_issues FROM (
      SELECT t AS table_name, v AS validator_name, 0 AS n FROM (VALUES ('customers'), ('orders'), ('lines')) x(t), (VALUES ('schema_validator'), ('referential_integrity_validator'), ('scd_validator')) y(v)
      UNION ALL SELECT table_name, 'business_rule_validator', count(*) FILTER (n_violations > 0) FROM ({_RULES}) GROUP BY table_name
      UNION ALL SELECT table_name, 'completeness_validator', count(*) FILTER (status = 'Failure') FROM ({_VERIFY}) WHERE "constraint" LIKE 'Completeness%' AND table_name <> 'customers' GROUP BY table_name
      UNION ALL SELECT 'customers', 'completeness_validator', (count(*) > count(name))::INT + (count(*) > count(since))::INT FROM cust
      UNION ALL SELECT table_name, 'uniqueness_validator', count(*) FILTER (status = 'Failure') FROM ({_VERIFY}) WHERE "constraint" LIKE 'Uniqueness%' GROUP BY table_name)""",
}
ORACLES = {name: _CTES + body for name, body in _BODIES.items()}
