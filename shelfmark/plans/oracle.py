"""SQL for an independent engine: the retail entities as common table expressions, and helpers to state rules."""

from __future__ import annotations

from ..functions.fixed_values import FALSE_WORDS, REGION_STATES, TRUE_WORDS

#: Clean entities, sales lines and the commercial aggregates.
BASE = """
places AS (SELECT n_nationkey AS geography_key, r_name AS region, n_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey),
stores AS (SELECT s_suppkey AS store_key, s_name AS store_name, s_nationkey AS geography_key FROM supplier),
products AS (
  SELECT p_partkey AS product_key, p_name AS product_name, p_type AS category, p_type || '-' || p_brand AS subcategory_key, p_brand AS brand,
         CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.65 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS cost FROM part),
invoices AS (
  SELECT o_orderkey AS invoice_id, o_orderkey % (SELECT count(*) FROM supplier) AS store_key, o_custkey AS customer_key,
         CAST(o_orderdate AS DATE) AS invoice_date, o_orderpriority AS payment_method FROM orders),
lines AS (
  SELECT l_orderkey AS invoice_id, l_partkey AS product_key, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_discount AS DECIMAL(18,2)) AS discount FROM lineitem),
sales0 AS (
  SELECT l.*, i.store_key, i.customer_key, i.invoice_date, i.payment_method, p.product_name, p.category, p.subcategory_key, p.brand,
         CAST(strftime(i.invoice_date, '%Y%m%d') AS INTEGER) AS date_key,
         CAST(strftime(date_trunc('month', i.invoice_date), '%Y%m%d') AS INTEGER) AS month_date_key,
         CAST(l.quantity * p.unit_price - coalesce(l.discount, 0) AS DECIMAL(20,2)) AS line_revenue,
         CAST(l.quantity * coalesce(p.cost, 0) AS DECIMAL(20,2)) AS line_cost
  FROM lines l JOIN invoices i USING (invoice_id) JOIN products p USING (product_key)),
sales AS (
  SELECT s.*, CAST(line_revenue - line_cost AS DECIMAL(20,2)) AS line_margin, st.store_name, g.region, g.state
  FROM sales0 s JOIN stores st USING (store_key) JOIN places g USING (geography_key))
"""

SUMS = "CAST(sum(line_revenue) AS DECIMAL(20,2)) AS revenue, CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(line_margin) AS DECIMAL(20,2)) AS gross_margin"


def ratio(part: str, whole: str, kind: str = "DECIMAL(18,6)") -> str:
    """A rounded ratio that is null where the whole is zero; decimals are divided exactly as integers of millionths."""
    scale = int(kind.rstrip(")").split(",")[1])
    a, b = f"CAST(round(({part}) * 1000000) AS HUGEINT)", f"CAST(round(({whole}) * 1000000) AS HUGEINT)"
    ten = 10**scale
    # Half away from zero, in whole numbers.
    value = f"(CASE WHEN ({a} < 0) <> ({b} < 0) THEN -1 ELSE 1 END) * ((abs({a}) * {ten} * 2 + abs({b})) // (abs({b}) * 2))"
    return f"CASE WHEN ({whole}) <> 0 THEN CAST(CAST({value} AS DECIMAL(38,0)) / {ten} AS {kind}) END"


def not_blank(c: str) -> str:
    return f"coalesce(length(trim({c})) > 0, false)"


def parsed_date(c: str) -> str:
    formats = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%m/%d/%Y")
    shapes = (r"\d{4}-\d\d-\d\d", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}", r"\d\d/\d\d/\d{4}")
    tries = (f"CASE WHEN regexp_full_match(trim({c}), '{s}') THEN try_strptime(trim({c}), '{f}') END" for s, f in zip(shapes, formats, strict=True))
    return f"CAST(coalesce({', '.join(tries)}) AS DATE)"


def parsed_decimal(c: str) -> str:
    return f"TRY_CAST(trim({c}) AS DECIMAL(18,2))"


def parsed_long(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?\\d+') THEN TRY_CAST(trim({c}) AS BIGINT) END"


def parsed_boolean(c: str) -> str:
    words = lambda w: ", ".join(f"'{x}'" for x in w)
    return f"CASE WHEN lower(trim({c})) IN ({words(TRUE_WORDS)}) THEN true WHEN lower(trim({c})) IN ({words(FALSE_WORDS)}) THEN false END"


def region_of_state(c: str) -> str:
    cases = " ".join(f"WHEN upper(trim({c})) IN ({', '.join(repr(s) for s in states)}) THEN '{name}'" for name, states in REGION_STATES.items())
    return f"CASE {cases} END"


def codes(rules: list[tuple[str, str]]) -> str:
    """The list of codes whose conditions hold."""
    items = ", ".join(f"CASE WHEN {condition} THEN '{code}' END" for code, condition in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def missing(*columns: str) -> list[tuple[str, str]]:
    return [(f"MISSING_{c.upper()}", f"NOT {not_blank(c)}") for c in columns]


def _price(c: str) -> list[tuple[str, str]]:
    return [*missing(c), (f"INVALID_{c.upper()}", f"{not_blank(c)} AND {parsed_decimal(c)} IS NULL"), (f"NEGATIVE_{c.upper()}", f"{parsed_decimal(c)} < 0")]


RULES = {
    "customers": [*missing("customer_id", "first_name", "last_name", "street_address", "city", "state", "zip_code"), ("INVALID_JOIN_DATE", f"{not_blank('join_date')} AND {parsed_date('join_date')} IS NULL")],
    "products": [*missing("product_id", "sku", "product_name", "category", "subcategory", "brand"), *_price("unit_price"), *_price("cost")],
    "stores": [
        *missing("store_id", "store_name", "city", "state", "zip_code", "region", "manager_name", "opened_date"),
        ("INVALID_OPENED_DATE", f"{not_blank('opened_date')} AND {parsed_date('opened_date')} IS NULL"),
        ("INVALID_SQUARE_FOOTAGE", f"{not_blank('square_footage')} AND {parsed_long('square_footage')} IS NULL"),
        ("NEGATIVE_SQUARE_FOOTAGE", f"{parsed_long('square_footage')} < 0"),
    ],
    "invoices": [
        *missing("invoice_id", "store_id"),
        ("MISSING_CUSTOMER_ID", f"customer_id IS NOT NULL AND NOT {not_blank('customer_id')}"),
        *missing("invoice_date"),
        ("INVALID_INVOICE_DATE", f"{not_blank('invoice_date')} AND {parsed_date('invoice_date')} IS NULL"),
        *missing("payment_method"),
    ],
    "invoice_items": [
        *missing("invoice_id", "line_item"),
        ("INVALID_LINE_ITEM", f"{not_blank('line_item')} AND {parsed_long('line_item')} IS NULL"),
        *missing("product_id", "quantity"),
        ("INVALID_QUANTITY", f"{not_blank('quantity')} AND {parsed_long('quantity')} IS NULL"),
        ("NON_POSITIVE_QUANTITY", f"{parsed_long('quantity')} <= 0"),
        *_price("unit_price"),
        ("INVALID_DISCOUNT", f"{not_blank('discount')} AND {parsed_decimal('discount')} IS NULL"),
        ("NEGATIVE_DISCOUNT", f"{parsed_decimal('discount')} < 0"),
    ],
}

_SPOILED = "CASE p_partkey % 83 WHEN 0 THEN '$-10' WHEN 1 THEN 'abc' WHEN 2 THEN '-1' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END"

#: The faulty source tables.
BRONZE = f"""
n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
b_stores0 AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS store_id, CASE WHEN s_suppkey % 89 = 0 THEN '' ELSE s_name END AS store_name, n_name AS city, n_name AS state, CAST(s_nationkey AS VARCHAR) AS zip_code, r_name AS region,
         'Manager ' || s_suppkey AS manager_name, CASE WHEN s_suppkey % 79 = 5 THEN '2025-13-40' ELSE '2020-01-15' END AS opened_date,
         CASE s_suppkey % 83 WHEN 1 THEN 'abc' WHEN 2 THEN '-1' ELSE '1000' END AS square_footage, s_suppkey AS k FROM supplier JOIN n ON s_nationkey = n_nationkey),
b_stores AS (SELECT * FROM b_stores0 UNION ALL SELECT * FROM b_stores0 WHERE k % 97 = 0),
b_customers0 AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CASE WHEN c_custkey % 89 = 0 THEN '' ELSE c_name END AS first_name, 'Customer' AS last_name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone,
         c_custkey || ' Main Street' AS street_address, n_name AS city, n_name AS state, CAST(c_nationkey AS VARCHAR) AS zip_code, c_mktsegment AS loyalty_tier,
         CASE c_custkey % 83 WHEN 1 THEN '2025-13-40' WHEN 2 THEN '' ELSE '01/31/2024' END AS join_date, c_custkey AS k FROM customer JOIN n ON c_nationkey = n_nationkey),
b_customers AS (SELECT * FROM b_customers0 UNION ALL SELECT * FROM b_customers0 WHERE k % 97 = 0),
b_products0 AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'SKU-' || p_partkey AS sku, CASE WHEN p_partkey % 89 = 0 THEN '' ELSE p_name END AS product_name, p_type AS category, p_type || '-' || p_brand AS subcategory, p_brand AS brand,
         {_SPOILED} AS unit_price, CASE WHEN p_partkey % 89 <> 7 THEN CAST(CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.65 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS VARCHAR) END AS cost,
         CASE WHEN p_partkey % 3 = 0 THEN 'maybe' ELSE 'yes' END AS is_active, p_partkey AS k FROM part),
b_products AS (SELECT * FROM b_products0 UNION ALL SELECT * FROM b_products0 WHERE k % 97 = 0),
b_invoices0 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, CAST(o_orderkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS store_id,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN CAST(o_custkey + 1000000 AS VARCHAR) WHEN o_orderkey % 103 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
         CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 223 = 0 THEN '2025-13-40' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
         CASE WHEN o_orderkey % 197 = 0 THEN '' ELSE o_orderpriority END AS payment_method, o_orderkey AS k FROM orders),
b_invoices AS (SELECT * FROM b_invoices0 UNION ALL SELECT * FROM b_invoices0 WHERE k % 401 = 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount) AS rn FROM lineitem),
b_items AS (
  SELECT CASE WHEN l_orderkey % 499 = 9 AND rn = 1 THEN '9999999999' ELSE CAST(l_orderkey AS VARCHAR) END AS invoice_id,
         CASE WHEN l_orderkey % 61 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE CAST(rn AS VARCHAR) END AS line_item,
         CASE WHEN l_partkey % 401 = 0 THEN '-7' ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
         CASE WHEN l_orderkey % 50 = 3 AND rn = 1 THEN '0' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS unit_price,
         CASE WHEN l_orderkey % 307 = 4 THEN 'x' ELSE CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) END AS discount
  FROM numbered JOIN part ON l_partkey = p_partkey)
"""


def _dimension(entity: str, key: str) -> str:
    duplicate = f"CASE WHEN {not_blank(key)} AND count(*) OVER (PARTITION BY {key}) > 1 THEN ['DUPLICATE_{key.upper()}'] ELSE [] END"
    return f"e_{entity} AS (SELECT *, list_concat({codes(RULES[entity])}, {duplicate}) AS codes FROM b_{entity})"


#: The evaluated entities: ``codes`` final, ``direct`` those of a row's own faults.
EVALUATED = f"""{BRONZE},
{_dimension("stores", "store_id")},
{_dimension("customers", "customer_id")},
{_dimension("products", "product_id")},
ok_stores AS (SELECT trim(store_id) AS id FROM e_stores WHERE len(codes) = 0 GROUP BY 1 HAVING count(*) = 1),
ok_customers AS (SELECT trim(customer_id) AS id FROM e_customers WHERE len(codes) = 0 GROUP BY 1 HAVING count(*) = 1),
ok_products AS (SELECT trim(product_id) AS id FROM e_products WHERE len(codes) = 0 GROUP BY 1 HAVING count(*) = 1),
h1 AS (
  SELECT b.*, list_concat({codes(RULES["invoices"])}, {codes([("INVALID_STORE_REFERENCE", f"{not_blank('store_id')} AND s.id IS NULL"), ("INVALID_CUSTOMER_REFERENCE", f"{not_blank('customer_id')} AND c.id IS NULL")])},
         CASE WHEN {not_blank("invoice_id")} AND count(*) OVER (PARTITION BY invoice_id) > 1 THEN ['DUPLICATE_INVOICE_ID'] ELSE [] END) AS direct
  FROM b_invoices b LEFT JOIN ok_stores s ON store_id = s.id LEFT JOIN ok_customers c ON customer_id = c.id),
l1 AS (
  SELECT b.*, {parsed_long("line_item")} AS n_line FROM b_items b),
l2 AS (
  SELECT l1.*, list_concat({codes(RULES["invoice_items"])}, {codes([("INVALID_PRODUCT_REFERENCE", f"{not_blank('product_id')} AND p.id IS NULL")])},
         CASE WHEN {not_blank("invoice_id")} AND n_line IS NOT NULL AND count(*) OVER (PARTITION BY invoice_id, n_line) > 1 THEN ['DUPLICATE_INVOICE_LINE'] ELSE [] END,
         {codes([("INVALID_INVOICE_REFERENCE", f"{not_blank('invoice_id')} AND i.id IS NULL")])}) AS direct
  FROM l1 LEFT JOIN ok_products p ON product_id = p.id LEFT JOIN (SELECT DISTINCT invoice_id AS id FROM b_invoices) i ON invoice_id = i.id),
summary AS (SELECT invoice_id, count(*) AS item_count, count(*) FILTER (len(direct) > 0) AS invalid_item_count FROM l2 GROUP BY invoice_id),
e_invoices AS (
  SELECT h1.*, coalesce(item_count, 0) AS item_count, coalesce(invalid_item_count, 0) AS invalid_item_count,
         list_concat(direct, {codes([("NO_INVOICE_ITEMS", "coalesce(item_count, 0) = 0"), ("INVALID_INVOICE_ITEM", "coalesce(invalid_item_count, 0) > 0")])}) AS codes
  FROM h1 LEFT JOIN summary USING (invoice_id)),
e_items AS (
  SELECT l2.*, list_concat(direct, {codes([("INVOICE_QUARANTINED_BY_BAD_HEADER_OR_ITEM", "NOT coalesce(ok, false)")])}) AS codes
  FROM l2 LEFT JOIN (SELECT invoice_id, bool_and(len(codes) = 0) AS ok FROM e_invoices GROUP BY invoice_id) USING (invoice_id))
"""


def _row_id(entity: str, columns: list[str]) -> str:
    return f"md5(concat_ws('|', '{entity}', {', '.join(columns)}))"


def issues_sql(columns: dict[str, list[str]]) -> str:
    """``issues``: an issue for each row and code. ``columns``: the source columns of each entity."""
    parts = []
    for entity, own in columns.items():
        name = "e_items" if entity == "invoice_items" else f"e_{entity}"
        parts.append(f"SELECT '{entity}' AS source_table, {_row_id(entity, own)} AS source_row_id, unnest(codes) AS dq_error_code FROM {name}")
    severity = "CASE WHEN regexp_matches(dq_error_code, '^MISSING_.*_ID$|_REFERENCE$|^DUPLICATE_') THEN 'Critical' WHEN starts_with(dq_error_code, 'NEGATIVE_') THEN 'Medium' WHEN starts_with(dq_error_code, 'INVOICE_QUARANTINED') THEN 'Low' ELSE 'High' END"
    return f"{EVALUATED}, issues AS (SELECT *, {severity} AS severity FROM ({' UNION ALL '.join(parts)}))"


#: Two snapshots of the customers as versions.
SCD2 = """
first_seen AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY o_custkey),
versions AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS loyalty_tier, coalesce(d, DATE '1900-01-01') AS valid_from,
         CASE WHEN c_custkey % 10 = 0 THEN DATE '2000-07-01' ELSE DATE '9998-12-31' END AS valid_to, c_custkey % 10 <> 0 AS is_current
  FROM customer LEFT JOIN first_seen ON o_custkey = c_custkey
  UNION ALL
  SELECT c_custkey, 'CHANGED', DATE '2000-07-01', DATE '9998-12-31', true FROM customer WHERE c_custkey % 10 = 0)
"""
