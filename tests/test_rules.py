import pytest
from pyspark.sql import functions as F

from shelfmark.functions.expressions import parse_boolean, parse_date, parse_decimal, parse_long, ratio, region, region_of_state
from shelfmark.functions.fixed_values import REGION_STATES
from shelfmark.operators import rules, silver
from shelfmark.plans.schemas import SOURCE

GOOD = {
    "stores": dict(store_id="1", store_name="a", city="c", state="TX", zip_code="1", region="South", manager_name="m", opened_date="2024-01-02", square_footage="5"),
    "products": dict(product_id="1", sku="s", product_name="p", category="c", subcategory="d", brand="b", unit_price="1.50", cost="1", is_active="yes"),
    "customers": dict(customer_id="1", first_name="f", last_name="l", email=None, phone=None, street_address="s", city="c", state="TX", zip_code="1", loyalty_tier=None, join_date=None),
    "invoices": dict(invoice_id="1", store_id="1", customer_id="1", invoice_date="2024-01-02", payment_method="Cash"),
    "invoice_items": dict(invoice_id="1", line_item="1", product_id="1", quantity="2", unit_price="1.5", discount="0"),
}


def frame(spark, entity, *changes):
    rows = [tuple((GOOD[entity] | c)[k] for k in SOURCE[entity]) for c in changes]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in SOURCE[entity]))


def codes(df, key):
    return {r[0]: r[1] for r in df.select(key, rules.CODES).collect()}


CASES = [
    ("customers", {"first_name": " "}, ["MISSING_FIRST_NAME"]),
    ("customers", {"customer_id": None, "last_name": None, "street_address": "", "city": None, "state": None, "zip_code": "\t"}, ["MISSING_CUSTOMER_ID", "MISSING_LAST_NAME", "MISSING_STREET_ADDRESS", "MISSING_CITY", "MISSING_STATE"]),
    ("customers", {"join_date": "2025-13-40"}, ["INVALID_JOIN_DATE"]),
    ("customers", {"join_date": ""}, []),
    ("products", {"sku": None, "product_name": None, "category": None, "subcategory": None, "brand": None}, ["MISSING_SKU", "MISSING_PRODUCT_NAME", "MISSING_CATEGORY", "MISSING_SUBCATEGORY", "MISSING_BRAND"]),
    ("products", {"unit_price": None, "cost": "x"}, ["MISSING_UNIT_PRICE", "INVALID_COST"]),
    ("products", {"unit_price": "-1", "cost": "-0.01"}, ["NEGATIVE_UNIT_PRICE", "NEGATIVE_COST"]),
    ("products", {"unit_price": "$1", "cost": " "}, ["INVALID_UNIT_PRICE", "MISSING_COST"]),
    ("products", {"is_active": "perhaps"}, []),
    ("stores", {"store_name": None, "region": None, "manager_name": None, "opened_date": None}, ["MISSING_STORE_NAME", "MISSING_REGION", "MISSING_MANAGER_NAME", "MISSING_OPENED_DATE"]),
    ("stores", {"opened_date": "soon", "square_footage": "1.5"}, ["INVALID_OPENED_DATE", "INVALID_SQUARE_FOOTAGE"]),
    ("stores", {"square_footage": "-3"}, ["NEGATIVE_SQUARE_FOOTAGE"]),
    ("stores", {"square_footage": None}, []),
    ("invoices", {"customer_id": None}, []),
    ("invoices", {"customer_id": " "}, ["MISSING_CUSTOMER_ID"]),
    ("invoices", {"invoice_id": None, "store_id": "", "invoice_date": None, "payment_method": None}, ["MISSING_INVOICE_ID", "MISSING_STORE_ID", "MISSING_INVOICE_DATE", "MISSING_PAYMENT_METHOD"]),
    ("invoices", {"invoice_date": "2025-13-40"}, ["INVALID_INVOICE_DATE"]),
    ("invoice_items", {"line_item": "0", "discount": None}, []),
    ("invoice_items", {"line_item": "x", "quantity": "0"}, ["INVALID_LINE_ITEM", "NON_POSITIVE_QUANTITY"]),
    ("invoice_items", {"invoice_id": None, "line_item": None, "product_id": None, "quantity": None, "unit_price": None}, ["MISSING_INVOICE_ID", "MISSING_LINE_ITEM", "MISSING_PRODUCT_ID", "MISSING_QUANTITY", "MISSING_UNIT_PRICE"]),
    ("invoice_items", {"quantity": "1.5", "unit_price": "-2", "discount": "-1"}, ["INVALID_QUANTITY", "NEGATIVE_UNIT_PRICE", "NEGATIVE_DISCOUNT"]),
    ("invoice_items", {"unit_price": "x", "discount": "x"}, ["INVALID_UNIT_PRICE", "INVALID_DISCOUNT"]),
]


@pytest.mark.parametrize("entity,change,want", CASES)
def test_direct_rules(spark, entity, change, want):
    got = rules.checked(frame(spark, entity, change), entity).first()[rules.CODES]
    assert [c for c in got if c != "MISSING_ZIP_CODE"] == want


def test_duplicates_spoil_every_copy_but_blank_keys_do_not_meet(spark):
    out = silver.evaluate_dimension(frame(spark, "stores", {"store_id": "1"}, {"store_id": "1", "city": "x"}, {"store_id": "2"}, {"store_id": ""}, {"store_id": ""}), "stores")
    assert sorted((r.store_id, r[rules.CODES]) for r in out.collect()) == [("", ["MISSING_STORE_ID"]), ("", ["MISSING_STORE_ID"]), ("1", ["DUPLICATE_STORE_ID"]), ("1", ["DUPLICATE_STORE_ID"]), ("2", [])]


@pytest.fixture(scope="module")
def sales(spark):
    bronze = {
        "stores": frame(spark, "stores", {"store_id": "1"}, {"store_id": "2", "city": ""}, {"store_id": "3"}, {"store_id": "3"}),
        "products": frame(spark, "products", {"product_id": "1"}, {"product_id": "2", "cost": "x"}),
        "customers": frame(spark, "customers", {"customer_id": "1"}),
        "invoices": frame(
            spark, "invoices", *({"invoice_id": i} for i in ("ok", "badline", "empty", "dupline")), {"invoice_id": "anon", "customer_id": None}, {"invoice_id": "store2", "store_id": "2"}, {"invoice_id": "store3", "store_id": "3"}, {"invoice_id": "lost", "customer_id": "9"}, {"invoice_id": "twice"}, {"invoice_id": "twice"}
        ),
        "invoice_items": frame(
            spark,
            "invoice_items",
            *({"invoice_id": i} for i in ("ok", "anon", "store2", "store3", "lost", "twice", "nowhere")),
            {"invoice_id": "ok", "line_item": "2"},
            {"invoice_id": "badline"},
            {"invoice_id": "badline", "line_item": "2", "product_id": "2"},
            {"invoice_id": "dupline"},
            {"invoice_id": "dupline", "line_item": " 1 "},
        ),
    }
    return {k: v.cache() for k, v in silver.evaluate(bronze).items()}


def test_references_need_a_valid_and_unique_target_and_invoices_are_atomic(sales):
    assert codes(sales["invoices"], "invoice_id") == {
        "ok": [],
        "anon": [],
        "badline": ["INVALID_INVOICE_ITEM"],
        "empty": ["NO_INVOICE_ITEMS"],
        "dupline": ["INVALID_INVOICE_ITEM"],
        "store2": ["INVALID_STORE_REFERENCE"],
        "store3": ["INVALID_STORE_REFERENCE"],
        "lost": ["INVALID_CUSTOMER_REFERENCE"],
        "twice": ["DUPLICATE_INVOICE_ID"],
    }


def test_own_faults_stay_apart_from_cascaded_ones(sales):
    rows = {(r.invoice_id, r.line_item.strip()): (r._direct_codes, r[rules.CODES]) for r in sales["invoice_items"].where("line_item != ' 1 '").collect()}
    cascade = "INVOICE_QUARANTINED_BY_BAD_HEADER_OR_ITEM"
    assert rows["ok", "1"] == ([], [])
    assert rows["badline", "1"] == ([], [cascade])
    assert rows["badline", "2"] == (["INVALID_PRODUCT_REFERENCE"], ["INVALID_PRODUCT_REFERENCE", cascade])
    assert rows["store2", "1"] == ([], [cascade])
    assert rows["nowhere", "1"] == (["INVALID_INVOICE_REFERENCE"], ["INVALID_INVOICE_REFERENCE", cascade])
    assert rows["dupline", "1"] == (["DUPLICATE_INVOICE_LINE"], ["DUPLICATE_INVOICE_LINE", cascade])


def test_split_is_exclusive_and_exhaustive(sales):
    for name, df in sales.items():
        assert silver.clean(df, name).count() + silver.quarantined(df, name, "2024-01-01").count() == df.count()


def test_quarantine_keeps_source_texts_and_renders_codes(sales):
    row = silver.quarantined(sales["invoice_items"], "invoice_items", "2024-01-01").where("line_item_raw = '2'").first()
    assert row._dq_error_code == "INVALID_PRODUCT_REFERENCE;INVOICE_QUARANTINED_BY_BAD_HEADER_OR_ITEM"
    assert (row._dq_status, row.line_item, row.quantity_raw) == ("QUARANTINED", 2, "2")
    header = silver.quarantined(sales["invoices"], "invoices", "2024-01-01").where("invoice_id = 'badline'").first()
    assert (header._dq_error_code, header._dq_error_description) == ("INVALID_INVOICE_ITEM", "INVOICE_QUARANTINED_BY_BAD_ITEM")


def test_reports(sales):
    counts = [tuple(r) for r in silver.reason_counts(sales["invoices"]).collect()]
    assert counts == sorted(counts, key=lambda r: (-r[1], r[0])) and dict(counts)["DUPLICATE_INVOICE_ID"] == 2
    impact = silver.impact_summary(sales["invoices"], sales["invoice_items"]).first()
    assert (impact.total_invoices, impact.valid_invoices, impact.empty_invoices, impact.anonymous_invoices) == (10, 2, 1, 1)
    assert impact.overlap_ok and str(impact.valid_invoice_pct) == "20.0000"
    assert silver.dimension_summary(sales["stores"]).first().invalid_rows == 3


def test_parsers(spark):
    df = spark.createDataFrame([(x,) for x in ("01/31/2024", "2024-01-02T06:07:00.123456", "2025-13-40", "2024-1-2", "", None)], "x string")
    assert [str(r[0]) for r in df.select(parse_date("x")).collect()] == ["2024-01-31", "2024-01-02", "None", "None", "None", "None"]
    df = spark.createDataFrame([(x,) for x in (" Y ", "T", "0", "NO", "2", "", None)], "x string")
    assert [r[0] for r in df.select(parse_boolean("x")).collect()] == [True, True, False, False, None, None, None]
    df = spark.createDataFrame([(x,) for x in (" 12.345 ", "1e3", "12", "x", None)], "x string")
    assert [(str(r[0]), r[1]) for r in df.select(parse_decimal("x"), parse_long("x")).collect()] == [("12.35", None), ("1000.00", None), ("12.00", 12), ("None", None), ("None", None)]


def test_regions(spark):
    states = [(s, name) for name, all_ in REGION_STATES.items() for s in all_]
    df = spark.createDataFrame([(s.lower() + " ", n) for s, n in states], "state string, want string")
    assert df.where(~region_of_state("state").eqNullSafe(F.col("want"))).count() == 0 and len(states) == 59
    df = spark.createDataFrame([("MD", "northeast"), (None, " west "), ("XX", None)], "state string, r string")
    assert [x[0] for x in df.select(region("state", "r")).collect()] == ["South", "West", None]


def test_ratio_of_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (None, 2)], "a long, b long")
    assert [str(r[0]) for r in df.select(ratio("a", "b")).collect()] == ["None", "0.333333", "None"]
