"""Declared schemas, keys, tracked attributes and grains of every table."""

from __future__ import annotations

AUDIT = "_insert_datetime_utc timestamp, _update_datetime_utc timestamp"
LINEAGE = f"{AUDIT}, _source_file_name string, _source_row_id string"

#: Business columns of the source tables, all text.
SOURCE = {
    "stores": ["store_id", "store_name", "city", "state", "zip_code", "region", "manager_name", "opened_date", "square_footage"],
    "products": ["product_id", "sku", "product_name", "category", "subcategory", "brand", "unit_price", "cost", "is_active"],
    "customers": ["customer_id", "first_name", "last_name", "email", "phone", "street_address", "city", "state", "zip_code", "loyalty_tier", "join_date"],
    "invoices": ["invoice_id", "store_id", "customer_id", "invoice_date", "payment_method"],
    "invoice_items": ["invoice_id", "line_item", "product_id", "quantity", "unit_price", "discount"],
}
RETAIL_RAW = ["invoice_id", "store_id", "customer_id", "invoice_date", "payment_method", "line_item", "product_id", "quantity", "unit_price", "discount"]

BRONZE = {name: ", ".join(f"{c} string" for c in columns) + f", {LINEAGE}" for name, columns in SOURCE.items()}

#: Types of the columns that Silver parses; the others stay text.
PARSED = {
    "stores": {"opened_date": "date", "square_footage": "bigint"},
    "products": {"unit_price": "decimal(18,2)", "cost": "decimal(18,2)", "is_active": "boolean"},
    "customers": {"join_date": "date"},
    "invoices": {"invoice_date": "date"},
    "invoice_items": {"line_item": "bigint", "quantity": "bigint", "unit_price": "decimal(18,2)", "discount": "decimal(18,2)"},
}
#: Parsed columns whose source text quarantine keeps beside the parsed value.
RAW_KEPT = {"stores": ["opened_date"], "products": ["unit_price", "cost"], "customers": ["join_date"], "invoices": ["invoice_date"], "invoice_items": ["line_item", "quantity", "unit_price", "discount"]}

SILVER = {name: ", ".join(f"{c} {PARSED[name].get(c, 'string')}" for c in columns) + f", {LINEAGE}" for name, columns in SOURCE.items()}
QUARANTINE_META = "_quarantine_datetime_utc timestamp, _dq_status string, _dq_codes array<string>, _dq_error_code string, _dq_error_description string"

#: Gold tables: columns, and the natural key that identifies a row.
SCD2_COLUMNS = "effective_from timestamp, effective_to timestamp, is_current boolean, attribute_hash string"
GOLD = {
    "dim_date": "date_key int, full_date date, day int, day_of_week int, day_name string, week_of_year int, month int, month_name string, quarter int, year int, year_month string, year_quarter string, is_weekend boolean, is_month_start boolean, is_month_end boolean",
    "dim_geography": "geography_key bigint, region string, state string, city string, zip_code string",
    "dim_customer": f"customer_key bigint, customer_id string, first_name string, last_name string, email string, phone string, street_address string, loyalty_tier string, join_date date, geography_key bigint, {SCD2_COLUMNS}",
    "dim_store": f"store_key bigint, store_id string, store_name string, manager_name string, opened_date date, square_footage bigint, geography_key bigint, {SCD2_COLUMNS}",
    "dim_category": "category_key bigint, category_name string",
    "dim_subcategory": "subcategory_key bigint, category_key bigint, subcategory_name string",
    "dim_product": f"product_key bigint, product_id string, sku string, product_name string, brand string, unit_price decimal(18,2), cost decimal(18,2), is_active boolean, subcategory_key bigint, {SCD2_COLUMNS}",
    "fact_invoice": "invoice_key bigint, invoice_id string, date_key int, customer_key bigint, store_key bigint, payment_method string",
    "fact_invoice_item": "invoice_item_key bigint, invoice_key bigint, invoice_id string, line_item bigint, product_key bigint, quantity bigint, unit_price decimal(18,2), discount decimal(18,2)",
    "dim_data_quality_rule": "dq_rule_key bigint, source_table string, dq_error_code string, dq_rule_name string, dq_rule_description string, severity string",
    "fact_data_quality_issue": "dq_issue_key bigint, source_table string, source_row_id string, source_file_name string, dq_rule_key bigint, dq_error_code string, dq_status string, quarantine_datetime_utc timestamp, source_payload_json string",
}
AGGREGATES = {
    "agg_executive_performance_daily": "date_key int, store_key bigint, subcategory_key bigint, revenue decimal(20,2), units_sold bigint, gross_margin decimal(20,2)",
    "agg_product_performance_monthly": "month_date_key int, store_key bigint, product_key bigint, revenue decimal(20,2), units_sold bigint, gross_margin decimal(20,2)",
    "agg_store_performance_daily": "date_key int, store_key bigint, revenue decimal(20,2), units_sold bigint, gross_margin decimal(20,2), invoice_count bigint",
    "agg_data_quality_daily": "dq_date_key int, source_table string, source_file_name string, dq_rule_key bigint, severity string, dq_status string, geography_key bigint, dq_issue_count bigint, affected_record_count bigint",
    "agg_data_quality_record_daily": "evaluation_date_key int, source_table string, source_file_name string, geography_key bigint, total_records bigint, valid_records bigint, incorrect_records bigint",
}
GRAINS = {
    "dim_date": ["date_key"],
    "dim_geography": ["region", "state", "city", "zip_code"],
    "dim_category": ["category_name"],
    "dim_subcategory": ["category_key", "subcategory_name"],
    "fact_invoice": ["invoice_id"],
    "fact_invoice_item": ["invoice_id", "line_item"],
    "dim_data_quality_rule": ["source_table", "dq_error_code"],
    "fact_data_quality_issue": ["source_table", "source_row_id", "dq_error_code"],
    "agg_executive_performance_daily": ["date_key", "store_key", "subcategory_key"],
    "agg_product_performance_monthly": ["month_date_key", "store_key", "product_key"],
    "agg_store_performance_daily": ["date_key", "store_key"],
    "agg_data_quality_daily": ["dq_date_key", "source_table", "source_file_name", "dq_rule_key", "severity", "dq_status", "geography_key"],
    "agg_data_quality_record_daily": ["evaluation_date_key", "source_table", "source_file_name", "geography_key"],
}
#: Attributes whose change opens a new version.
TRACKED = {
    "dim_customer": ["first_name", "last_name", "email", "phone", "street_address", "loyalty_tier", "join_date", "geography_key"],
    "dim_store": ["store_name", "manager_name", "opened_date", "square_footage", "geography_key"],
    "dim_product": ["sku", "product_name", "brand", "unit_price", "cost", "is_active", "subcategory_key"],
}


def columns(ddl: str) -> list[str]:
    """Names of a DDL string's columns; none of the declared types holds a comma but decimals."""
    import re

    return [part.split()[0] for part in re.split(r",\s*(?![0-9])", ddl)]
