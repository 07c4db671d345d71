"""Facts: keys resolved as of the transaction date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import UNKNOWN_KEY
from .checks import require_no_rows
from .keys import next_key, with_keys
from .scd2 import as_of_join, require_single_match


def resolve_invoices(invoices: DataFrame, dates: DataFrame, stores: DataFrame, customers: DataFrame) -> DataFrame:
    """Headers with date, store and customer keys. An anonymous sale has customer -1; nothing else has."""
    dated = invoices.join(dates.select(F.col("full_date").alias("_day"), "date_key"), F.col("invoice_date") == F.col("_day"), "left")
    known = lambda dim, key: dim.where(F.col(key) != UNKNOWN_KEY)
    out = as_of_join(dated, known(stores, "store_key"), "store_id", "invoice_date", ["store_key"])
    out = as_of_join(out, known(customers, "customer_key"), "customer_id", "invoice_date", ["customer_key"])
    customer = F.when(F.col("customer_id").isNull(), F.lit(UNKNOWN_KEY).cast("bigint")).otherwise(F.col("customer_key"))
    return out.select("invoice_id", "date_key", customer.alias("customer_key"), "store_key", "payment_method")


def resolve_lines(items: DataFrame, invoices: DataFrame, fact_invoice: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their invoice's key and the key of the product's version at the invoice's date."""
    dated = items.join(invoices.select("invoice_id", "invoice_date"), "invoice_id").join(fact_invoice.select("invoice_id", "invoice_key"), "invoice_id")
    out = as_of_join(dated, products.where(F.col("product_key") != UNKNOWN_KEY), "product_id", "invoice_date", ["product_key"])
    return out.select("invoice_key", "invoice_id", "line_item", "product_key", "quantity", "unit_price", "discount")


def guard_invoices(invoices: DataFrame, stores: DataFrame, customers: DataFrame) -> None:
    """Stop unless every key finds just one version at its date."""
    require_single_match(invoices, stores.where("store_key != -1"), "store_id", "invoice_date", ["invoice_id"], "stores")
    require_single_match(invoices, customers.where("customer_key != -1"), "customer_id", "invoice_date", ["invoice_id"], "customers")


def guard_resolved(facts: DataFrame, keys: list[str], what: str) -> None:
    """Stop at a null key, and at the default member where it isn't allowed (customers only)."""
    for k in keys:
        bad = F.col(k).isNull() if k == "customer_key" else F.col(k).isNull() | (F.col(k) == UNKNOWN_KEY)
        require_no_rows(facts.where(bad), f"{what} without {k}")


def carry_keys(resolved: DataFrame, existing: DataFrame, natural: list[str], key: str) -> DataFrame:
    """``resolved`` with the keys that its rows already have, and new ones for the others.

    ``resolved`` should be a written table: its new rows are numbered across the cluster.
    """
    known = resolved.join(existing.select(*natural, key), natural, "left")
    new = with_keys(known.where(F.col(key).isNull()).drop(key), key, natural, next_key(existing, key))
    return known.where(F.col(key).isNotNull()).unionByName(new.select(*known.columns))
