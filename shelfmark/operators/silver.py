"""Bronze to Silver: validation, whole-invoice atomicity, and the split into clean and quarantined rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import beside, not_blank, ratio
from ..plans.schemas import LINEAGE, PARSED, RAW_KEPT, SOURCE, columns
from .rules import CODES, Rule, add_codes, checked, direct_rules, unique_valid_ids, with_duplicates, with_reference

KEYS = {"customers": "customer_id", "products": "product_id", "stores": "store_id"}
#: Codes that a row gets for another row's fault.
CASCADE = ("INVALID_INVOICE_ITEM", "INVOICE_QUARANTINED_BY_BAD_HEADER_OR_ITEM")


#: Codes of each entity beyond its direct rules, in the order in which they are added.
ENTITY_CODES = {
    "customers": ["DUPLICATE_CUSTOMER_ID"],
    "products": ["DUPLICATE_PRODUCT_ID"],
    "stores": ["DUPLICATE_STORE_ID"],
    "invoices": ["INVALID_STORE_REFERENCE", "INVALID_CUSTOMER_REFERENCE", "DUPLICATE_INVOICE_ID", "NO_INVOICE_ITEMS", "INVALID_INVOICE_ITEM"],
    "invoice_items": ["INVALID_PRODUCT_REFERENCE", "DUPLICATE_INVOICE_LINE", "INVALID_INVOICE_REFERENCE", "INVOICE_QUARANTINED_BY_BAD_HEADER_OR_ITEM"],
}


def all_codes(entity: str) -> list[str]:
    """Every code that a row of the entity can get."""
    return [r.code for r in direct_rules(entity)] + ENTITY_CODES[entity]


def evaluate_dimension(df: DataFrame, entity: str) -> DataFrame:
    """Rows of customers, products or stores with all their codes."""
    key = KEYS[entity]
    return with_duplicates(checked(df, entity), [key], f"DUPLICATE_{key.upper()}", not_blank(key))


def evaluate_headers(invoices: DataFrame, stores: DataFrame, customers: DataFrame) -> DataFrame:
    """Invoice headers with the codes of their own faults. The dimensions are evaluated ones."""
    out = with_reference(checked(invoices, "invoices"), "store_id", unique_valid_ids(stores, "store_id"), "INVALID_STORE_REFERENCE")
    out = with_reference(out, "customer_id", unique_valid_ids(customers, "customer_id"), "INVALID_CUSTOMER_REFERENCE")
    return with_duplicates(out, ["invoice_id"], "DUPLICATE_INVOICE_ID", not_blank("invoice_id"))


def evaluate_lines(items: DataFrame, products: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoice lines with the codes of their own faults. A line's invoice must exist; it need not be valid."""
    out = with_reference(checked(items, "invoice_items"), "product_id", unique_valid_ids(products, "product_id"), "INVALID_PRODUCT_REFERENCE")
    out = with_duplicates(out, ["invoice_id", "_line_item"], "DUPLICATE_INVOICE_LINE", not_blank("invoice_id") & F.col("_line_item").isNotNull())
    known = invoices.where(not_blank("invoice_id")).select(F.col("invoice_id").alias("_ref")).distinct()
    return with_reference(out, "invoice_id", known, "INVALID_INVOICE_REFERENCE")


def apply_atomicity(headers: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and lines with the codes of the whole invoice; own faults stay in ``_direct_codes``.

    An invoice is valid if its header is, it has lines, and all of them are valid. Every line of another
    invoice is quarantined. Own faults are settled on both sides before either sees the other's.
    """
    headers, lines = (df.withColumn("_direct_codes", F.col(CODES)) for df in (headers, lines))
    summary = lines.groupBy("invoice_id").agg(F.count("*").alias("item_count"), F.count_if(F.size(CODES) > 0).alias("invalid_item_count"))
    headers = headers.join(summary, "invoice_id", "left").fillna(0, ["item_count", "invalid_item_count"])
    headers = add_codes(headers, Rule("NO_INVOICE_ITEMS", F.col("item_count") == 0), Rule("INVALID_INVOICE_ITEM", F.col("invalid_item_count") > 0))
    status = headers.where(not_blank("invoice_id")).groupBy("invoice_id").agg(F.bool_and(F.size(CODES) == 0).alias("_invoice_ok"))
    lines = lines.join(status, "invoice_id", "left").withColumn("_invoice_ok", F.coalesce("_invoice_ok", F.lit(False)))
    lines = add_codes(lines, Rule("INVOICE_QUARANTINED_BY_BAD_HEADER_OR_ITEM", ~F.col("_invoice_ok"))).drop("_invoice_ok")
    return headers, lines


def evaluate(bronze: dict[str, DataFrame], settle: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """All five entities with their final codes.

    Headers and lines each need the other's own faults, and both need the dimensions. ``settle`` is given every
    frame that is read more than once and returns what to read instead, such as a written table.
    """
    out = {name: settle(name, evaluate_dimension(bronze[name], name)) for name in KEYS}
    headers = settle("invoices", evaluate_headers(bronze["invoices"], out["stores"], out["customers"]))
    lines = settle("invoice_items", evaluate_lines(bronze["invoice_items"], out["products"], bronze["invoices"]))
    out["invoices"], out["invoice_items"] = apply_atomicity(headers, lines)
    return out


def _typed(entity: str) -> list:
    return [F.col(f"_{c}").alias(c) if c in PARSED[entity] else F.col(c) for c in SOURCE[entity]]


def clean(evaluated: DataFrame, entity: str) -> DataFrame:
    """The valid rows, typed."""
    kept = [c for c in columns(LINEAGE) if c in evaluated.columns]
    return evaluated.where(F.size(CODES) == 0).select(*_typed(entity), *kept)


def quarantined(evaluated: DataFrame, entity: str, as_of: str) -> DataFrame:
    """The invalid rows: typed columns, source texts of parsed ones, codes and their one-line form."""
    kept = [c for c in columns(LINEAGE) if c in evaluated.columns]
    direct = F.col("_direct_codes") if "_direct_codes" in evaluated.columns else F.col(CODES)
    return evaluated.where(F.size(CODES) > 0).select(
        *_typed(entity),
        *(F.col(c).alias(f"{c}_raw") for c in RAW_KEPT[entity]),
        *kept,
        F.lit(as_of).cast("timestamp").alias("_quarantine_datetime_utc"),
        F.lit("QUARANTINED").alias("_dq_status"),
        F.col(CODES),
        direct.alias("_direct_codes"),
        F.array_join(CODES, ";").alias("_dq_error_code"),
        F.array_join(F.transform(CODES, lambda c: F.regexp_replace(c, "^INVALID_INVOICE_ITEM$", "INVOICE_QUARANTINED_BY_BAD_ITEM")), ";").alias("_dq_error_description"),
    )


def reason_counts(evaluated: DataFrame, codes: str = CODES) -> DataFrame:
    """Rows for each code, the most frequent first; a row counts once for each of its codes."""
    return evaluated.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "code")


def dimension_summary(evaluated: DataFrame) -> DataFrame:
    """Total, valid and invalid rows, and the invalid percentage."""
    out = evaluated.agg(F.count("*").alias("total_rows"), F.count_if(F.size(CODES) == 0).alias("valid_rows"))
    return out.withColumn("invalid_rows", F.expr("total_rows - valid_rows")).withColumn("invalid_pct", (100 * ratio("invalid_rows", "total_rows")).cast("decimal(18,2)"))


def impact_summary(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: how many invoices and lines fall to their own faults and how many to others', in one pass each.

    ``amplification`` is quarantined lines for each directly invalid one; ``overlap_ok`` says that invoices with
    own faults and with bad lines add up, less those with both, to the invalid ones.
    """
    own = (F.size("_direct_codes") > 0) | (F.col("item_count") == 0)
    bad_item = F.col("invalid_item_count") > 0
    by_customer = F.array_contains(CODES, "INVALID_CUSTOMER_REFERENCE")
    h = headers.agg(
        F.count("*").alias("total_invoices"),
        F.count_if(F.size(CODES) == 0).alias("valid_invoices"),
        F.count_if(F.size(CODES) > 0).alias("invalid_invoices"),
        F.count_if(own).alias("header_or_empty_invalid"),
        F.count_if(bad_item).alias("invoices_with_bad_item"),
        F.count_if(own & bad_item).alias("both_reasons"),
        F.count_if(bad_item & ~own).alias("only_bad_item"),
        F.count_if(F.col("item_count") == 0).alias("empty_invoices"),
        F.count_if(by_customer).alias("bad_customer_reference"),
        F.count_if(F.col("customer_id").isNull()).alias("anonymous_invoices"),
    )
    t = lines.agg(
        F.count("*").alias("total_items"),
        F.count_if(F.size(CODES) == 0).alias("valid_items"),
        F.count_if(F.size(CODES) > 0).alias("invalid_items"),
        F.count_if(F.size("_direct_codes") > 0).alias("direct_bad_items"),
        F.count_if((F.size("_direct_codes") == 0) & (F.size(CODES) > 0)).alias("cascaded_items"),
    )
    both = beside(h, t)
    pct = lambda a, b: (100 * ratio(a, b)).cast("decimal(18,4)")
    return both.select(
        "*",
        pct("valid_invoices", "total_invoices").alias("valid_invoice_pct"),
        pct("invalid_invoices", "total_invoices").alias("invalid_invoice_pct"),
        pct("header_or_empty_invalid", "total_invoices").alias("header_invalid_pct"),
        pct("only_bad_item", "total_invoices").alias("only_bad_item_pct"),
        pct("valid_items", "total_items").alias("valid_item_pct"),
        pct("invalid_items", "total_items").alias("invalid_item_pct"),
        pct("direct_bad_items", "total_items").alias("direct_bad_item_pct"),
        pct("cascaded_items", "total_items").alias("cascaded_item_pct"),
        ratio("invalid_items", "direct_bad_items").cast("decimal(18,4)").alias("amplification"),
        F.expr("invalid_invoices = header_or_empty_invalid + invoices_with_bad_item - both_reasons").alias("overlap_ok"),
    )
