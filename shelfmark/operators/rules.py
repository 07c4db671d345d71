"""Declarative data-quality rules. A row carries every code that applies to it, as an array; an empty array is
a valid row, so valid and invalid rows always make up the whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import not_blank, parse_boolean, parse_date, parse_decimal, parse_long, spread

CODES = "_dq_codes"


@dataclass(frozen=True)
class Rule:
    """A code and the condition that earns it; a null condition does not."""

    code: str
    condition: Column


def missing(*columns: str) -> list[Rule]:
    return [Rule(f"MISSING_{c.upper()}", ~not_blank(c)) for c in columns]


def invalid(column: str, parsed: str) -> Rule:
    return Rule(f"INVALID_{column.upper()}", not_blank(column) & F.col(parsed).isNull())


def negative(column: str, parsed: str) -> Rule:
    return Rule(f"NEGATIVE_{column.upper()}", F.col(parsed) < 0)


def parsers(entity: str) -> dict[str, Column]:
    """Parsed columns of an entity, named with a leading underscore."""
    kinds = {
        "customers": {"join_date": parse_date},
        "products": {"unit_price": parse_decimal, "cost": parse_decimal, "is_active": parse_boolean},
        "stores": {"opened_date": parse_date, "square_footage": parse_long},
        "invoices": {"invoice_date": parse_date},
        "invoice_items": {"line_item": parse_long, "quantity": parse_long, "unit_price": parse_decimal, "discount": parse_decimal},
    }
    return {f"_{c}": parse(c) for c, parse in kinds[entity].items()}


def direct_rules(entity: str) -> list[Rule]:
    """The rules that a row of the entity is held against by itself, in the order of their codes."""
    if entity == "customers":
        return [*missing("customer_id", "first_name", "last_name", "street_address", "city", "state", "zip_code"), invalid("join_date", "_join_date")]
    if entity == "products":
        price = lambda c: [*missing(c), invalid(c, f"_{c}"), negative(c, f"_{c}")]
        return [*missing("product_id", "sku", "product_name", "category", "subcategory", "brand"), *price("unit_price"), *price("cost")]
    if entity == "stores":
        labels = missing("store_id", "store_name", "city", "state", "zip_code", "region", "manager_name", "opened_date")
        return [*labels, invalid("opened_date", "_opened_date"), invalid("square_footage", "_square_footage"), negative("square_footage", "_square_footage")]
    if entity == "invoices":
        # A null customer is an anonymous sale; a blank one is a missing id.
        anonymous = Rule("MISSING_CUSTOMER_ID", F.col("customer_id").isNotNull() & ~not_blank("customer_id"))
        return [*missing("invoice_id", "store_id"), anonymous, *missing("invoice_date"), invalid("invoice_date", "_invoice_date"), *missing("payment_method")]
    if entity == "invoice_items":
        return [
            *missing("invoice_id", "line_item"),
            invalid("line_item", "_line_item"),
            *missing("product_id", "quantity"),
            invalid("quantity", "_quantity"),
            Rule("NON_POSITIVE_QUANTITY", F.col("_quantity") <= 0),
            *missing("unit_price"),
            invalid("unit_price", "_unit_price"),
            negative("unit_price", "_unit_price"),
            invalid("discount", "_discount"),
            negative("discount", "_discount"),
        ]
    raise ValueError(f"unknown entity: {entity}")


def codes_of(rules: list[Rule]) -> Column:
    """The codes that apply, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(r.condition, F.lit(r.code)) for r in rules))).cast("array<string>")


def add_codes(df: DataFrame, *rules: Rule) -> DataFrame:
    """``df`` with further codes appended."""
    return df.withColumn(CODES, F.concat(CODES, codes_of(list(rules))))


def checked(df: DataFrame, entity: str) -> DataFrame:
    """Rows with their parsed columns and the codes of the entity's direct rules."""
    return df.withColumns(parsers(entity)).withColumn(CODES, codes_of(direct_rules(entity)))


def with_duplicate_flag(df: DataFrame, keys: list[str], flag: str, counted: Column) -> DataFrame:
    """Marks every row whose keys another row has, among the rows that ``counted`` holds for.

    The keys are counted first, so rows of blank keys meet nowhere, and only repeated keys are joined.
    """
    repeated = df.where(counted).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(flag))
    return df.join(repeated, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_duplicates(df: DataFrame, keys: list[str], code: str, counted: Column) -> DataFrame:
    """Every copy of a repeated key gets the code; none is kept."""
    return add_codes(with_duplicate_flag(df, keys, "_duplicate", counted), Rule(code, F.col("_duplicate"))).drop("_duplicate")


def unique_valid_ids(df: DataFrame, key: str) -> DataFrame:
    """Trimmed keys of exactly one valid row: what a reference may point to."""
    return df.where(F.size(CODES) == 0).groupBy(F.trim(key).alias("_ref")).agg(F.count("*").alias("_n")).where("_n = 1").select("_ref")


def with_reference(df: DataFrame, key: str, targets: DataFrame, code: str, applies: Column | None = None) -> DataFrame:
    """The code for rows whose non-blank ``key`` is none of ``targets`` (``_ref``)."""
    given = not_blank(key)
    dealt = df.withColumn("_key", spread(df, key, given))
    found = dealt.join(targets.select("_ref", F.lit(True).alias("_found")), given & (F.col("_key") == F.col("_ref")), "left")
    return add_codes(found, Rule(code, (applies if applies is not None else given) & F.col("_found").isNull())).drop("_key", "_ref", "_found")


def severity_of(code: Column) -> Column:
    """Critical, High, Medium or Low for a code."""
    critical = code.rlike("^MISSING_.*_ID$") | code.rlike("_REFERENCE$") | code.rlike("^DUPLICATE_")
    return F.when(critical, "Critical").when(code.startswith("NEGATIVE_"), "Medium").when(code.startswith("INVOICE_QUARANTINED"), "Low").otherwise("High")
