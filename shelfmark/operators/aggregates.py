"""The commercial aggregates. Measures are sums of line measures; ratios are left to the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import MONEY_SUM, line_cost, line_revenue, month_date_key
from .checks import require_unique

MEASURES = ["revenue", "units_sold", "gross_margin"]


def line_measures(lines: DataFrame) -> DataFrame:
    """Lines (``quantity, unit_price, discount, cost`` and keys) with revenue and margin."""
    out = lines.withColumn("line_revenue", line_revenue())
    return out.withColumn("line_margin", (F.col("line_revenue") - line_cost()).cast(MONEY_SUM))


def sales_lines(fact_invoice: DataFrame, fact_item: DataFrame, products: DataFrame, dates: DataFrame) -> DataFrame:
    """Lines joined with their header, day and product version."""
    heads = fact_invoice.select("invoice_key", "date_key", "store_key")
    costs = products.select("product_key", "subcategory_key", "cost")
    lines = fact_item.select("invoice_key", "invoice_id", "product_key", "quantity", "unit_price", "discount")
    return line_measures(lines.join(heads, "invoice_key").join(costs, "product_key", "left").join(dates.select("date_key", "full_date"), "date_key"))


def _sums() -> list:
    return [F.sum("line_revenue").cast(MONEY_SUM).alias("revenue"), F.sum("quantity").cast("bigint").alias("units_sold"), F.sum("line_margin").cast(MONEY_SUM).alias("gross_margin")]


def executive_daily(lines: DataFrame) -> DataFrame:
    return lines.groupBy("date_key", "store_key", "subcategory_key").agg(*_sums())


def product_monthly(lines: DataFrame) -> DataFrame:
    return lines.groupBy(month_date_key("full_date").alias("month_date_key"), "store_key", "product_key").agg(*_sums())


def store_daily(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Line measures and distinct invoices for each day and store; a day with either is there."""
    measures = lines.groupBy("date_key", "store_key").agg(*_sums())
    counts = invoices.groupBy("date_key", "store_key").agg(F.count_distinct("invoice_id").alias("invoice_count"))
    joined = measures.join(counts, ["date_key", "store_key"], "full")
    zero = {"revenue": F.lit(0).cast(MONEY_SUM), "units_sold": F.lit(0).cast("bigint"), "gross_margin": F.lit(0).cast(MONEY_SUM), "invoice_count": F.lit(0).cast("bigint")}
    return joined.select("date_key", "store_key", *(F.coalesce(c, v).alias(c) for c, v in zero.items()))


def publish(store, name: str, df: DataFrame, grain: list[str], as_of: str) -> DataFrame:
    """Rebuild an aggregate as a new version, after a check of its grain. Returns what was written."""
    stamped = df.withColumn("_last_updated_utc", F.lit(as_of).cast("timestamp"))
    require_unique(stamped, grain, name)
    return store.overwrite(name, stamped)


def replace_day(store, name: str, df: DataFrame, day: str, as_of: str) -> DataFrame:
    """Rebuild only the dates of ``df`` in a snapshot table, so that earlier snapshots stay."""
    stamped = df.withColumn("_last_updated_utc", F.lit(as_of).cast("timestamp"))
    if not store.exists(name):
        return store.overwrite(name, stamped)
    held = store.read(name)
    return store.overwrite(name, held.join(stamped.select(day).distinct(), day, "left_anti").select(*held.columns).unionByName(stamped.select(*held.columns)))
