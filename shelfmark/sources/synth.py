"""A deterministic retail data generator: every value is a hash of the row's number, so it runs in parallel.

The same arguments give the same rows on any cluster. Shares are those of the model: years 30/33/37, 15 % of the
sales anonymous, 1 to 8 lines a sale and 3 % large baskets of 9 to 14, and one fault in every hundredth sale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder

# What the generator draws from.
PAYMENTS = ("Cash", "Credit Card", "Debit Card", "Mobile Payment", "Gift Card")
CATEGORIES = ("Grocery", "Beverages", "Household", "Electronics", "Clothing", "Toys", "Health", "Garden", "Office")
CITIES = (("Houston", "TX", "77002", "South"), ("Chicago", "IL", "60601", "Midwest"), ("Seattle", "WA", "98101", "West"), ("Boston", "MA", "02108", "Northeast"), ("Baltimore", "MD", "21201", "South"), ("Denver", "CO", "80202", "West"))
TIERS = ("Bronze", "Silver", "Gold", "Platinum")
FAULTS = ("null_date", "null_payment", "no_customer", "no_items", "bad_product")
DISCOUNTS = ("0.00", "0.05", "0.10", "0.15", "0.20")
YEARS = ((2023, 30), (2024, 33), (2025, 37))


def draw(key: Column, salt: str, below: int) -> Column:
    """A number from 0 up to ``below``, fixed by the key and the salt."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(below))


def pick(key: Column, salt: str, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(key, salt, len(values)) + 1).cast("int"))


def weighted(key: Column, salt: str, weights: tuple[tuple[object, int], ...]) -> Column:
    """A value drawn by integer weights."""
    at, out, total = draw(key, salt, sum(w for _, w in weights)), None, 0
    for value, weight in weights:
        total += weight
        out = F.when(at < total, value) if out is None else out.when(at < total, value)
    return out


def _money(key: Column, salt: str, low: int, high: int) -> Column:
    return ((draw(key, salt, high - low) + low) / 100).cast("decimal(18,2)")


def stores(spark: SparkSession, count: int = 50) -> DataFrame:
    k = F.col("id")
    place = F.element_at(F.array(*(F.struct(*map(F.lit, c)) for c in CITIES)), (draw(k, "place", len(CITIES)) + 1).cast("int"))
    return spark.range(1, count + 1).select(
        k.cast("string").alias("store_id"),
        F.concat(F.lit("Store "), k.cast("string")).alias("store_name"),
        place["col1"].alias("city"),
        place["col2"].alias("state"),
        place["col3"].alias("zip_code"),
        place["col4"].alias("region"),
        F.concat(F.lit("Manager "), k.cast("string")).alias("manager_name"),
        F.date_add(F.lit("2015-01-01").cast("date"), draw(k, "opened", 3000).cast("int")).cast("string").alias("opened_date"),
        (draw(k, "area", 40_000) + 8_000).cast("string").alias("square_footage"),
    )


def products(spark: SparkSession, count: int = 2500) -> DataFrame:
    k = F.col("id")
    price = _money(k, "price", 99, 20_000)
    category = pick(k, "category", CATEGORIES)
    return spark.range(1, count + 1).select(
        k.cast("string").alias("product_id"),
        F.concat(F.lit("SKU-"), F.lpad(k.cast("string"), 6, "0")).alias("sku"),
        F.concat(F.lit("Product "), k.cast("string")).alias("product_name"),
        category.alias("category"),
        F.concat(category, F.lit(" General")).alias("subcategory"),
        F.concat(F.lit("Brand "), draw(k, "brand", 40).cast("string")).alias("brand"),
        price.cast("string").alias("unit_price"),
        (price * (F.lit(50) + draw(k, "cost", 30)) / 100).cast("decimal(18,2)").cast("string").alias("cost"),
        F.when(draw(k, "active", 20) == 0, "false").otherwise("true").alias("is_active"),
    )


def customers(spark: SparkSession, count: int = 100_000) -> DataFrame:
    k = F.col("id")
    place = F.element_at(F.array(*(F.struct(*map(F.lit, c)) for c in CITIES)), (draw(k, "home", len(CITIES)) + 1).cast("int"))
    return spark.range(1, count + 1).select(
        k.cast("string").alias("customer_id"),
        F.concat(F.lit("First"), draw(k, "first", 500).cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), draw(k, "last", 900).cast("string")).alias("last_name"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-"), F.lpad(draw(k, "phone", 10_000).cast("string"), 4, "0")).alias("phone"),
        F.concat(draw(k, "house", 9_000).cast("string"), F.lit(" Main Street")).alias("street_address"),
        place["col1"].alias("city"),
        place["col2"].alias("state"),
        place["col3"].alias("zip_code"),
        pick(k, "tier", TIERS).alias("loyalty_tier"),
        F.date_add(F.lit("2018-01-01").cast("date"), draw(k, "joined", 2500).cast("int")).cast("string").alias("join_date"),
    )


def retail_raw(spark: SparkSession, sales: int, *, store_count: int = 50, product_count: int = 2500, customer_count: int = 100_000, fault_every: int = 100) -> DataFrame:
    """Sales with a row for each line, header columns repeated.

    A sale with no lines keeps one row without line columns, so that its header is there to be found wanting.
    """
    k = F.col("id")
    fault = F.when(draw(k, "faulty", fault_every) == 0, pick(k, "fault", FAULTS))
    year = weighted(k, "year", YEARS)
    day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), draw(k, "day", 365).cast("int")).cast("string")
    lines = F.when(draw(k, "basket", 100) < 3, draw(k, "large", 6) + 9).otherwise(draw(k, "small", 8) + 1)
    customer = F.when(draw(k, "guest", 100) < 15, None).otherwise((draw(k, "customer", customer_count) + 1).cast("string"))
    heads = spark.range(1, sales + 1).select(
        k.cast("string").alias("invoice_id"),
        (draw(k, "store", store_count) + 1).cast("string").alias("store_id"),
        F.when(fault == "no_customer", F.when(draw(k, "which", 2) == 0, (draw(k, "lost", 1000) + 10_000_000).cast("string"))).otherwise(customer).alias("customer_id"),
        F.when(fault == "null_date", None).otherwise(day).alias("invoice_date"),
        F.when(fault == "null_payment", None).otherwise(pick(k, "payment", PAYMENTS)).alias("payment_method"),
        F.explode(F.when(fault == "no_items", F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(1).cast("bigint"), lines))).alias("_line"),
        fault.alias("_fault"),
        k.alias("_k"),
    )
    line = F.struct("_k", "_line")
    chosen = draw(line, "product", product_count) + 1
    on_line = lambda c: F.when(F.col("_line") > 0, c)
    return heads.select(
        "invoice_id",
        "store_id",
        "customer_id",
        "invoice_date",
        "payment_method",
        on_line(F.col("_line").cast("string")).alias("line_item"),
        on_line(F.when((F.col("_fault") == "bad_product") & (F.col("_line") == 1), (chosen + 10_000_000).cast("string")).otherwise(chosen.cast("string"))).alias("product_id"),
        on_line((draw(line, "quantity", 6) + 1).cast("string")).alias("quantity"),
        on_line(_money(chosen, "price", 99, 20_000).cast("string")).alias("unit_price"),
        on_line(pick(line, "discount", DISCOUNTS)).alias("discount"),
    )


def headers_and_lines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables that ``retail_raw`` repeats; sales without lines have a header only."""
    from ..plans.schemas import SOURCE
    from .files import split_sales

    heads, lines = split_sales(raw, SOURCE["invoices"], SOURCE["invoice_items"])
    return heads, lines.where("line_item is not null")


def write_csv(df: DataFrame, folder: str, name: str, *, sample: int = 0, order: str | None = None) -> None:
    """A full CSV folder and, if asked for, a sample of the first rows beside it."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    if sample:
        ordered = df.orderBy(F.col(order).try_cast("bigint"), order) if order else df
        ordered.limit(sample).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/samples/{name}.csv")


def generate(spark: SparkSession, folder: str, sales: int, *, sample: int = 1000) -> None:
    """All source files of a run."""
    Folder(spark, folder).make()
    for name, df, key in (("stores", stores(spark), "store_id"), ("products", products(spark), "product_id"), ("customers", customers(spark), "customer_id"), ("retail_raw", retail_raw(spark, sales), "invoice_id")):
        write_csv(df, folder, name, sample=sample, order=key)
