"""The warehouse test tables as retail entities: clean ones, and ones with faults at fixed places.

Every expression has its like in SQL, so that an independent engine can build the same entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as places: region and state; no city or zip code."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("geography_key"), F.col("r_name").alias("region"), F.col("n_name").alias("state"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_key"), F.col("s_name").alias("store_name"), F.col("s_nationkey").alias("geography_key"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast(MONEY)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_key"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.concat_ws("-", "p_type", "p_brand").alias("subcategory_key"),
        F.col("p_brand").alias("brand"),
        price.alias("unit_price"),
        (price * F.lit("0.65").cast("decimal(3,2)")).cast(MONEY).alias("cost"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices; the header owns the store."""
    count = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "orders").withColumn("_stores", count).select(
        F.col("o_orderkey").alias("invoice_id"),
        F.expr("o_orderkey % _stores").alias("store_key"),
        F.col("o_custkey").alias("customer_key"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.col("o_orderpriority").alias("payment_method"),
    )


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with line numbers that are unique in the order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", F.row_number().over(order).cast("bigint").alias("line_item"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines without their numbers, which the aggregates don't need."""
    price = products(spark, sf_dir).select(F.col("product_key").alias("_pk"), "unit_price")
    source = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_partkey").alias("product_key"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_discount").cast(MONEY).alias("discount"))
    return source.join(price, F.col("product_key") == F.col("_pk")).drop("_pk")


def _spoiled_price(key: str, price: str) -> Column:
    rest = F.col(key) % 83
    return F.when(rest == 0, "$-10").when(rest == 1, "abc").when(rest == 2, "-1").otherwise(F.col(price).cast(MONEY).cast("string"))


def _doubled(df: DataFrame, key: str) -> DataFrame:
    return df.unionByName(df.where(F.col(key) % 97 == 0))


def _blanked(key: str, value: Column) -> Column:
    return F.when(F.col(key) % 89 == 0, "").otherwise(value)


def bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five source tables as text, with repeated and blank keys, bad prices, dates, references and empty invoices.

    Faults sit at fixed remainders of the keys, so counts follow from the tables.
    """
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(
        _text("s_suppkey").alias("store_id"),
        _blanked("s_suppkey", F.col("s_name")).alias("store_name"),
        F.col("n_name").alias("city"),
        F.col("n_name").alias("state"),
        _text("s_nationkey").alias("zip_code"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("Manager "), _text("s_suppkey")).alias("manager_name"),
        F.when(F.col("s_suppkey") % 79 == 5, "2025-13-40").otherwise("2020-01-15").alias("opened_date"),
        F.when(F.col("s_suppkey") % 83 == 1, "abc").when(F.col("s_suppkey") % 83 == 2, "-1").otherwise("1000").alias("square_footage"),
        F.col("s_suppkey"),
    )
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        _text("c_custkey").alias("customer_id"),
        _blanked("c_custkey", F.col("c_name")).alias("first_name"),
        F.lit("Customer").alias("last_name"),
        F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.concat(_text("c_custkey"), F.lit(" Main Street")).alias("street_address"),
        F.col("n_name").alias("city"),
        F.col("n_name").alias("state"),
        _text("c_nationkey").alias("zip_code"),
        F.col("c_mktsegment").alias("loyalty_tier"),
        F.when(F.col("c_custkey") % 83 == 1, "2025-13-40").when(F.col("c_custkey") % 83 == 2, "").otherwise("01/31/2024").alias("join_date"),
        F.col("c_custkey"),
    )
    p = table(spark, sf_dir, "part").select(
        _text("p_partkey").alias("product_id"),
        F.concat(F.lit("SKU-"), _text("p_partkey")).alias("sku"),
        _blanked("p_partkey", F.col("p_name")).alias("product_name"),
        F.col("p_type").alias("category"),
        F.concat_ws("-", "p_type", "p_brand").alias("subcategory"),
        F.col("p_brand").alias("brand"),
        _spoiled_price("p_partkey", "p_retailprice").alias("unit_price"),
        F.when(F.col("p_partkey") % 89 == 7, None).otherwise((F.col("p_retailprice").cast(MONEY) * F.lit("0.65").cast("decimal(3,2)")).cast(MONEY).cast("string")).alias("cost"),
        F.when(F.col("p_partkey") % 3 == 0, "maybe").otherwise("yes").alias("is_active"),
        F.col("p_partkey"),
    )
    count = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    k = F.col("o_orderkey")
    i = table(spark, sf_dir, "orders").withColumn("_stores", count).select(
        _text("o_orderkey").alias("invoice_id"),
        F.expr("cast(o_orderkey % _stores as string)").alias("store_id"),
        F.when(k % 7 == 0, None).when(k % 101 == 0, (F.col("o_custkey") + 1_000_000).cast("string")).when(k % 103 == 0, " ").otherwise(_text("o_custkey")).alias("customer_id"),
        F.when(k % 211 == 0, None).when(k % 223 == 0, "2025-13-40").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("invoice_date"),
        F.when(k % 197 == 0, "").otherwise(F.col("o_orderpriority")).alias("payment_method"),
        k,
    )
    t = numbered_lines(spark, sf_dir)
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_pk"), F.col("p_retailprice").cast(MONEY).cast("string").alias("_price"))
    first = F.col("line_item") == 1
    t = t.join(price, F.col("l_partkey") == F.col("_pk")).select(
        F.when((F.col("l_orderkey") % 499 == 9) & first, F.lit("9999999999")).otherwise(_text("l_orderkey")).alias("invoice_id"),
        # Of every 61st order the source's own line numbers, some of which repeat.
        F.when(F.col("l_orderkey") % 61 == 0, _text("l_linenumber")).otherwise(_text("line_item")).alias("line_item"),
        F.when(F.col("l_partkey") % 401 == 0, F.lit("-7")).otherwise(_text("l_partkey")).alias("product_id"),
        F.when((F.col("l_orderkey") % 50 == 3) & first, "0").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("quantity"),
        F.col("_price").alias("unit_price"),
        F.when(F.col("l_orderkey") % 307 == 4, "x").otherwise(F.col("l_discount").cast(MONEY).cast("string")).alias("discount"),
    )
    return {"stores": _doubled(s, "s_suppkey").drop("s_suppkey"), "customers": _doubled(c, "c_custkey").drop("c_custkey"), "products": _doubled(p, "p_partkey").drop("p_partkey"), "invoices": i.unionByName(i.where(k % 401 == 0)).drop("o_orderkey"), "invoice_items": t}
