"""Every query of the retail engine by name, with its like in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import MONEY, MONEY_SUM, beside, parse_boolean, parse_date, parse_decimal, parse_long, region_of_state
from .functions.fixed_values import REGION_STATES
from .operators import aggregates, dims, dqmart, keys, reconcile, rules, scd2, silver
from .operators.store import merged, missing_rows
from .plans import kpis, oracle
from .plans.schemas import SOURCE
from .sources import adapt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FIRST, LAST = "1998-01-01", "1998-12-31"
AS_OF = "2000-07-01 00:00:00"
FIRST_LOAD = "2000-01-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _with(sql: str, base: str = oracle.BASE) -> str:
    return f"WITH {base} {sql}"


# --- Sales ------------------------------------------------------------------------------------------------


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their measures and every attribute that the dashboards group by."""
    heads = adapt.invoices(spark, sf_dir)
    goods = adapt.products(spark, sf_dir)
    source = adapt.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_partkey").alias("product_key"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_discount").cast(MONEY).alias("discount"))
    joined = source.join(goods, "product_key").join(heads, "invoice_id")
    return aggregates.line_measures(joined).withColumnsRenamed({"invoice_date": "full_date"}).withColumn("date_key", F.date_format("full_date", "yyyyMMdd").cast("int"))


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.stores(spark, sf_dir).join(adapt.places(spark, sf_dir), "geography_key")


def _executive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.executive_daily(_sales(spark, sf_dir))


def _store_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by day and store with the store's place: all that store queries need."""
    daily = _sales(spark, sf_dir).groupBy("date_key", "full_date", "store_key").agg(*aggregates._sums())
    return daily.join(_stores(spark, sf_dir), "store_key")


def _product_sales(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Sales by product, and by what else is named."""
    by = ["product_key", "product_name", "category", "subcategory_key", *extra]
    return _sales(spark, sf_dir).groupBy(*by).agg(*aggregates._sums())


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.date_dimension(adapt.invoices(spark, sf_dir), "invoice_date")


@query(_with(f"SELECT date_key, store_key, subcategory_key, {oracle.SUMS} FROM sales GROUP BY ALL"))
def exec_daily_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executive(spark, sf_dir)


@query(_with(f"SELECT month_date_key, store_key, product_key, {oracle.SUMS} FROM sales GROUP BY ALL"))
def product_monthly_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.product_monthly(_sales(spark, sf_dir))


@query(
    _with(f"""
SELECT coalesce(a.date_key, b.date_key) AS date_key, coalesce(a.store_key, b.store_key) AS store_key, coalesce(revenue, 0) AS revenue, coalesce(units_sold, 0) AS units_sold,
       coalesce(gross_margin, 0) AS gross_margin, coalesce(invoice_count, 0) AS invoice_count
FROM (SELECT date_key, store_key, {oracle.SUMS} FROM sales GROUP BY ALL) a
FULL JOIN (SELECT CAST(strftime(invoice_date, '%Y%m%d') AS INTEGER) AS date_key, store_key, count(DISTINCT invoice_id) AS invoice_count FROM invoices GROUP BY ALL) b
ON a.date_key = b.date_key AND a.store_key = b.store_key""")
)
def store_daily_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = adapt.invoices(spark, sf_dir).withColumn("date_key", F.date_format("invoice_date", "yyyyMMdd").cast("int"))
    return aggregates.store_daily(_sales(spark, sf_dir), heads)


_RATE = f"{oracle.ratio('gross_margin', 'revenue')} AS margin_rate"


def _by_sql(columns: str, where: str = "true") -> str:
    return _with(f"SELECT *, {_RATE} FROM (SELECT {columns}{', ' if columns else ''}{oracle.SUMS} FROM sales WHERE {where} GROUP BY ALL)")


@query(_by_sql(""))
def kpi_exec_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.headline(_executive(spark, sf_dir))


@query(
    _with(f"""
SELECT *, {oracle.ratio("revenue - previous_revenue", "previous_revenue")} AS growth FROM (
  SELECT CAST(coalesce(sum(line_revenue) FILTER (invoice_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'), 0) AS DECIMAL(20,2)) AS revenue,
         CAST(coalesce(sum(line_revenue) FILTER (invoice_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'), 0) AS DECIMAL(20,2)) AS previous_revenue FROM sales)""")
)
def kpi_growth_prev_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.growth(_executive(spark, sf_dir), _calendar(spark, sf_dir), FIRST, LAST)


@query(
    _with(f"""
SELECT CAST(d AS DATE) AS full_date, CAST(coalesce(n.r, 0) AS DECIMAL(20,2)) AS revenue, CAST(coalesce(p.r, 0) AS DECIMAL(20,2)) AS previous_revenue
FROM unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) t(d)
LEFT JOIN (SELECT invoice_date, sum(line_revenue) AS r FROM sales GROUP BY 1) n ON n.invoice_date = d
LEFT JOIN (SELECT invoice_date, sum(line_revenue) AS r FROM sales GROUP BY 1) p ON p.invoice_date = d - INTERVAL 365 DAY""")
)
def exec_daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.trend(_executive(spark, sf_dir), _calendar(spark, sf_dir), FIRST, LAST)


@query(_by_sql("category"))
def rev_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = adapt.products(spark, sf_dir).select("subcategory_key", "category").distinct()
    return kpis.by(_executive(spark, sf_dir).join(categories, "subcategory_key"), "category")


@query(_by_sql("region"))
def rev_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.by(_store_sales(spark, sf_dir), "region")


@query(_by_sql("state"))
def rev_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.by(_store_sales(spark, sf_dir), "state")


@query(_by_sql("month_date_key, region"))
def monthly_rev_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(F.trunc("full_date", "month"), "yyyyMMdd").cast("int")
    return kpis.by(_store_sales(spark, sf_dir).withColumn("month_date_key", month), "month_date_key", "region")


@query(_by_sql("region, category"))
def rev_region_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _sales(spark, sf_dir).groupBy("store_key", "category").agg(*aggregates._sums())
    return kpis.by(daily.join(_stores(spark, sf_dir), "store_key"), "region", "category")


def _top_sql(columns: str, direction: str) -> str:
    return _with(f"SELECT {columns}, CAST(sum(line_revenue) AS DECIMAL(20,2)) AS revenue, CAST(sum(quantity) AS BIGINT) AS units_sold FROM sales GROUP BY {columns} ORDER BY revenue {direction}, {columns} LIMIT 10")


@query(_top_sql("store_key, store_name", "DESC"))
def top10_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.top(_store_sales(spark, sf_dir), ["store_key", "store_name"])


@query(_top_sql("store_key, store_name", "ASC"))
def bottom10_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.top(_store_sales(spark, sf_dir), ["store_key", "store_name"], best=False)


@query(_top_sql("product_key, product_name", "DESC"))
def top10_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.top(_product_sales(spark, sf_dir), ["product_key", "product_name"])


@query(_top_sql("subcategory_key", "DESC"))
def top10_subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.top(_executive(spark, sf_dir), ["subcategory_key"])


@query(_with("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY store_key ORDER BY revenue DESC, product_key) AS INTEGER) AS rank FROM (SELECT store_key, product_key, CAST(sum(line_revenue) AS DECIMAL(20,2)) AS revenue FROM sales GROUP BY ALL)) WHERE rank <= 5"))
def top5_products_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.top_per_group(_product_sales(spark, sf_dir, "store_key"), "store_key", "product_key")


@query(_with(f"SELECT active_stores, revenue, {oracle.ratio('revenue', 'active_stores', 'DECIMAL(20,6)')} AS revenue_per_store FROM (SELECT (SELECT count(DISTINCT store_key) FROM stores) AS active_stores, CAST(sum(line_revenue) AS DECIMAL(20,2)) AS revenue FROM sales)"))
def active_stores_rev_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.active_stores(_store_sales(spark, sf_dir), adapt.stores(spark, sf_dir))


@query(_with(f"SELECT *, {_RATE}, {oracle.ratio('revenue', 'units_sold', 'DECIMAL(20,6)')} AS average_price FROM (SELECT product_key, product_name, {oracle.SUMS} FROM sales GROUP BY ALL)"))
def product_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.average_price(_product_sales(spark, sf_dir), "product_key", "product_name")


@query(_by_sql("month_date_key, category"))
def monthly_trend_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(F.trunc("full_date", "month"), "yyyyMMdd").cast("int")
    return kpis.by(aggregates.line_measures(_sales(spark, sf_dir)).groupBy(month.alias("month_date_key"), "category").agg(*aggregates._sums()), "month_date_key", "category")


@query(_by_sql("store_key, store_name", "product_key = 7"))
def product_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _sales(spark, sf_dir).where("product_key = 7").groupBy("store_key").agg(*aggregates._sums())
    return kpis.by(chosen.join(adapt.stores(spark, sf_dir), "store_key"), "store_key", "store_name")


@query(_by_sql("state", f"date_key BETWEEN {FIRST.replace('-', '')} AND {LAST.replace('-', '')} AND region IN ('ASIA', 'EUROPE')"))
def sliced_rev_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    slicer = kpis.Slice(int(FIRST.replace("-", "")), int(LAST.replace("-", "")), {"region": ["ASIA", "EUROPE"]})
    return kpis.by(slicer.apply(_store_sales(spark, sf_dir)), "state")


def _drill_sql(levels: list[str]) -> str:
    names = ", ".join(levels)
    level = " + ".join(f"(1 - grouping({c}))" for c in levels)
    return _with(f"SELECT {names}, {oracle.SUMS}, CAST({level} AS INTEGER) AS level FROM (SELECT *, CAST(year(invoice_date) AS INTEGER) AS year, CAST(quarter(invoice_date) AS INTEGER) AS quarter, CAST(month(invoice_date) AS INTEGER) AS month FROM sales) GROUP BY ROLLUP ({names})")


@query(_drill_sql(["year", "quarter", "month"]))
def drill_time_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _sales(spark, sf_dir).groupBy("full_date").agg(*aggregates._sums())
    return kpis.drill(daily.withColumns({"year": F.year("full_date"), "quarter": F.quarter("full_date"), "month": F.month("full_date")}), "year", "quarter", "month")


@query(_drill_sql(["region", "state", "store_name"]))
def drill_geo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.drill(_store_sales(spark, sf_dir), "region", "state", "store_name")


@query(_drill_sql(["category", "subcategory_key", "product_name"]))
def drill_product_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.drill(_product_sales(spark, sf_dir), "category", "subcategory_key", "product_name")


# --- Dimensions -------------------------------------------------------------------------------------------


@query("""
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date, CAST(day(d) AS INTEGER) AS day, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
       CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year, strftime(d, '%Y-%m') AS year_month, year(d) || '-Q' || quarter(d) AS year_quarter,
       dayofweek(d) IN (0, 6) AS is_weekend, day(d) = 1 AS is_month_start, last_day(d) = CAST(d AS DATE) AS is_month_end
FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)""")
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir)


@query("""
SELECT count(*) AS days, min(d) AS first_day, max(d) AS last_day FROM (
  SELECT CAST(unnest(generate_series(least(min(CAST(o_orderdate AS DATE)), min(CAST(l_shipdate AS DATE))), greatest(DATE '2002-03-01', max(CAST(l_shipdate AS DATE))), INTERVAL 1 DAY)) AS DATE) AS d FROM orders, lineitem WHERE l_orderkey = o_orderkey)""")
def dim_date_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = adapt.table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
    bounds = shipped.select(F.explode(F.array("a", "b", F.lit("2002-03-01").cast("date"))).alias("d"))
    return dims.extended_calendar(_calendar(spark, sf_dir), bounds).agg(F.count("*").alias("days"), F.min("full_date").alias("first_day"), F.max("full_date").alias("last_day"))


@query("SELECT DISTINCT r_name AS region, n_name AS state, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS zip_code FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def dim_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = _stores(spark, sf_dir).select(F.col("region"), "state", F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("zip_code"))
    empty = spark.createDataFrame([], "geography_key bigint, region string, state string, city string, zip_code string")
    found = shops.distinct()
    return dims.insert_only(found, dims.insert_only(found.where("region = 'ASIA'"), empty, ["region", "state", "city", "zip_code"], "geography_key"), ["region", "state", "city", "zip_code"], "geography_key").drop("geography_key")


@query("SELECT DISTINCT p_type AS category_name FROM part")
def dim_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "category_key bigint, category_name string")
    return dims.insert_only(dims.categories(adapt.products(spark, sf_dir)), empty, ["category_name"], "category_key").drop("category_key")


@query("SELECT DISTINCT p_type AS category_name, p_type || '-' || p_brand AS subcategory_name FROM part")
def dim_subcategory(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = adapt.products(spark, sf_dir).withColumnRenamed("subcategory_key", "subcategory")
    main = keys.with_small_keys(dims.categories(goods), "category_key", ["category_name"])
    empty = spark.createDataFrame([], "subcategory_key bigint, category_key bigint, subcategory_name string")
    return dims.insert_only(dims.subcategories(goods, main), empty, ["category_key", "subcategory_name"], "subcategory_key").join(main, "category_key").select("category_name", "subcategory_name")


_STATES = [s for states in REGION_STATES.values() for s in states] + ["XX", " tx ", "ny"]


@query(f"SELECT state, {oracle.region_of_state('state')} AS region FROM (VALUES {', '.join(f'({s!r})' for s in _STATES)}, (NULL)) t(state)")
def region_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in [*_STATES, None]], "state string").select("state", region_of_state("state").alias("region"))


# --- Versions ---------------------------------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """The customers after two loads, of which the second changes every tenth.

    A first transaction from ``until`` on counts as none yet, as for a load that runs at that moment.
    """
    seen = adapt.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_seen"))
    if until:
        seen = seen.withColumn("first_seen", F.when(F.col("first_seen") < F.lit(until).cast("date"), F.col("first_seen")))
    people = adapt.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("loyalty_tier"))
    first = people.join(seen, F.col("customer_id") == F.col("o_custkey"), "left").drop("o_custkey")
    second = first.withColumn("loyalty_tier", F.when(F.col("customer_id") % 10 == 0, "CHANGED").otherwise(F.col("loyalty_tier")))
    empty = spark.createDataFrame([], "customer_key bigint, customer_id bigint, loyalty_tier string, effective_from timestamp, effective_to timestamp, is_current boolean, attribute_hash string")
    once = scd2.merge_scd2(first, empty, "customer_id", "customer_key", ["loyalty_tier"], FIRST_LOAD, "first_seen")
    return scd2.merge_scd2(second, once, "customer_id", "customer_key", ["loyalty_tier"], AS_OF, "first_seen")


@query(f"WITH {oracle.SCD2} SELECT * FROM versions")
def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("customer_id", "loyalty_tier", F.to_date("effective_from").alias("valid_from"), F.to_date("effective_to").alias("valid_to"), "is_current")


@query("SELECT c_custkey AS customer_id, c_custkey % 10 = 0 AS known FROM customer WHERE c_custkey % 10 = 0")
def scd2_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _versions(spark, sf_dir)
    people = adapt.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("loyalty_tier"))
    return scd2.changes(people, held, "customer_id", ["loyalty_tier"]).select("customer_id", F.col("_known").alias("known"))


@query("""
WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 30 DAY ELSE coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '9998-12-31') END AS e FROM events)
SELECT a.user_id, a.event_id AS version_key, b.event_id AS next_key FROM v a JOIN v b ON a.user_id = b.user_id AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND b.ts < a.e""")
def scd2_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapt.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    held = scd2.versions_from_log(log, ["user_id"], "ts", ["event_id"])
    spoiled = held.withColumn("effective_to", F.when(F.col("event_id") % 50 == 0, F.expr("effective_from + interval 30 day")).otherwise(F.col("effective_to")))
    return scd2.overlaps(spoiled, "user_id", "event_id")


@query("SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS starts, strftime(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '9998-12-31'), '%Y-%m-%d %H:%M:%S') AS ends, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS is_current FROM events")
def change_log_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scd2.versions_from_log(adapt.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"])
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return held.select("user_id", "event_id", text("effective_from").alias("starts"), text("effective_to").alias("ends"), "is_current")


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("invoice_date"))


@query(f"WITH {oracle.SCD2} SELECT o_orderkey AS invoice_id, loyalty_tier FROM orders LEFT JOIN versions ON customer_id = o_custkey AND CAST(o_orderdate AS DATE) >= valid_from AND CAST(o_orderdate AS DATE) < valid_to")
def asof_fact_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.as_of_join(_dated_orders(spark, sf_dir), _versions(spark, sf_dir), "customer_id", "invoice_date", ["loyalty_tier"]).select("invoice_id", "loyalty_tier")


@query(f"WITH {oracle.SCD2} SELECT matches, count(*) AS invoices FROM (SELECT o_orderkey, count(customer_id) AS matches FROM orders LEFT JOIN versions ON customer_id = o_custkey AND CAST(o_orderdate AS DATE) >= valid_from AND CAST(o_orderdate AS DATE) < valid_to GROUP BY 1) GROUP BY 1")
def asof_match_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.as_of_matches(_dated_orders(spark, sf_dir), _versions(spark, sf_dir), "customer_id", "invoice_date", ["invoice_id"]).groupBy("matches").agg(F.count("*").alias("invoices"))


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END AS customer_key, count(*) AS invoices FROM orders GROUP BY 1")
def anonymous_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = _dated_orders(spark, sf_dir).withColumn("customer_id", F.when(F.col("invoice_id") % 7 != 0, F.col("customer_id")))
    people = _versions(spark, sf_dir).withColumn("source_key", F.col("customer_id"))
    resolved = scd2.as_of_join(sold, people, "customer_id", "invoice_date", ["source_key"])
    key = F.when(F.col("customer_id").isNull(), F.lit(-1).cast("bigint")).otherwise(F.col("source_key"))
    return resolved.groupBy(key.alias("customer_key")).agg(F.count("*").alias("invoices"))


# --- Data quality -----------------------------------------------------------------------------------------


def _joined(codes: str = rules.CODES) -> F.Column:
    return F.array_join(codes, ";")


def _evaluated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return silver.evaluate(adapt.bronze(spark, sf_dir), _held)


def _held(name: str, df: DataFrame) -> DataFrame:
    """Kept on the executors' disks, so that headers and lines are judged once for all that reads them."""
    return df.persist(StorageLevel.DISK_ONLY)


def _with_lineage(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The faulty tables with a row id that follows from their columns."""
    out = {}
    for name, df in adapt.bronze(spark, sf_dir).items():
        out[name] = df.withColumns({"_source_row_id": F.md5(F.concat_ws("|", F.lit(name), *SOURCE[name]).cast("binary")), "_source_file_name": F.lit(f"{name}_2024_01_01_part-00000.parquet")})
    return out


def _quarantine(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: silver.quarantined(df, name, "2024-01-02 03:04:05") for name, df in silver.evaluate(_with_lineage(spark, sf_dir), _held).items()}


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dqmart.issues(dqmart.all_quarantined(_quarantine(spark, sf_dir)))


_ISSUES = f"WITH {oracle.issues_sql(SOURCE)}"


def _evaluated_sql(columns: str, table: str) -> str:
    return f"WITH {oracle.EVALUATED} SELECT {columns} FROM {table}"


@query(_evaluated_sql("customer_id, first_name, array_to_string(codes, ';') AS codes, CAST(coalesce(try_strptime(join_date, '%m/%d/%Y')) AS DATE) AS join_date", "e_customers"))
def dq_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.evaluate_dimension(adapt.bronze(spark, sf_dir)["customers"], "customers").select("customer_id", "first_name", _joined().alias("codes"), F.col("_join_date").alias("join_date"))


@query(_evaluated_sql(f"product_id, product_name, array_to_string(codes, ';') AS codes, {oracle.parsed_decimal('unit_price')} AS unit_price, {oracle.parsed_decimal('cost')} AS cost, {oracle.parsed_boolean('is_active')} AS is_active", "e_products"))
def dq_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = silver.evaluate_dimension(adapt.bronze(spark, sf_dir)["products"], "products")
    return out.select("product_id", "product_name", _joined().alias("codes"), F.col("_unit_price").alias("unit_price"), F.col("_cost").alias("cost"), F.col("_is_active").alias("is_active"))


@query(_evaluated_sql(f"store_id, store_name, array_to_string(codes, ';') AS codes, {oracle.parsed_long('square_footage')} AS square_footage", "e_stores"))
def dq_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = silver.evaluate_dimension(adapt.bronze(spark, sf_dir)["stores"], "stores")
    return out.select("store_id", "store_name", _joined().alias("codes"), F.col("_square_footage").alias("square_footage"))


@query(_evaluated_sql("invoice_id, store_id, customer_id, array_to_string(direct, ';') AS direct_codes, array_to_string(codes, ';') AS codes, item_count, invalid_item_count", "e_invoices"))
def dq_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)["invoices"].select("invoice_id", "store_id", "customer_id", _joined("_direct_codes").alias("direct_codes"), _joined().alias("codes"), "item_count", "invalid_item_count")


@query(_evaluated_sql("invoice_id, line_item, product_id, quantity, array_to_string(direct, ';') AS direct_codes, array_to_string(codes, ';') AS codes", "e_items"))
def dq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)["invoice_items"].select("invoice_id", "line_item", "product_id", "quantity", _joined("_direct_codes").alias("direct_codes"), _joined().alias("codes"))


@query("SELECT invoice_id, copies FROM (SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, 2 AS copies, o_orderkey AS k FROM orders) WHERE k % 401 = 0".replace("2 AS copies", "CAST(2 AS BIGINT) AS copies"))
def dq_duplicates_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.checks import duplicates

    return duplicates(adapt.bronze(spark, sf_dir)["invoices"].where(rules.not_blank("invoice_id")), ["invoice_id"])


@query("SELECT l_orderkey AS invoice_id, CAST(l_linenumber AS BIGINT) AS line_item, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicates_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.checks import duplicates

    source = adapt.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").cast("bigint").alias("line_item"))
    return duplicates(source, ["invoice_id", "line_item"])


@query("SELECT invoice_id, customer_id, CASE WHEN c_custkey IS NULL THEN 'INVALID_CUSTOMER_REFERENCE' ELSE '' END AS codes FROM (SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, CAST(CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS VARCHAR) AS customer_id FROM orders) LEFT JOIN customer ON customer_id = CAST(c_custkey AS VARCHAR)")
def dq_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 101 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey"))
    heads = adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("invoice_id"), key.cast("string").alias("customer_id"), F.array().cast("array<string>").alias(rules.CODES))
    people = adapt.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_ref"))
    return rules.with_reference(heads, "customer_id", people, "INVALID_CUSTOMER_REFERENCE").select("invoice_id", "customer_id", _joined().alias("codes"))


@query(_evaluated_sql("len(direct) = 0 AS header_ok, item_count > 0 AS has_items, invalid_item_count = 0 AS items_ok, len(codes) = 0 AS valid, count(*) AS invoices", "e_invoices") + " GROUP BY ALL")
def invoice_atomicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _evaluated(spark, sf_dir)["invoices"]
    return heads.groupBy((F.size("_direct_codes") == 0).alias("header_ok"), (F.col("item_count") > 0).alias("has_items"), (F.col("invalid_item_count") == 0).alias("items_ok"), (F.size(rules.CODES) == 0).alias("valid")).agg(F.count("*").alias("invoices"))


@query(_evaluated_sql(f"invoice_id, store_id, customer_id, {oracle.parsed_date('invoice_date')} AS invoice_date, payment_method", "e_invoices") + " WHERE len(codes) = 0")
def silver_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.clean(_evaluated(spark, sf_dir)["invoices"], "invoices")


@query(_evaluated_sql(f"invoice_id, n_line AS line_item, product_id, {oracle.parsed_long('quantity')} AS quantity, {oracle.parsed_decimal('unit_price')} AS unit_price, {oracle.parsed_decimal('discount')} AS discount", "e_items") + " WHERE len(codes) = 0")
def silver_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.clean(_evaluated(spark, sf_dir)["invoice_items"], "invoice_items")


@query(_evaluated_sql("invoice_id, line_item AS line_item_raw, product_id, quantity AS quantity_raw, discount AS discount_raw, array_to_string(codes, ';') AS error_code", "e_items") + " WHERE len(codes) > 0")
def quarantine_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = silver.quarantined(_evaluated(spark, sf_dir)["invoice_items"], "invoice_items", AS_OF)
    return out.select("invoice_id", "line_item_raw", "product_id", "quantity_raw", "discount_raw", F.col("_dq_error_code").alias("error_code"))


@query(f"WITH {oracle.EVALUATED} SELECT code, count(*) AS n_rows FROM (SELECT unnest(codes) AS code FROM e_invoices) GROUP BY code")
def dq_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.reason_counts(_evaluated(spark, sf_dir)["invoices"])


@query(f"WITH {oracle.EVALUATED} SELECT code, count(*) AS n_rows FROM (SELECT unnest(direct) AS code FROM e_items) GROUP BY code")
def dq_item_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.reason_counts(_evaluated(spark, sf_dir)["invoice_items"], "_direct_codes")


def _pct(a: str, b: str) -> str:
    return oracle.ratio(f"CAST({a} AS HUGEINT) * 100", b, "DECIMAL(18,4)")


@query(f"""
WITH {oracle.EVALUATED}, h AS (
  SELECT count(*) AS total_invoices, count(*) FILTER (len(codes) = 0) AS valid_invoices, count(*) FILTER (len(codes) > 0) AS invalid_invoices,
         count(*) FILTER (len(direct) > 0 OR item_count = 0) AS header_or_empty_invalid, count(*) FILTER (invalid_item_count > 0) AS invoices_with_bad_item,
         count(*) FILTER ((len(direct) > 0 OR item_count = 0) AND invalid_item_count > 0) AS both_reasons, count(*) FILTER (invalid_item_count > 0 AND NOT (len(direct) > 0 OR item_count = 0)) AS only_bad_item,
         count(*) FILTER (item_count = 0) AS empty_invoices, count(*) FILTER (list_contains(codes, 'INVALID_CUSTOMER_REFERENCE')) AS bad_customer_reference, count(*) FILTER (customer_id IS NULL) AS anonymous_invoices FROM e_invoices),
t AS (
  SELECT count(*) AS total_items, count(*) FILTER (len(codes) = 0) AS valid_items, count(*) FILTER (len(codes) > 0) AS invalid_items, count(*) FILTER (len(direct) > 0) AS direct_bad_items,
         count(*) FILTER (len(direct) = 0 AND len(codes) > 0) AS cascaded_items FROM e_items)
SELECT *, invalid_invoices = header_or_empty_invalid + invoices_with_bad_item - both_reasons AS overlap_ok FROM h, t""")
def dq_impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _evaluated(spark, sf_dir)
    out = silver.impact_summary(ready["invoices"], ready["invoice_items"])
    return out.select(*(c for c in out.columns if not c.endswith("_pct") and c != "amplification"))


@query(f"{_ISSUES} SELECT source_table, source_row_id, dq_error_code FROM issues")
def dq_issue_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select("source_table", "source_row_id", "dq_error_code")


@query(f"{_ISSUES} SELECT source_table, array_to_string(codes, ';') AS dq_error_code, count(*) AS issues FROM (SELECT 'invoices' AS source_table, codes FROM e_invoices UNION ALL SELECT 'invoice_items', codes FROM e_items UNION ALL SELECT 'customers', codes FROM e_customers UNION ALL SELECT 'products', codes FROM e_products UNION ALL SELECT 'stores', codes FROM e_stores) WHERE len(codes) > 0 GROUP BY ALL")
def dq_issue_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dqmart.issues(dqmart.all_quarantined(_quarantine(spark, sf_dir)), each_code=False)
    return rows.groupBy("source_table", "dq_error_code").agg(F.count("*").alias("issues"))


@query(f"{_ISSUES} SELECT DISTINCT source_table, dq_error_code, severity FROM issues")
def dq_rule_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dqmart.rules_of(_issues(spark, sf_dir)).select("source_table", "dq_error_code", "severity")


@query(f"{_ISSUES} SELECT 20240102 AS dq_date_key, source_table, source_table || '_2024_01_01_part-00000.parquet' AS source_file_name, dq_error_code, severity, 'QUARANTINED' AS dq_status, count(*) AS dq_issue_count, count(DISTINCT source_row_id) AS affected_record_count FROM issues GROUP BY ALL")
def dq_daily_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, named = _issues(spark, sf_dir), dqmart.catalogue(spark)
    day = dims.calendar_between(spark.sql("select date'2024-01-01' as lo, date'2024-01-31' as hi"))
    out = dqmart.daily(dqmart.with_rule_keys(found, named), named, day)
    return out.join(named.select("dq_rule_key", "dq_error_code"), "dq_rule_key").drop("dq_rule_key", "geography_key")


@query(f"""
WITH {oracle.EVALUATED}, a AS (SELECT 'invoices' AS source_table, codes FROM e_invoices UNION ALL SELECT 'invoice_items', codes FROM e_items UNION ALL SELECT 'customers', codes FROM e_customers UNION ALL SELECT 'products', codes FROM e_products UNION ALL SELECT 'stores', codes FROM e_stores)
SELECT 20240102 AS evaluation_date_key, source_table, source_table || '_2024_01_01_part-00000.parquet' AS source_file_name, CAST(-1 AS BIGINT) AS geography_key, count(*) AS total_records, count(*) FILTER (len(codes) = 0) AS valid_records, count(*) FILTER (len(codes) > 0) AS incorrect_records FROM a GROUP BY source_table""")
def dq_record_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = silver.evaluate(_with_lineage(spark, sf_dir), _held)
    good = {name: silver.clean(df, name).withColumn("_source_file_name", F.lit(f"{name}_2024_01_01_part-00000.parquet")) for name, df in ready.items()}
    return dqmart.record_snapshot(good, {name: silver.quarantined(df, name, AS_OF) for name, df in ready.items()}, "2024-01-02")


@query(f"{_ISSUES}, c AS (SELECT dq_error_code, count(*) AS issues FROM issues GROUP BY 1), r AS (SELECT *, CAST(sum(issues) OVER (ORDER BY issues DESC, dq_error_code ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(sum(issues) OVER () AS BIGINT) AS whole FROM c) SELECT dq_error_code, issues, {oracle.ratio('running', 'whole')} AS cumulative_share FROM r")
def dq_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.pareto(_issues(spark, sf_dir).groupBy("dq_error_code").agg(F.count("*").alias("issues")), "dq_error_code", "issues")


@query(f"{_ISSUES} SELECT source_table, severity, count(*) AS issues, count(DISTINCT source_row_id) AS affected_records FROM issues GROUP BY ALL")
def dq_by_table_and_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.issues_by(_issues(spark, sf_dir).join(dqmart.catalogue(spark), ["source_table", "dq_error_code"]), "source_table", "severity")


@query(f"{_ISSUES} SELECT source_table, source_row_id, source_table || '_2024_01_01_part-00000.parquet' AS source_file_name, dq_error_code, dq_error_code AS dq_rule_name, severity, 'QUARANTINED' AS dq_status FROM issues")
def dq_remediation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, named = _issues(spark, sf_dir), dqmart.catalogue(spark)
    return kpis.remediation(dqmart.with_rule_keys(found, named), named).drop("source_payload_json")


@query(f"""
WITH {oracle.EVALUATED}, a AS (SELECT codes FROM e_invoices UNION ALL SELECT codes FROM e_items UNION ALL SELECT codes FROM e_customers UNION ALL SELECT codes FROM e_products UNION ALL SELECT codes FROM e_stores),
t AS (SELECT count(*) AS total_records, count(*) FILTER (len(codes) > 0) AS incorrect_records FROM a)
SELECT *, CAST(1 - incorrect_rate AS DECIMAL(18,6)) AS quality_rate FROM (SELECT *, {oracle.ratio("incorrect_records", "total_records")} AS incorrect_rate FROM t)""")
def dq_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.dq_rates(dq_record_snapshot(spark, sf_dir))


# --- Expressions ------------------------------------------------------------------------------------------

_DATES = ["2024-01-02", "2024-01-02 06:07:00", "2024-01-02 06:07:00.123456", "2024-01-02T06:07:00", "2024-01-02T06:07:00.123456", "01/31/2024", " 2024-02-29 ", "2023-02-29", "2025-13-40", "2024-1-2", "", "x"]
_NUMBERS = ["12", " 12.345 ", "12.7", "-0.5", "1e3", "abc", "$5", "", "99999999999999999999", "+7"]
_WORDS = ["true", "T", "1", " yes", "y", "False", "f", "0", "NO", "n", "maybe", ""]


def _values(items: list[str]) -> str:
    return ", ".join(f"('{x}')" for x in items) + ", (NULL)"


def _frame(spark: SparkSession, items: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in [*items, None]], "raw string")


@query(f"SELECT raw, {oracle.parsed_date('raw')} AS parsed FROM (VALUES {_values(_DATES)}) t(raw)")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, _DATES).select("raw", parse_date("raw").alias("parsed"))


@query(f"SELECT raw, {oracle.parsed_decimal('raw')} AS parsed FROM (VALUES {_values(_NUMBERS)}) t(raw)")
def parse_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, _NUMBERS).select("raw", parse_decimal("raw").alias("parsed"))


@query(f"SELECT raw, {oracle.parsed_long('raw')} AS parsed FROM (VALUES {_values(_NUMBERS)}) t(raw)")
def parse_longs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, _NUMBERS).select("raw", parse_long("raw").alias("parsed"))


@query(f"SELECT raw, {oracle.parsed_boolean('raw')} AS parsed FROM (VALUES {_values(_WORDS)}) t(raw)")
def parse_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, _WORDS).select("raw", parse_boolean("raw").alias("parsed"))


# --- Relational operators ---------------------------------------------------------------------------------


@query("SELECT count(*) AS headers, (SELECT count(*) FROM lineitem) AS lines, sum(o_orderkey)::BIGINT AS key_sum FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def header_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.files import split_sales

    raw = adapt.table(spark, sf_dir, "lineitem").join(adapt.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    heads, rows = split_sales(raw, ["o_orderkey", "o_custkey", "o_orderpriority"], ["l_orderkey", "l_linenumber", "l_partkey"])
    counted = heads.agg(F.count("*").alias("headers"), F.sum("o_orderkey").alias("key_sum"))
    return beside(counted, rows.agg(F.count("*").alias("lines"))).select("headers", "lines", "key_sum")


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    frames = [adapt.table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("orders", "lineitem", "customer", "part", "supplier")]
    return reduce(DataFrame.unionByName, frames)


@query(f"WITH {oracle.EVALUATED} SELECT invoice_id FROM e_invoices WHERE len(codes) = 0 INTERSECT SELECT invoice_id FROM e_invoices WHERE len(codes) > 0")
def intersect_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _evaluated(spark, sf_dir)["invoices"]
    return heads.where(F.size(rules.CODES) == 0).select("invoice_id").intersect(heads.where(F.size(rules.CODES) > 0).select("invoice_id"))


@query("SELECT c_custkey, c_name FROM customer")
def anti_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = adapt.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    held = people.where("c_custkey % 3 = 0")
    return held.unionByName(missing_rows(people, held, ["c_custkey"]))


@query("SELECT DISTINCT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS state, n_regionkey FROM nation WHERE NOT (n_regionkey = 1 OR (n_nationkey % 4 = 0 AND n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 8 = 0)))")
def nullsafe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapt.table(spark, sf_dir, "nation").withColumn("state", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")))
    held = n.where("n_regionkey = 1 or n_nationkey % 8 = 0")
    held = held.where("n_regionkey = 1 or state is null")
    return missing_rows(n.select("state", "n_regionkey"), held.select("state", "n_regionkey"), ["state", "n_regionkey"]).distinct()


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = adapt.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    target, source = people.where("c_custkey % 2 = 0"), people.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("MOVED"))
    return merged(target, source, ["c_custkey"])


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 AND n_regionkey <> 2 THEN 2 ELSE n_regionkey END AS n_regionkey, n_nationkey % 3 = 0 AND n_regionkey <> 2 AS repaired FROM nation")
def merge_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapt.table(spark, sf_dir, "nation").withColumn("repaired", F.lit(False))
    source = n.where("n_nationkey % 3 = 0").withColumns({"n_regionkey": F.lit(2), "repaired": F.lit(True)})
    return merged(n, source, ["n_nationkey"], update=["n_regionkey", "repaired"], when="not (t.n_regionkey <=> s.n_regionkey)")


@query("SELECT count(*) AS n, min(k) AS lo, max(k) AS hi, CAST(sum(k * (l_orderkey % 97)) AS BIGINT) AS mixed FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, rn) + 1000 AS k FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS rn FROM lineitem))")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = keys.with_keys(adapt.numbered_lines(spark, sf_dir).select("l_orderkey", "line_item"), "k", ["l_orderkey", "line_item"], after=1000)
    return numbered.agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.expr("k * (l_orderkey % 97)")).alias("mixed"))


# --- Reconciliation ---------------------------------------------------------------------------------------


@query(f"""
WITH {oracle.EVALUATED}, a AS (SELECT 'invoices' AS t, codes FROM e_invoices UNION ALL SELECT 'invoice_items', codes FROM e_items UNION ALL SELECT 'customers', codes FROM e_customers UNION ALL SELECT 'products', codes FROM e_products UNION ALL SELECT 'stores', codes FROM e_stores)
SELECT t AS table_name, count(*) AS bronze_rows, count(*) FILTER (len(codes) = 0) AS clean_rows, count(*) FILTER (len(codes) > 0) AS quarantine_rows, true AS adds_up FROM a GROUP BY t""")
def recon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = adapt.bronze(spark, sf_dir)
    ready = silver.evaluate(source, _held)
    return reconcile.bronze_split(source, {k: silver.clean(v, k) for k, v in ready.items()}, {k: silver.quarantined(v, k, AS_OF) for k, v in ready.items()})


@query(_with("SELECT date_key, store_key FROM sales WHERE store_key % 10 = 3 GROUP BY ALL"))
def recon_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = _sales(spark, sf_dir)
    right = sold.groupBy("date_key", "store_key").agg(*aggregates._sums())
    wrong = right.withColumn("revenue", F.when(F.col("store_key") % 10 == 3, F.col("revenue") + 1).otherwise(F.col("revenue")).cast(MONEY_SUM))
    return reconcile.aggregate_difference(right, wrong, ["date_key", "store_key"], aggregates.MEASURES)


@query("SELECT DISTINCT o_custkey AS customer_key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)")
def recon_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = adapt.table(spark, sf_dir, "customer").where("c_custkey % 11 != 0")
    return reconcile.orphans(adapt.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_key")), "customer_key", people, "c_custkey")


from . import queries_load  # noqa: E402,F401  registers its queries beside these
