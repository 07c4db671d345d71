"""Queries of the load path, facts, further reconciliations and quality dashboards, with their SQL."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, checks, dims, dqmart, facts, keys, reconcile, scd2, silver
from .operators.store import TableStore
from .plans import kpis, oracle
from .plans.schemas import GOLD
from .queries import _ISSUES, AS_OF, FIRST_LOAD, _calendar, _dated_orders, _evaluated, _issues, _sales, _versions, _with, _with_lineage, query
from .sources import adapt, files
from .streaming import ingest

_DAYS = (dt.date(2024, 1, 1), dt.date(2024, 1, 2))


# --- Load path --------------------------------------------------------------------------------------------


def _lake(spark: SparkSession) -> str:
    """A new folder for a query's tables: below the shared folder, or a temporary one of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(base or tempfile.mkdtemp(prefix='shelfmark-')).rstrip('/')}/lake-{uuid.uuid4().hex}"


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[TableStore, list[tuple[int, int, int]]]:
    """Orders as invoices of two days, loaded in three runs: the first day, the second day, nothing new."""
    root = _lake(spark)
    store, raw = TableStore(spark, f"{root}/tables"), f"{root}/raw"
    text = lambda c: F.col(c).cast("string")
    sold = adapt.table(spark, sf_dir, "orders").select("o_orderkey", text("o_orderkey").alias("invoice_id"), F.lit("1").alias("store_id"), text("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").cast("string").alias("invoice_date"), F.col("o_orderpriority").alias("payment_method"))
    runs = []
    for number, share in enumerate(("o_orderkey % 2 = 0", "o_orderkey % 2 != 0", None), 1):
        if share:
            files.write_parts(sold.where(share).drop("o_orderkey").coalesce(1), raw, "invoices", _DAYS[number - 1], rows_per_file=10**9)
        new = ingest.ingest(spark, store, raw, "invoices", AS_OF)
        runs.append((number, len(new), store.read("bronze/invoices").count()))
    return store, runs


@query("""
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'invoices_2024_01_01_part-00000.parquet' ELSE 'invoices_2024_01_02_part-00000.parquet' END AS _source_file_name, count(*) AS rows, count(*) AS row_ids,
       CAST(sum(o_custkey) AS BIGINT) AS customers, '2000-07-01 00:00:00' AS inserted FROM orders GROUP BY 1""")
def bronze_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _loaded(spark, sf_dir)[0].read("bronze/invoices")
    inserted = F.date_format(F.min("_insert_datetime_utc"), "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy("_source_file_name").agg(F.count("*").alias("rows"), F.count_distinct("_source_row_id").alias("row_ids"), F.sum(F.col("customer_id").cast("bigint")).alias("customers"), inserted.alias("inserted"))


@query("SELECT 1 AS run, 1 AS new_files, count(*) FILTER (o_orderkey % 2 = 0) AS rows FROM orders UNION ALL SELECT 2, 1, count(*) FROM orders UNION ALL SELECT 3, 0, count(*) FROM orders")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_loaded(spark, sf_dir)[1], "run int, new_files int, rows bigint")


@query("SELECT 'invoices' AS table_name, s AS status, CAST(2 AS BIGINT) AS files FROM (VALUES ('STARTED'), ('SUCCESS')) t(s)")
def processed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)[0].read(ingest.LOG).groupBy("table_name", "status").agg(F.count_distinct("source_file_path").alias("files"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM orders")
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TableStore(spark, _lake(spark))
    sold = adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    store.overwrite("t", sold.where("k % 3 = 0").withColumn("v", F.lit("old")))
    store.append_new("t", sold.where("k % 2 = 0").withColumn("v", F.lit("old")), ["k"])
    store.append("t", sold.where("k % 3 != 0 and k % 2 != 0").withColumn("v", F.lit("old")))
    out = store.merge("t", sold.where("k % 4 = 0").withColumn("v", F.lit("new")), ["k"])
    store.vacuum("t")
    return out


# --- Facts and keys ---------------------------------------------------------------------------------------

_CUSTOMER_KEYS = f"{oracle.SCD2}, first_keys AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer)"


@query(f"""
WITH {_CUSTOMER_KEYS}
SELECT o_orderkey AS invoice_id, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
       CASE WHEN o_orderkey % 7 = 0 THEN -1 WHEN o_custkey % 10 = 0 AND o_orderdate >= DATE '2000-07-01' THEN (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer c WHERE c.c_custkey % 10 = 0 AND c.c_custkey <= o_custkey) ELSE k END AS customer_key, s_suppkey + 100 AS store_key, o_orderpriority AS payment_method
FROM orders LEFT JOIN first_keys ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)""")
def fact_invoice_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = adapt.invoices(spark, sf_dir)
    sold = heads.select("invoice_id", F.col("store_key").alias("store_id"), F.when(F.col("invoice_id") % 7 != 0, F.col("customer_key")).alias("customer_id"), "invoice_date", "payment_method")
    always = {"effective_from": F.lit("1900-01-01").cast("timestamp"), "effective_to": F.lit("9998-12-31").cast("timestamp")}
    shops = adapt.stores(spark, sf_dir).select(F.col("store_key").alias("store_id"), (F.col("store_key") + 100).alias("store_key")).withColumns(always)
    return facts.resolve_invoices(sold, _calendar(spark, sf_dir), shops, _versions(spark, sf_dir))


@query("""
SELECT l_orderkey + 5 AS invoice_key, l_orderkey AS invoice_id, CASE WHEN l_partkey % 10 = 0 AND o_orderdate >= DATE '1995-01-01' THEN l_partkey + 1000000 ELSE l_partkey END AS product_key, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS units
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def fact_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapt.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("invoice_id"), "line_item", F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"), F.lit(1).alias("unit_price"), F.lit(0).alias("discount"))
    part = adapt.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))
    day = lambda d: F.lit(d).cast("timestamp")
    changed = F.col("product_id") % 10 == 0
    old = part.select("product_id", F.col("product_id").alias("product_key"), day("1900-01-01").alias("effective_from"), F.when(changed, day("1995-01-01")).otherwise(day("9998-12-31")).alias("effective_to"))
    new = part.where(changed).select("product_id", (F.col("product_id") + 1_000_000).alias("product_key"), day("1995-01-01").alias("effective_from"), day("9998-12-31").alias("effective_to"))
    heads = adapt.invoices(spark, sf_dir)
    lines = facts.resolve_lines(items, heads, heads.select("invoice_id", (F.col("invoice_id") + 5).alias("invoice_key")), old.unionByName(new))
    return lines.groupBy("invoice_key", "invoice_id", "product_key").agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"))


@query("""
WITH held AS (SELECT o_orderkey, 2 * o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey AS invoice_id, k AS invoice_key FROM held
UNION ALL SELECT o_orderkey, (SELECT max(k) FROM held) + row_number() OVER (ORDER BY o_orderkey) FROM orders WHERE o_orderkey % 3 <> 0""")
def key_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"))
    held = sold.where("invoice_id % 3 = 0").withColumn("invoice_key", F.expr("2 * invoice_id"))
    return facts.carry_keys(sold, held, ["invoice_id"], "invoice_key")


@query(f"WITH {_CUSTOMER_KEYS} SELECT c_custkey AS customer_id, k AS customer_key FROM first_keys UNION ALL SELECT c_custkey, (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY c_custkey) FROM customer WHERE c_custkey % 10 = 0")
def scd2_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("customer_id", "customer_key")


@query("SELECT o_custkey AS customer_id, min(CAST(o_orderdate AS DATE)) AS first_seen, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def first_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated_orders(spark, sf_dir).groupBy("customer_id").agg(F.min("invoice_date").alias("first_seen"), F.max("invoice_id").alias("last_key"))


@query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS category_key, r_name AS category_name FROM region UNION ALL SELECT -1, 'Unknown'")
def default_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = adapt.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("category_key"), F.col("r_name").alias("category_name"))
    member = dims.default_member(spark, GOLD["dim_category"], "category_key")
    return dims.with_default(dims.with_default(held, "category_key", member), "category_key", member)


@query("""
SELECT c_custkey AS customer_id, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS BIGINT) END AS geography_key
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def geography_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapt.table(spark, sf_dir, "nation").join(adapt.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = [F.initcap("r_name").alias("region"), F.col("n_name").alias("state"), F.lit(None).cast("string").alias("city"), F.col("n_nationkey").cast("string").alias("zip_code")]
    known = n.where("n_nationkey % 5 != 0").select(F.col("n_nationkey").cast("bigint").alias("geography_key"), *place)
    moved = F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey").cast("string"))
    people = adapt.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.col("r_name").alias("source_region"), F.col("n_name").alias("state"), F.lit(None).cast("string").alias("city"), moved.alias("zip_code"))
    return dims.lookup_geography(people, known, "source_region").select("customer_id", "geography_key")


# --- Reconciliation ---------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM orders) AS n_left, (SELECT count(*) FROM orders WHERE o_orderkey % 13 <> 0) AS n_right")
def recon_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = adapt.table(spark, sf_dir, "orders")
    return reconcile.count_difference(sold, sold.where("o_orderkey % 13 != 0"))


@query("SELECT o_orderkey AS invoice_id, CAST(2 AS BIGINT) AS copies FROM orders WHERE o_orderkey % 17 = 0")
def recon_fact_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"))
    return checks.duplicates(sold.unionByName(sold.where("invoice_id % 17 = 0")), ["invoice_id"])


@query("""
SELECT 'empty_interval' AS check_name, count(*) = 0 AS passed, count(*) AS offending_rows FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 19 = 0
UNION ALL SELECT 'not_one_current', count(*) = 0, count(*) FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 23 = 0
UNION ALL SELECT 'overlap', count(*) = 0, count(*) FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 3 = 0""")
def recon_scd2_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A version that starts after the load that closes it is itself a fault; here only the planted ones may be found.
    versions = _versions(spark, sf_dir, until=FIRST_LOAD)
    i = F.col("customer_id")
    single, closed = i % 10 != 0, (i % 10 == 0) & ~F.col("is_current")
    spoiled = versions.withColumns(
        {
            "effective_to": F.when(single & (i % 19 == 0), F.col("effective_from")).when(closed & (i % 3 == 0), F.lit("9998-12-31").cast("timestamp")).otherwise(F.col("effective_to")),
            "is_current": F.when(single & (i % 23 == 0), False).otherwise(F.col("is_current")),
        }
    )
    return reconcile.report(scd2.faults(spoiled, "customer_id", "customer_key"))


@query("SELECT o_orderkey AS invoice_id, -1 AS customer_key FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0")
def recon_default_for_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = _dated_orders(spark, sf_dir)
    source = sold.withColumn("customer_id", F.when(F.col("invoice_id") % 7 != 0, F.col("customer_id")))
    held = sold.select("invoice_id", F.when((F.col("invoice_id") % 5 == 0) | (F.col("invoice_id") % 7 == 0), -1).otherwise(1).alias("customer_key"))
    return reconcile.default_for_known(source, "customer_id", held, "customer_key")


@query(_with("SELECT date_key, store_key, CAST(2 AS BIGINT) AS copies FROM (SELECT DISTINCT date_key, store_key FROM sales WHERE store_key % 10 = 3)"))
def recon_aggregate_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _sales(spark, sf_dir).groupBy("date_key", "store_key").agg(*aggregates._sums())
    return checks.duplicates(daily.unionByName(daily.where("store_key % 10 = 3")), ["date_key", "store_key"])


@query(_with("SELECT DISTINCT month_date_key + 1 AS month_date_key FROM sales WHERE product_key % 10 = 3"))
def recon_month_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = aggregates.product_monthly(_sales(spark, sf_dir))
    wrong = monthly.withColumn("month_date_key", F.when(F.col("product_key") % 10 == 3, F.col("month_date_key") + 1).otherwise(F.col("month_date_key")))
    return reconcile.not_month_start(wrong, _calendar(spark, sf_dir))


_ALL_CODES = "SELECT 'invoices' AS t, codes FROM e_invoices UNION ALL SELECT 'invoice_items', codes FROM e_items UNION ALL SELECT 'customers', codes FROM e_customers UNION ALL SELECT 'products', codes FROM e_products UNION ALL SELECT 'stores', codes FROM e_stores"


def _split(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    ready = _evaluated(spark, sf_dir)
    return {k: silver.clean(v, k) for k, v in ready.items()}, {k: silver.quarantined(v, k, AS_OF) for k, v in ready.items()}


@query(f"WITH {oracle.EVALUATED} SELECT t AS source_table, count(*) AS total_records, count(*) FILTER (len(codes) = 0) + 1 AS valid_records, count(*) FILTER (len(codes) > 0) AS incorrect_records FROM ({_ALL_CODES}) WHERE t = 'stores' GROUP BY t")
def recon_records_add_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = dqmart.record_snapshot(*_split(spark, sf_dir), "2024-01-02")
    wrong = records.withColumn("valid_records", F.when(F.col("source_table") == "stores", F.col("valid_records") + 1).otherwise(F.col("valid_records")))
    return wrong.where("total_records != valid_records + incorrect_records").select("source_table", "total_records", "valid_records", "incorrect_records")


@query(f"WITH {oracle.EVALUATED} SELECT 'customers' AS source_table, 'UNKNOWN' AS source_file_name")
def recon_dq_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = _split(spark, sf_dir)
    records = dqmart.record_snapshot(good, bad, "2024-01-02")
    wrong = records.withColumn("total_records", F.when(F.col("source_table") == "customers", F.col("total_records") + 1).otherwise(F.col("total_records")))
    return reconcile._population(good, bad, wrong)


@query(f"{_ISSUES} SELECT CAST(count(*) AS BIGINT) AS n, count(*) - count(*) FILTER (source_table = 'stores') AS m FROM issues HAVING count(*) FILTER (source_table = 'stores') > 0")
def recon_issue_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _issues(spark, sf_dir)
    summed = found.groupBy("source_table", "dq_error_code").agg(F.count("*").alias("dq_issue_count"))
    held = found.where("source_table != 'stores'")
    return reconcile.issue_sum(summed, held)


@query("SELECT 'aggregate_grain' AS check_name, true AS passed, CAST(0 AS BIGINT) AS offending_rows UNION ALL SELECT 'fact_grain', true, CAST(0 AS BIGINT) UNION ALL SELECT 'fk_customer', true, CAST(0 AS BIGINT) UNION ALL SELECT 'fk_product', true, CAST(0 AS BIGINT) UNION ALL SELECT 'month_start', true, CAST(0 AS BIGINT)")
def recon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a state without faults."""
    sold, days = _sales(spark, sf_dir), _calendar(spark, sf_dir)
    monthly = aggregates.product_monthly(sold)
    frames = {
        "fact_grain": checks.duplicates(adapt.table(spark, sf_dir, "orders"), ["o_orderkey"]),
        "aggregate_grain": checks.duplicates(monthly, ["month_date_key", "store_key", "product_key"]),
        "month_start": reconcile.not_month_start(monthly, days),
        "fk_customer": reconcile.orphans(adapt.table(spark, sf_dir, "orders"), "o_custkey", adapt.table(spark, sf_dir, "customer"), "c_custkey"),
        "fk_product": reconcile.orphans(adapt.table(spark, sf_dir, "lineitem"), "l_partkey", adapt.table(spark, sf_dir, "part"), "p_partkey"),
    }
    return reconcile.report(frames)


# --- Quality dashboards -----------------------------------------------------------------------------------


@query(f"{_ISSUES} SELECT count(*) AS issues, count(DISTINCT source_table || source_row_id) AS affected_records FROM issues")
def dq_affected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.affected_records(_issues(spark, sf_dir))


_TREND_DAY = "CAST(DATE '2024-01-02' + CAST(instr('0123456789abcdef', substr(source_row_id, 1, 1)) % 5 AS INTEGER) AS DATE)"


@query(f"""
{_ISSUES}, d AS (SELECT {_TREND_DAY} AS day, * FROM issues)
SELECT CAST(s AS DATE) AS full_date, count(source_row_id) AS issues, count(DISTINCT source_table || source_row_id) AS affected_records
FROM unnest(generate_series(DATE '2024-01-01', DATE '2024-01-08', INTERVAL 1 DAY)) t(s) LEFT JOIN d ON day = s GROUP BY 1""")
def dq_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by day of quarantine, days without any included; the rows are dealt over five days by their ids."""
    day = F.expr("date_add(date'2024-01-02', cast(instr('0123456789abcdef', substr(source_row_id, 1, 1)) % 5 as int))")
    found = _issues(spark, sf_dir).withColumn("quarantine_datetime_utc", day.cast("timestamp"))
    return kpis.dq_trend(found, dims.calendar_between(spark.sql("select date'2024-01-01' as lo, date'2024-01-08' as hi")))


@query(f"""
WITH {oracle.EVALUATED}, a AS (SELECT 'stores' AS source_table, state, store_id || store_name || manager_name AS r, unnest(codes) AS code FROM e_stores UNION ALL SELECT 'customers', state, customer_id || first_name || coalesce(join_date, ''), unnest(codes) FROM e_customers)
SELECT source_table, state, count(*) AS issues FROM a GROUP BY ALL""")
def dq_by_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of rows that have a place, by its state."""
    ready = _with_lineage(spark, sf_dir)
    placed = {name: silver.quarantined(silver.evaluate_dimension(ready[name], name), name, AS_OF) for name in ("stores", "customers")}
    return kpis.dq_by_place(dqmart.issues(dqmart.all_quarantined(placed)))


@query(_with(f"""
SELECT store_key, n AS revenue, p AS previous_revenue, {oracle.ratio("n - p", "p")} AS growth FROM (
  SELECT store_key, CAST(coalesce(sum(line_revenue) FILTER (invoice_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'), 0) AS DECIMAL(20,2)) AS n,
         CAST(coalesce(sum(line_revenue) FILTER (invoice_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'), 0) AS DECIMAL(20,2)) AS p
  FROM sales WHERE invoice_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1)"""))
def store_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.growth(_sales(spark, sf_dir).groupBy("date_key", "store_key").agg(*aggregates._sums()), _calendar(spark, sf_dir), "1998-01-01", "1998-12-31", "store_key")


@query("SELECT (SELECT max(o_orderkey) FROM orders) AS largest, (SELECT count(*) = 0 FROM orders WHERE o_orderkey < 0) AS none_negative, least(10, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0)) AS sampled")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest key in use, an emptiness test, and how many rows a failing guard shows."""
    sold = adapt.table(spark, sf_dir, "orders")
    try:
        checks.require_no_rows(sold.where("o_orderkey % 3 = 0").select("o_orderkey"), "orders")
        shown = 0
    except checks.CheckFailed as e:
        shown = str(e).count("o_orderkey")
    return spark.createDataFrame([(keys.next_key(sold, "o_orderkey"), sold.where("o_orderkey < 0").isEmpty(), shown)], "largest bigint, none_negative boolean, sampled bigint")
