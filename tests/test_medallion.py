import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.checks import CheckFailed
from shelfmark.operators.store import TableStore
from shelfmark.plans import medallion
from shelfmark.plans.schemas import SOURCE
from shelfmark.sources import files, synth
from shelfmark.streaming import ingest

DATE = dt.date(2024, 1, 2)
FIRST, SECOND = "2026-01-01 00:00:00", "2026-02-01 00:00:00"


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """A generated source, landed as parts, and a full run over it."""
    raw, root = (str(tmp_path_factory.mktemp(x)) for x in ("raw", "root"))
    heads, lines = synth.headers_and_lines(synth.retail_raw(spark, 400, store_count=6, product_count=40, customer_count=60, fault_every=10))
    tables = {"stores": synth.stores(spark, 6), "products": synth.products(spark, 40), "customers": synth.customers(spark, 60), "invoices": heads, "invoice_items": lines}
    for name, df in tables.items():
        files.write_parts(df.select(*SOURCE[name]), raw, name, DATE, rows_per_file=500)
    report = medallion.run(spark, root, raw, FIRST).collect()
    return {"raw": raw, "root": root, "report": report, "store": TableStore(spark, root), "tables": tables}


def test_reconciliation_passes(lake):
    assert len(lake["report"]) > 30
    assert [r.check_name for r in lake["report"] if not r.passed] == []


def test_faults_are_quarantined_and_the_rest_is_clean(lake):
    store = lake["store"]
    assert store.read("silver/invoices").count() + store.read("silver/quarantined_invoices").count() == 400
    codes = {r[0] for r in store.read("silver/quarantined_invoices").select(F.explode("_dq_codes")).distinct().collect()}
    assert {"MISSING_INVOICE_DATE", "MISSING_PAYMENT_METHOD", "INVALID_CUSTOMER_REFERENCE", "NO_INVOICE_ITEMS", "INVALID_INVOICE_ITEM"} <= codes
    assert store.read("gold/fact_invoice").where("customer_key = -1").count() == store.read("silver/invoices").where("customer_id is null").count() > 0


def test_a_second_run_changes_nothing(spark, lake):
    store = lake["store"]
    before = {n: sorted(map(str, store.read(n).collect())) for n in ("gold/fact_invoice", "gold/dim_customer", "gold/agg_executive_performance_daily")}
    counts = {n: store.read(n).count() for n in store.tables()}
    medallion.run(spark, lake["root"], lake["raw"], FIRST)
    assert {n: sorted(map(str, store.read(n).collect())) for n in before} == before
    assert {n: store.read(n).count() for n in store.tables()} == counts


def test_a_changed_customer_gets_a_version_and_facts_keep_theirs(spark, lake, tmp_path):
    store = lake["store"]
    changed = lake["tables"]["customers"].where("customer_id = '7'").withColumn("loyalty_tier", F.lit("Changed"))
    source = store.read("silver/customers")
    store.overwrite("silver/customers", source.withColumn("loyalty_tier", F.when(F.col("customer_id") == "7", "Changed").otherwise(F.col("loyalty_tier"))))
    assert changed.count() == 1
    facts_before = sorted(map(str, store.read("gold/fact_invoice").collect()))
    medallion.load_dimensions(store, SECOND)
    versions = store.read("gold/dim_customer").where("customer_id = '7'").orderBy("effective_from").collect()
    assert [v.is_current for v in versions] == [False, True]
    assert versions[0].effective_to == versions[1].effective_from
    assert store.read("gold/dim_customer").where("is_current and customer_id != '7'").count() == 60
    medallion.load_facts(store)
    assert sorted(map(str, store.read("gold/fact_invoice").collect())) == facts_before


def test_snapshots_of_other_days_stay(spark, lake):
    store = lake["store"]
    n = store.read("gold/agg_data_quality_record_daily").count()
    medallion.load_aggregates(store, SECOND)
    assert store.read("gold/agg_data_quality_record_daily").count() == 2 * n
    medallion.load_aggregates(store, SECOND)
    assert store.read("gold/agg_data_quality_record_daily").count() == 2 * n


def test_dry_run_reports(lake):
    reports = medallion.dry_run(lake["store"])
    impact = reports["impact"].first()
    assert impact.overlap_ok and impact.total_invoices == 400
    assert reports["customers_summary"].first().total_rows == 60


def test_bronze_is_incremental_and_known_by_file_and_place(spark, lake, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    raw = str(tmp_path / "raw")
    df = spark.createDataFrame([(str(i), "s", None, "2024-01-01", "Cash") for i in range(5)], ", ".join(f"{c} string" for c in SOURCE["invoices"]))
    files.write_parts(df, raw, "invoices", DATE, rows_per_file=2)
    assert len(ingest.ingest(spark, store, raw, "invoices", FIRST)) >= 3
    assert ingest.ingest(spark, store, raw, "invoices", SECOND) == []
    ids = {r[0] for r in store.read("bronze/invoices").select("_source_row_id").collect()}
    assert len(ids) == 5
    files.write_parts(df, raw, "invoices", dt.date(2024, 1, 3))
    assert len(ingest.ingest(spark, store, raw, "invoices", SECOND)) >= 1
    assert store.read("bronze/invoices").count() == 10


def test_a_repeated_load_keeps_the_first_time(spark, tmp_path):
    store, raw = TableStore(spark, str(tmp_path / "t")), str(tmp_path / "raw")
    df = spark.createDataFrame([("1", "s", None, "2024-01-01", "Cash")], ", ".join(f"{c} string" for c in SOURCE["invoices"]))
    files.write_parts(df, raw, "invoices", DATE)
    ingest.ingest(spark, store, raw, "invoices", FIRST)
    scan = spark.read.parquet(*files.discover(spark, raw, "invoices"))
    ingest.merge_bronze(store, "invoices", ingest.with_lineage(scan, SECOND))
    row = store.read("bronze/invoices").select(F.col("_insert_datetime_utc").cast("string").alias("i"), F.col("_update_datetime_utc").cast("string").alias("u")).collect()
    assert [(r.i, r.u) for r in row] == [(FIRST, SECOND)]


def test_stream_ingests_once(spark, tmp_path):
    store, raw = TableStore(spark, str(tmp_path / "t")), str(tmp_path / "raw")
    df = spark.createDataFrame([(str(i), "s", None, "2024-01-01", "Cash") for i in range(7)], ", ".join(f"{c} string" for c in SOURCE["invoices"]))
    files.write_parts(df, raw, "invoices", DATE, rows_per_file=3)
    args = (spark, store, raw, "invoices", str(tmp_path / "checkpoint"), FIRST)
    assert ingest.ingest_stream(*args) == 7
    assert ingest.ingest_stream(*args) == 0
    batch = TableStore(spark, str(tmp_path / "b"))
    ingest.ingest(spark, batch, raw, "invoices", FIRST)
    ids = lambda s: {r[0] for r in s.read("bronze/invoices").select("_source_row_id").collect()}
    assert ids(store) == ids(batch) and len(ids(store)) == 7


def test_a_wrong_schema_stops_the_load(spark, tmp_path):
    store, raw = TableStore(spark, str(tmp_path / "t")), str(tmp_path / "raw")
    files.write_parts(spark.createDataFrame([("1",)], "invoice_id string"), raw, "invoices", DATE)
    with pytest.raises(CheckFailed, match="missing"):
        ingest.ingest(spark, store, raw, "invoices", FIRST)
