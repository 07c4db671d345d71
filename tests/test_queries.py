import decimal
import glob
import os

import duckdb
import pytest

from shelfmark.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
CHECKED = """exec_daily_agg product_monthly_agg store_daily_agg kpi_exec_headline kpi_growth_prev_period rev_by_region top5_products_per_store drill_geo_rollup dim_date
region_map_lookup scd2_versions scd2_overlap_check asof_fact_resolve dq_products dq_invoices dq_items silver_items dq_pareto parse_dates parse_longs merge_upsert
merge_conditional nullsafe_anti surrogate_keys recon_aggregates
bronze_lineage incremental_ingest processed_log store_merge fact_invoice_keys fact_line_keys key_carry_over scd2_keys first_transaction default_members geography_lookup
recon_fact_counts recon_fact_grain recon_scd2_sound recon_default_for_known recon_aggregate_grain recon_month_key recon_records_add_up recon_dq_population recon_issue_sum recon_report
dq_affected_records dq_trend dq_by_geography store_growth guards dq_daily_agg""".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if isinstance(value, decimal.Decimal) else value


@pytest.fixture(scope="module")
def engine():
    if not os.path.isdir(SF_DIR):
        pytest.skip("the test tables are not here")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_equals_the_independent_engine(spark, engine, name):
    frame = QUERIES[name](spark, SF_DIR)
    names = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    answer = engine.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in answer.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_soundness_counts_only_planted_faults_where_customers_first_buy_after_a_load(spark, tmp_path):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 'A' AS c_mktsegment FROM range(1, 61) t(i)")
    connection.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i AS o_custkey, CASE WHEN i % 20 = 0 THEN TIMESTAMP '2001-06-19' WHEN i = 10 THEN TIMESTAMP '2000-07-01' WHEN i = 50 THEN TIMESTAMP '2000-03-01' ELSE TIMESTAMP '1997-01-01' END AS o_orderdate FROM range(1, 60) t(i)")
    for name in ("customer", "orders"):
        connection.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in QUERIES["recon_scd2_sound"](spark, str(tmp_path)).collect())
    assert got == sorted(connection.execute(SQL["recon_scd2_sound"]).fetchall())
