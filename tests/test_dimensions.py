import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import aggregates, dims, dqmart, facts, reconcile, scd2
from shelfmark.operators.checks import CheckFailed
from shelfmark.plans import kpis

EMPTY = "key bigint, id string, tier string, effective_from timestamp, effective_to timestamp, is_current boolean, attribute_hash string"


def load(spark, dimension, rows, as_of):
    source = spark.createDataFrame(rows, "id string, tier string, first_seen date")
    return scd2.merge_scd2(source, dimension, "id", "key", ["tier"], as_of, "first_seen")


@pytest.fixture(scope="module")
def versions(spark):
    first = load(spark, spark.createDataFrame([], EMPTY), [("a", "x", dt.date(2020, 5, 1)), ("b", "y", None), ("c", None, None)], "2024-01-01 00:00:00")
    return load(spark, first, [("a", "x2", dt.date(2020, 5, 1)), ("b", "y", None), ("c", "now", None), ("d", "z", dt.date(2024, 2, 2))], "2024-06-01 00:00:00").cache()


def test_versions(versions):
    text = lambda t: t.strftime("%Y-%m-%d")
    got = [(r.id, r.tier, text(r.effective_from), text(r.effective_to), r.is_current) for r in versions.orderBy("id", "effective_from").collect()]
    assert got == [
        ("a", "x", "2020-05-01", "2024-06-01", False),
        ("a", "x2", "2024-06-01", "9998-12-31", True),
        ("b", "y", "1900-01-01", "9998-12-31", True),
        ("c", None, "1900-01-01", "2024-06-01", False),
        ("c", "now", "2024-06-01", "9998-12-31", True),
        ("d", "z", "2024-02-02", "9998-12-31", True),
    ]
    assert sorted(r.key for r in versions.collect()) == list(range(1, 7))
    assert all(f.isEmpty() for f in scd2.faults(versions, "id", "key").values())


def test_a_load_without_changes_adds_nothing(spark, versions):
    again = load(spark, versions, [("a", "x2", None), ("b", "y", None), ("c", "now", None), ("d", "z", None)], "2025-01-01 00:00:00")
    assert sorted(map(str, again.collect())) == sorted(map(str, versions.collect()))


def test_source_must_be_unique_and_named(spark, versions):
    for rows in ([("a", "x", None), ("a", "y", None)], [(None, "x", None)]):
        with pytest.raises(CheckFailed):
            load(spark, versions, rows, "2025-01-01 00:00:00")


def test_as_of_join_is_half_open(spark, versions):
    sold = spark.createDataFrame([(1, "a", dt.date(2024, 5, 31)), (2, "a", dt.date(2024, 6, 1)), (3, "a", dt.date(2019, 1, 1)), (4, None, dt.date(2024, 1, 1))], "n int, id string, d date")
    got = {r.n: r.tier for r in scd2.as_of_join(sold, versions, "id", "d", ["tier"]).collect()}
    assert got == {1: "x", 2: "x2", 3: None, 4: None}
    assert {r.n: r.matches for r in scd2.as_of_matches(sold, versions, "id", "d", ["n"]).collect()} == {1: 1, 2: 1, 3: 0}
    with pytest.raises(CheckFailed):
        scd2.require_single_match(sold, versions, "id", "d", ["n"], "late")


def test_overlaps_equal_the_self_join(spark):
    rows = [(i, f"e{i % 3}", dt.datetime(2024, 1, 1 + i % 20), dt.datetime(2024, 1, 2 + i % 20 + (3 if i % 7 == 0 else 0))) for i in range(12)]
    df = spark.createDataFrame(rows, "key int, id string, effective_from timestamp, effective_to timestamp")
    brute = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0] and a[2] <= b[2] and b[2] < a[3] and (a[2], a[0]) < (b[2], b[0])}
    found = {(r.version_key, r.next_key) for r in scd2.overlaps(df, "id", "key").collect()}
    assert found <= brute and {a for a, _ in found} == {a for a, _ in brute}


def test_default_members_and_insert_only(spark):
    ddl = "category_key bigint, category_name string"
    empty = spark.createDataFrame([], ddl)
    seeded = dims.with_default(empty, "category_key", dims.default_member(spark, ddl, "category_key"))
    again = dims.with_default(seeded, "category_key", dims.default_member(spark, ddl, "category_key"))
    one = dims.insert_only(spark.createDataFrame([("b",), ("a",), (None,)], "category_name string"), again, ["category_name"], "category_key")
    two = dims.insert_only(spark.createDataFrame([("c",), ("a",), (None,)], "category_name string"), one, ["category_name"], "category_key")
    assert sorted((r.category_key, str(r.category_name)) for r in two.collect()) == [(-1, "Unknown"), (1, "None"), (2, "a"), (3, "b"), (4, "c")]
    with pytest.raises(CheckFailed):
        dims.insert_only(spark.createDataFrame([("z",), ("z",)], "category_name string"), two, ["category_name"], "category_key")


def test_calendar(spark):
    days = dims.date_dimension(spark.createDataFrame([(dt.date(2024, 12, 29),), (dt.date(2025, 1, 1),)], "d date"), "d")
    rows = {r.date_key: r for r in days.collect()}
    assert sorted(rows) == [20241229, 20241230, 20241231, 20250101]
    first, last = rows[20241229], rows[20241231]
    assert (first.day_of_week, first.day_name, first.is_weekend, first.year_quarter) == (1, "Sunday", True, "2024-Q4")
    assert (rows[20241230].week_of_year, last.is_month_end, rows[20250101].is_month_start, last.month_name) == (1, True, True, "December")
    assert dims.date_dimension(spark.createDataFrame([], "d date"), "d").count() == 0
    longer = dims.extended_calendar(days, spark.createDataFrame([(dt.date(2025, 1, 4),)], "d date"))
    assert longer.count() == 7 and longer.select("date_key").distinct().count() == 7


def test_geography(spark):
    stores = spark.createDataFrame([("Northeast", "MD", "Baltimore", "1"), ("South", None, None, None)], "region string, state string, city string, zip_code string")
    people = spark.createDataFrame([("MD", "Baltimore", "1"), ("XX", "q", "2")], "state string, city string, zip_code string")
    places = dims.geography_source(stores, people)
    assert places.count() == 3
    with pytest.raises(CheckFailed, match="XX"):
        dims.require_mapped(places)
    empty = spark.createDataFrame([], "geography_key bigint, region string, state string, city string, zip_code string")
    held = dims.insert_only(places, empty, ["region", "state", "city", "zip_code"], "geography_key")
    found = dims.lookup_geography(stores.withColumnRenamed("region", "r"), held, "r")
    assert found.where("geography_key is null").count() == 0
    wrong = held.withColumn("region", F.when(F.col("state") == "MD", "West").otherwise(F.col("region")))
    assert [r.region for r in dims.repaired_regions(wrong).where("state = 'MD'").collect()] == ["South"]


def test_facts_and_guards(spark):
    dates = dims.date_dimension(spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date"), "d")
    version = "effective_from timestamp, effective_to timestamp"
    always = (dt.datetime(1900, 1, 1), dt.datetime(9998, 12, 31))
    shops = spark.createDataFrame([(5, "s", *always), (-1, "Unknown", *always)], f"store_key long, store_id string, {version}")
    people = spark.createDataFrame([(7, "c", *always), (-1, "NO_CUSTOMER", *always)], f"customer_key long, customer_id string, {version}")
    sold = spark.createDataFrame([("1", "s", "c", dt.date(2024, 1, 1), "Cash"), ("2", "s", None, dt.date(2024, 1, 1), "Cash")], "invoice_id string, store_id string, customer_id string, invoice_date date, payment_method string")
    out = facts.resolve_invoices(sold, dates, shops, people)
    assert sorted((r.invoice_id, r.date_key, r.customer_key, r.store_key) for r in out.collect()) == [("1", 20240101, 7, 5), ("2", 20240101, -1, 5)]
    facts.guard_resolved(out, ["date_key", "customer_key", "store_key"], "invoice")
    with pytest.raises(CheckFailed):
        facts.guard_resolved(out.withColumn("store_key", F.lit(-1)), ["store_key"], "invoice")
    held = spark.createDataFrame([("2", 41)], "invoice_id string, invoice_key long")
    assert sorted((r.invoice_id, r.invoice_key) for r in facts.carry_keys(out, held, ["invoice_id"], "invoice_key").collect()) == [("1", 42), ("2", 41)]


def test_store_daily_keeps_days_with_either_side(spark):
    lines = spark.createDataFrame([(1, 1, 2, "3.00", "1.00")], "date_key int, store_key long, quantity long, a string, b string").select("date_key", "store_key", "quantity", F.col("a").cast("decimal(20,2)").alias("line_revenue"), F.col("b").cast("decimal(20,2)").alias("line_margin"))
    heads = spark.createDataFrame([(2, 1, "x"), (2, 1, "x"), (2, 1, "y")], "date_key int, store_key long, invoice_id string")
    got = {r.date_key: (str(r.revenue), r.units_sold, r.invoice_count) for r in aggregates.store_daily(lines, heads).collect()}
    assert got == {1: ("3.00", 2, 0), 2: ("0.00", 0, 2)}


def test_a_negative_line_is_kept(spark):
    df = spark.createDataFrame([(1, "1.00", "2.50", None)], "quantity long, p string, d string, c string").select("quantity", F.col("p").cast("decimal(18,2)").alias("unit_price"), F.col("d").cast("decimal(18,2)").alias("discount"), F.col("c").cast("decimal(18,2)").alias("cost"))
    row = aggregates.line_measures(df).first()
    assert (str(row.line_revenue), str(row.line_margin)) == ("-1.50", "-1.50")


def test_difference_sees_a_missing_key_with_null_measures(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "k int, m int")
    b = spark.createDataFrame([(2, 5), (3, 7)], "k int, m int")
    assert sorted(r.k for r in reconcile.aggregate_difference(a, b, ["k"], ["m"]).collect()) == [1, 3]


def test_rules_and_issues(spark):
    q = spark.createDataFrame([("r1", ["MISSING_STORE_ID", "NEGATIVE_COST"]), ("r2", ["NEGATIVE_COST"])], "_source_row_id string, _dq_codes array<string>")
    rows = dqmart.all_quarantined({"products": q, "stores": spark.createDataFrame([("s1",)], "_source_row_id string")})
    found = dqmart.issues(rows)
    assert found.count() == 4 and dqmart.issues(rows, each_code=False).count() == 3
    severity = {r.dq_error_code: r.severity for r in dqmart.rules_of(found).collect()}
    assert severity == {"MISSING_STORE_ID": "Critical", "NEGATIVE_COST": "Medium", "UNSPECIFIED_DQ_RULE": "High"}
    assert kpis.affected_records(found).first().affected_records == 3
    shares = [str(r.cumulative_share) for r in kpis.pareto(kpis.issues_by(found, "dq_error_code"), "dq_error_code", "issues").orderBy("cumulative_share").collect()]
    assert shares == ["0.500000", "0.750000", "1.000000"]


def test_growth_without_a_previous_period_is_null(spark):
    dates = dims.date_dimension(spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 10),)], "d date"), "d")
    sales = spark.createDataFrame([(20240105, 10), (20240103, 4)], "date_key int, r int").select("date_key", F.col("r").cast("decimal(20,2)").alias("revenue"))
    row = kpis.growth(sales, dates, "2024-01-05", "2024-01-06").first()
    assert (str(row.revenue), str(row.previous_revenue), str(row.growth)) == ("10.00", "4.00", "1.500000")
    assert kpis.growth(sales, dates, "2024-01-01", "2024-01-04").first().growth is None
    assert [str(r.revenue) for r in kpis.trend(sales, dates, "2024-01-04", "2024-01-05").orderBy("full_date").collect()] == ["0.00", "10.00"]


def test_all_pairs_of_overlapping_versions(spark):
    import random

    from shelfmark.operators import scd2

    rng = random.Random(6)
    rows = [(e, k, s, s + rng.choice([1, 2, 3, 30])) for e in range(20) for k, s in enumerate(sorted(rng.randrange(60) for _ in range(8)))]
    held = spark.createDataFrame(rows, "e int, k int, effective_from int, effective_to int")
    got = sorted(tuple(r) for r in scd2.overlaps(held, "e", "k").collect())
    assert got == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and b[2] < a[3])
    assert len(got) > 100


def test_rows_without_keys_are_dealt_out_and_find_nothing(spark):
    from pyspark.sql import functions as F

    from shelfmark.operators import scd2

    facts = spark.range(1000).select("id", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 3).cast("string").alias("c"), F.lit("2024-05-01").cast("date").alias("d"))
    held = spark.createDataFrame([(str(i), 10 + i) for i in range(3)], "c string, key int").withColumns({"effective_from": F.lit("2024-01-01").cast("timestamp"), "effective_to": F.lit("2025-01-01").cast("timestamp")})
    out = scd2.as_of_join(facts, held, "c", "d", ["key"])
    assert out.columns == ["id", "c", "d", "key"] and out.count() == 1000
    assert out.where("(c is null) != (key is null)").count() == 0
