"""The whole run: RAW files to Bronze, Silver and quarantine, Gold, aggregates, reconciliation.

A stage reads tables and writes tables. Silver and the dimensions are written aside, checked, and only then
published, so where a check fails the old state stays. ``as_of`` is the run's one clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import FIRST_START, OPEN_END
from ..operators import aggregates, dims, dqmart, facts, reconcile, scd2, silver
from ..operators.checks import CheckFailed
from ..operators.keys import next_key, with_small_keys
from ..operators.store import TableStore, missing_rows
from ..streaming.ingest import ingest
from .schemas import AGGREGATES, BRONZE, GOLD, GRAINS, SOURCE, TRACKED

ENTITIES = list(SOURCE)


def load_bronze(spark: SparkSession, store: TableStore, raw: str, as_of: str, tables: list[str] | None = None) -> dict[str, list[str]]:
    """New files of every table; returns the files loaded."""
    for name in ENTITIES:
        store.create(f"bronze/{name}", BRONZE[name])
    return {name: ingest(spark, store, raw, name, as_of) for name in tables or ENTITIES}


def evaluate_silver(store: TableStore, settle: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    store.require([f"bronze/{name}" for name in ENTITIES])
    return silver.evaluate({name: store.read(f"bronze/{name}") for name in ENTITIES}, settle)


def dry_run(store: TableStore) -> dict[str, DataFrame]:
    """Reports of a validation that writes nothing."""
    ready = evaluate_silver(store)
    out = {f"{name}_summary": silver.dimension_summary(ready[name]) for name in silver.KEYS}
    out |= {f"{name}_reasons": silver.reason_counts(df) for name, df in ready.items()}
    out["item_root_causes"] = silver.reason_counts(ready["invoice_items"], "_direct_codes")
    out["impact"] = silver.impact_summary(ready["invoices"], ready["invoice_items"])
    return out


def load_silver(store: TableStore, as_of: str) -> DataFrame:
    """Clean and quarantined tables, both rebuilt from Bronze, so that no row is ever in both. Returns the counts."""
    # Written once, so that both sides of the split and the counts see the same evaluation.
    ready = evaluate_silver(store, lambda name, df: store.overwrite(f"silver/_direct_{name}", df))
    good, bad = {}, {}
    for name, df in ready.items():
        judged = store.overwrite(f"silver/_evaluated_{name}", df) if name not in silver.KEYS else df
        good[name] = store.stage(f"silver/{name}", silver.clean(judged, name))
        bad[name] = store.stage(f"silver/quarantined_{name}", silver.quarantined(judged, name, as_of))
    frames = lambda staged: {n: s.frame for n, s in staged.items()}
    counts = reconcile.bronze_split({n: store.read(f"bronze/{n}") for n in ENTITIES}, frames(good), frames(bad))
    if wrong := counts.where("not adds_up").collect():
        raise CheckFailed(f"Bronze is not Silver and quarantine: {[r.asDict() for r in wrong]}")
    store.publish(*good.values(), *bad.values())
    for name in ENTITIES:
        store.drop(f"silver/_direct_{name}")
        store.drop(f"silver/_evaluated_{name}")
    return reconcile.bronze_split({n: store.read(f"bronze/{n}") for n in ENTITIES}, _silver(store), {n: store.read(f"silver/quarantined_{n}") for n in ENTITIES})


def _silver(store: TableStore) -> dict[str, DataFrame]:
    return {name: store.read(f"silver/{name}") for name in ENTITIES}


def _gold(store: TableStore, *names: str) -> dict[str, DataFrame]:
    return {name: store.read(f"gold/{name}") for name in names or GOLD}


def load_dimensions(store: TableStore, as_of: str) -> None:
    """Geography, categories and the versions of customers, stores and products, with their default members."""
    spark, s = store.spark, _silver(store)
    for name, ddl in GOLD.items():
        store.create(f"gold/{name}", ddl)
    places = dims.geography_source(s["stores"], s["customers"])
    dims.require_mapped(places)
    held = store.overwrite("gold/dim_geography", dims.repaired_regions(store.read("gold/dim_geography").where("geography_key != -1")))
    held = store.overwrite("gold/dim_geography", dims.insert_only(places, held, GRAINS["dim_geography"], "geography_key"))
    store.overwrite("gold/dim_category", dims.insert_only(dims.categories(s["products"]), store.read("gold/dim_category"), ["category_name"], "category_key"))
    sub = dims.subcategories(s["products"], store.read("gold/dim_category"))
    store.overwrite("gold/dim_subcategory", dims.insert_only(sub.select("category_key", "subcategory_name"), _columns(store, "dim_subcategory"), ["category_key", "subcategory_name"], "subcategory_key"))
    first = lambda key: s["invoices"].where(F.col(key).isNotNull()).groupBy(key).agg(F.min("invoice_date").alias("first_seen"))
    people = dims.lookup_geography(s["customers"], held).join(first("customer_id"), "customer_id", "left")
    shops = dims.lookup_geography(s["stores"].withColumnRenamed("region", "source_region"), held, "source_region").join(first("store_id"), "store_id", "left")
    sold = s["invoice_items"].join(s["invoices"].select("invoice_id", "invoice_date"), "invoice_id").groupBy("product_id").agg(F.min("invoice_date").alias("first_seen"))
    named = store.read("gold/dim_category").join(store.read("gold/dim_subcategory"), "category_key").select(F.col("category_name").alias("category"), F.col("subcategory_name").alias("subcategory"), "subcategory_key")
    goods = s["products"].join(named, ["category", "subcategory"], "left").join(sold, "product_id", "left")
    staged = []
    for name, source, natural in (("customer", people, "customer_id"), ("store", shops, "store_id"), ("product", goods, "product_id")):
        table, key = f"gold/dim_{name}", f"{name}_key"
        # The changed set is computed from a pinned version and written as one new version.
        versions = scd2.merge_scd2(source, store.read(table).where(F.col(key) != -1), natural, key, TRACKED[f"dim_{name}"], as_of, "first_seen")
        staged.append(store.stage(table, dims.with_default(versions, key, _default(spark, f"dim_{name}", key))))
        scd2.require_sound(staged[-1].frame, natural, key)
    for name, key in (("dim_geography", "geography_key"), ("dim_category", "category_key"), ("dim_subcategory", "subcategory_key")):
        staged.append(store.stage(f"gold/{name}", dims.with_default(store.read(f"gold/{name}"), key, _default(spark, name, key))))
    store.publish(*staged)


def _default(spark: SparkSession, name: str, key: str) -> DataFrame:
    """The default member of a dimension; that of a type-2 dimension has always held."""
    member = dims.default_member(spark, GOLD[name], key, **({"customer_id": "NO_CUSTOMER"} if name == "dim_customer" else {}))
    if "is_current" not in member.columns:
        return member
    return member.withColumns({"effective_from": F.lit(FIRST_START).cast("timestamp"), "effective_to": F.lit(OPEN_END).cast("timestamp"), "is_current": F.lit(True)})


def _columns(store: TableStore, name: str) -> DataFrame:
    """A dimension without its default member, which a null key marks."""
    df = store.read(f"gold/{name}")
    return df.where(F.col(df.columns[0]) != -1)


def load_facts(store: TableStore) -> None:
    """Invoices and lines with their keys; rows that are there keep theirs."""
    s, g = _silver(store), _gold(store, "dim_customer", "dim_store", "dim_product", "fact_invoice", "fact_invoice_item")
    if s["invoices"].isEmpty():
        raise CheckFailed("Silver has no invoices; the calendar would be empty")
    store.overwrite("gold/dim_date", dims.extended_calendar(store.read("gold/dim_date"), s["invoices"].select("invoice_date")))
    facts.guard_invoices(s["invoices"], g["dim_store"], g["dim_customer"])
    heads = store.overwrite("gold/_resolved_invoice", facts.resolve_invoices(s["invoices"], store.read("gold/dim_date"), g["dim_store"], g["dim_customer"]))
    facts.guard_resolved(heads, ["date_key", "customer_key", "store_key"], "invoice")
    keyed = facts.carry_keys(heads, g["fact_invoice"], ["invoice_id"], "invoice_key")
    invoices = store.merge("gold/fact_invoice", keyed.select(*g["fact_invoice"].columns), ["invoice_id"])
    lines = store.overwrite("gold/_resolved_item", facts.resolve_lines(s["invoice_items"], s["invoices"], invoices, g["dim_product"]))
    facts.guard_resolved(lines, ["invoice_key", "product_key"], "line")
    keyed = facts.carry_keys(lines, g["fact_invoice_item"], ["invoice_id", "line_item"], "invoice_item_key")
    store.merge("gold/fact_invoice_item", keyed.select(*g["fact_invoice_item"].columns), ["invoice_id", "line_item"])
    for name in ("gold/_resolved_invoice", "gold/_resolved_item"):
        store.drop(name)


def load_quality_mart(store: TableStore) -> None:
    """Rules, issues and the quarantined rows as payload."""
    bad = {name: store.read(f"silver/quarantined_{name}") for name in ENTITIES}
    for name, df in bad.items():
        rows = dqmart.normalised(df, name).drop("source_table", "codes")
        if not store.exists(f"gold/quarantined_{name}"):
            store.overwrite(f"gold/quarantined_{name}", rows)
        else:
            store.merge(f"gold/quarantined_{name}", rows, ["source_row_id", "dq_error_code"])
    found = dqmart.issues(dqmart.all_quarantined(bad))
    rules, known = dqmart.rules_of(found), store.read("gold/dim_data_quality_rule")
    new = with_small_keys(missing_rows(rules, known, ["source_table", "dq_error_code"]), "dq_rule_key", ["source_table", "dq_error_code"], next_key(known, "dq_rule_key"))
    named = store.append("gold/dim_data_quality_rule", new.select(*known.columns))
    held = store.read("gold/fact_data_quality_issue")
    natural = GRAINS["fact_data_quality_issue"]
    keyed = facts.carry_keys(store.overwrite("gold/_issues", dqmart.with_rule_keys(found, named)), held, natural, "dq_issue_key")
    store.merge("gold/fact_data_quality_issue", keyed.select(*held.columns), natural)
    store.drop("gold/_issues")


def load_aggregates(store: TableStore, as_of: str) -> None:
    """The three sales aggregates and the two of data quality."""
    day = store.spark.sql("select 1").select(F.to_date(F.lit(as_of)).alias("d"))
    issue_days = store.read("gold/fact_data_quality_issue").select(F.to_date("quarantine_datetime_utc").alias("d"))
    store.overwrite("gold/dim_date", dims.extended_calendar(store.read("gold/dim_date"), issue_days, day))
    g = _gold(store)
    for facts_, key, dimension in ((g["fact_invoice"], "date_key", g["dim_date"]), (g["fact_invoice"], "store_key", g["dim_store"]), (g["fact_invoice_item"], "product_key", g["dim_product"])):
        if not reconcile.orphans(facts_, key, dimension).isEmpty():
            raise CheckFailed(f"facts have a {key} that no dimension has")
    lines = store.overwrite("gold/_lines", aggregates.sales_lines(g["fact_invoice"], g["fact_invoice_item"], g["dim_product"], g["dim_date"]))
    for name, df in (
        ("agg_executive_performance_daily", aggregates.executive_daily(lines)),
        ("agg_product_performance_monthly", aggregates.product_monthly(lines)),
        ("agg_store_performance_daily", aggregates.store_daily(lines, g["fact_invoice"])),
        ("agg_data_quality_daily", dqmart.daily(g["fact_data_quality_issue"], g["dim_data_quality_rule"], g["dim_date"])),
    ):
        aggregates.publish(store, f"gold/{name}", df, GRAINS[name], as_of)
    store.drop("gold/_lines")
    bad = {name: store.read(f"silver/quarantined_{name}") for name in ENTITIES}
    aggregates.replace_day(store, "gold/agg_data_quality_record_daily", dqmart.record_snapshot(_silver(store), bad, as_of), "evaluation_date_key", as_of)


def reconcile_gold(store: TableStore) -> dict[str, DataFrame]:
    """Every check of the Gold layer as a frame of offending rows."""
    bad = {name: store.read(f"silver/quarantined_{name}") for name in ENTITIES}
    return reconcile.gold_checks(_silver(store), bad, _gold(store), _gold(store, *AGGREGATES))


def run(spark: SparkSession, root: str, raw: str, as_of: str) -> DataFrame:
    """All stages in order; returns the report of the reconciliation."""
    store = TableStore(spark, root)
    load_bronze(spark, store, raw, as_of)
    load_silver(store, as_of)
    load_dimensions(store, as_of)
    load_facts(store)
    load_quality_mart(store)
    load_aggregates(store, as_of)
    store.vacuum()
    return reconcile.report(reconcile_gold(store))
