"""Read-only reconciliation. Every check is a frame of offending rows; a report counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import all_equal, any_difference, beside
from ..functions.fixed_values import UNKNOWN_KEY
from ..plans.schemas import GRAINS
from . import aggregates, scd2
from .checks import duplicates
from .dqmart import record_snapshot


def count_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with both counts if they differ."""
    left, right = a.agg(F.count("*").alias("n_left")), b.agg(F.count("*").alias("n_right"))
    return beside(left, right).where("n_left != n_right")


def aggregate_difference(expected: DataFrame, actual: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Keys that only one side has, or whose measures differ. A missing key counts even if its measures are null."""
    e = expected.select(*keys, *measures, F.lit(True).alias("_here")).alias("e")
    a = actual.select(*keys, *measures, F.lit(True).alias("_here")).alias("a")
    both = e.join(a, all_equal("e", "a", keys), "full").where(any_difference("e", "a", [*measures, "_here"]))
    return both.select(*(F.coalesce(F.col(f"e.{k}"), F.col(f"a.{k}")).alias(k) for k in keys))


def orphans(facts: DataFrame, key: str, dimension: DataFrame, dimension_key: str | None = None) -> DataFrame:
    """Non-null keys that the dimension doesn't have."""
    return facts.where(F.col(key).isNotNull()).select(key).distinct().join(dimension.select(F.col(dimension_key or key).alias(key)), key, "left_anti")


def default_for_known(source: DataFrame, natural: str, facts: DataFrame, key: str) -> DataFrame:
    """Facts that map to the default member though their source names an entity."""
    named = source.where(F.col(natural).isNotNull()).select("invoice_id")
    return facts.where(F.col(key) == UNKNOWN_KEY).join(named, "invoice_id", "left_semi")


def not_month_start(monthly: DataFrame, dates: DataFrame) -> DataFrame:
    """Month keys that no first day of a month has."""
    return orphans(monthly, "month_date_key", dates.where("day = 1"), "date_key")


def issue_sum(daily: DataFrame, issues: DataFrame) -> DataFrame:
    """One row with the issues that the aggregate sums up to and those there are, if they differ."""
    return beside(daily.agg(F.coalesce(F.sum("dq_issue_count"), F.lit(0)).alias("n")), issues.agg(F.count("*").alias("m"))).where("n != m")


def gold_checks(silver: dict[str, DataFrame], quarantine: dict[str, DataFrame], gold: dict[str, DataFrame], aggs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every check of the Gold layer by name."""
    lines = aggregates.sales_lines(gold["fact_invoice"], gold["fact_invoice_item"], gold["dim_product"], gold["dim_date"])
    out = {
        "invoice_count": count_difference(silver["invoices"], gold["fact_invoice"]),
        "item_count": count_difference(silver["invoice_items"], gold["fact_invoice_item"]),
        "customer_default": default_for_known(silver["invoices"], "customer_id", gold["fact_invoice"], "customer_key"),
        "store_default": gold["fact_invoice"].where("store_key = -1"),
        "fk_date": orphans(gold["fact_invoice"], "date_key", gold["dim_date"]),
        "fk_store": orphans(gold["fact_invoice"], "store_key", gold["dim_store"]),
        "fk_product": orphans(gold["fact_invoice_item"], "product_key", gold["dim_product"]),
        "fk_subcategory": orphans(gold["dim_product"], "subcategory_key", gold["dim_subcategory"]),
        "executive": aggregate_difference(aggregates.executive_daily(lines), aggs["agg_executive_performance_daily"], GRAINS["agg_executive_performance_daily"], aggregates.MEASURES),
        "product": aggregate_difference(aggregates.product_monthly(lines), aggs["agg_product_performance_monthly"], GRAINS["agg_product_performance_monthly"], aggregates.MEASURES),
        "store": aggregate_difference(aggregates.store_daily(lines, gold["fact_invoice"]), aggs["agg_store_performance_daily"], GRAINS["agg_store_performance_daily"], [*aggregates.MEASURES, "invoice_count"]),
        "month_start": not_month_start(aggs["agg_product_performance_monthly"], gold["dim_date"]),
        "records_add_up": aggs["agg_data_quality_record_daily"].where("total_records != valid_records + incorrect_records"),
        "issue_sum": issue_sum(aggs["agg_data_quality_daily"], gold["fact_data_quality_issue"]),
        "dq_population": _population(silver, quarantine, aggs["agg_data_quality_record_daily"]),
    }
    heads = silver["invoices"]
    dated = silver["invoice_items"].join(heads.select("invoice_id", "invoice_date"), "invoice_id")
    for name, facts, natural, key, row in (("store", heads, "store_id", "store_key", ["invoice_id"]), ("customer", heads, "customer_id", "customer_key", ["invoice_id"]), ("product", dated, "product_id", "product_key", ["invoice_id", "line_item"])):
        dimension = gold[f"dim_{name}"].where(F.col(key) != UNKNOWN_KEY)
        out[f"one_version_{name}"] = scd2.as_of_matches(facts, dimension, natural, "invoice_date", row).where("matches != 1")
        out |= {f"{name}_{k}": v for k, v in scd2.faults(gold[f"dim_{name}"], natural, key).items()}
    for name, grain in GRAINS.items():
        if (frame := {**gold, **aggs}.get(name)) is not None:
            out[f"grain_{name}"] = duplicates(frame, grain)
    return out


def _population(silver: dict[str, DataFrame], quarantine: dict[str, DataFrame], records: DataFrame) -> DataFrame:
    latest = records.join(records.agg(F.max("evaluation_date_key").alias("evaluation_date_key")), "evaluation_date_key")
    now = record_snapshot(silver, quarantine, "2000-01-01")
    return aggregate_difference(now, latest, ["source_table", "source_file_name"], ["total_records", "valid_records", "incorrect_records"])


def bronze_split(bronze: dict[str, DataFrame], silver: dict[str, DataFrame], quarantine: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: its Bronze, clean and quarantined rows, and whether they add up."""
    frames = []
    for name in bronze:
        frames += [df.select(F.lit(name).alias("table_name"), F.lit(kind).alias("kind")) for kind, df in (("bronze", bronze[name]), ("clean", silver[name]), ("quarantine", quarantine[name]))]
    counts = reduce(DataFrame.unionByName, frames).groupBy("table_name").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_rows") for k in ("bronze", "clean", "quarantine")))
    return counts.withColumn("adds_up", F.expr("bronze_rows = clean_rows + quarantine_rows"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """``check_name, passed, offending_rows`` for every check, in one job."""
    frames = [df.agg(F.count("*").alias("offending_rows")).select(F.lit(name).alias("check_name"), "offending_rows") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, frames).select("check_name", (F.col("offending_rows") == 0).alias("passed"), "offending_rows")
