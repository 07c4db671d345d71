"""Dashboard queries over the aggregates and dimensions. Ratios are ratios of sums; ties are broken by a key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import MONEY_SUM, beside, ratio

def sums(*names: str) -> list[Column]:
    kinds = {"revenue": MONEY_SUM, "units_sold": "bigint", "gross_margin": MONEY_SUM, "invoice_count": "bigint"}
    return [F.sum(n).cast(kinds[n]).alias(n) for n in names]


MEASURES = ("revenue", "units_sold", "gross_margin")


@dataclass(frozen=True)
class Slice:
    """A dashboard's filters: dates as ``yyyyMMdd`` keys, and wanted values by column."""

    first: int | None = None
    last: int | None = None
    values: dict[str, list] = field(default_factory=dict)

    def apply(self, df: DataFrame, date: str = "date_key") -> DataFrame:
        """The rows within; a filter on a column that the frame lacks is an error."""
        if self.first is not None:
            df = df.where(F.col(date) >= self.first)
        if self.last is not None:
            df = df.where(F.col(date) <= self.last)
        for column, wanted in self.values.items():
            df = df.where(F.col(column).isin(*wanted))
        return df


def headline(sales: DataFrame) -> DataFrame:
    """Revenue, units, margin and margin rate in all."""
    return sales.agg(*sums(*MEASURES)).withColumn("margin_rate", ratio("gross_margin", "revenue"))


def by(sales: DataFrame, *columns: str) -> DataFrame:
    """Measures and margin rate for each value of the columns."""
    return sales.groupBy(*columns).agg(*sums(*MEASURES)).withColumn("margin_rate", ratio("gross_margin", "revenue"))


def top(sales: DataFrame, columns: list[str], n: int = 10, best: bool = True) -> DataFrame:
    """The ``n`` with the most revenue, or the least."""
    order = F.desc("revenue") if best else F.asc("revenue")
    return sales.groupBy(*columns).agg(*sums("revenue", "units_sold")).orderBy(order, *columns).limit(n)


def top_per_group(sales: DataFrame, group: str, column: str, n: int = 5) -> DataFrame:
    """The ``n`` values of ``column`` with the most revenue in each group."""
    totals = sales.groupBy(group, column).agg(*sums("revenue"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("revenue"), column))
    return totals.withColumn("rank", rank).where(F.col("rank") <= n)


def growth(sales: DataFrame, dates: DataFrame, first: str, last: str, *columns: str) -> DataFrame:
    """Revenue of a period of days and of the equally long one right before it, and the growth; null without one.

    ``columns``: for each of their values that sold in either period.
    """
    days = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    d = sales.join(dates.select("date_key", "full_date"), "date_key")
    now = F.col("full_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    before = F.col("full_date").between(F.date_sub(F.lit(first).cast("date"), days), F.date_sub(F.lit(first).cast("date"), 1))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("revenue"))), F.lit(0)).cast(MONEY_SUM)
    return d.where(now | before).groupBy(*columns).agg(total(now).alias("revenue"), total(before).alias("previous_revenue")).withColumn("growth", ratio(F.col("revenue") - F.col("previous_revenue"), "previous_revenue"))


def trend(sales: DataFrame, dates: DataFrame, first: str, last: str) -> DataFrame:
    """Revenue of every day of a period, beside that of the day as many days earlier as the period is long."""
    days = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    daily = sales.join(dates.select("date_key", "full_date"), "date_key").groupBy("full_date").agg(*sums("revenue"))
    spine = dates.where(F.col("full_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("full_date", F.date_sub("full_date", days).alias("_before"))
    now, before = daily.withColumnRenamed("revenue", "_now"), daily.select(F.col("full_date").alias("_before"), F.col("revenue").alias("_then"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(MONEY_SUM)
    return spine.join(now, "full_date", "left").join(before, "_before", "left").select("full_date", zero("_now").alias("revenue"), zero("_then").alias("previous_revenue"))


def active_stores(sales: DataFrame, store_dim: DataFrame) -> DataFrame:
    """Stores there are, whether they sold or not, and revenue for each of them."""
    return beside(store_dim.agg(F.count_distinct("store_key").alias("active_stores")), sales.agg(*sums("revenue"))).withColumn("revenue_per_store", ratio("revenue", "active_stores", "decimal(20,6)"))


def average_price(sales: DataFrame, *columns: str) -> DataFrame:
    """Revenue, units, average selling price and margin rate."""
    return by(sales, *columns).withColumn("average_price", ratio("revenue", "units_sold", "decimal(20,6)"))


def drill(sales: DataFrame, *levels: str) -> DataFrame:
    """Subtotals of a hierarchy; ``level`` says how many of its columns are set."""
    out = sales.rollup(*levels).agg(*sums(*MEASURES), F.grouping_id().alias("_g"))
    return out.withColumn("level", (F.lit(len(levels)) - F.bit_count("_g")).cast("int")).drop("_g")


def pareto(counts: DataFrame, label: str, value: str) -> DataFrame:
    """Labels by falling value with their running share of the whole. For rule-sized inputs: one task ranks them."""
    running = Window.orderBy(F.desc(value), label).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return counts.select(label, value, ratio(F.sum(value).over(running), F.sum(value).over(whole)).alias("cumulative_share"))


def dq_rates(records: DataFrame) -> DataFrame:
    """Records in all, incorrect ones, and the rates of good and bad."""
    out = records.agg(F.sum("total_records").alias("total_records"), F.sum("incorrect_records").alias("incorrect_records"))
    bad = ratio("incorrect_records", "total_records")
    return out.select("*", (1 - bad).cast("decimal(18,6)").alias("quality_rate"), bad.alias("incorrect_rate"))


def affected_records(issues: DataFrame) -> DataFrame:
    """Issues, and the distinct records that have any: these never add up over rules."""
    return issues.agg(F.count("*").alias("issues"), F.count_distinct("source_table", "source_row_id").alias("affected_records"))


def issues_by(issues: DataFrame, *columns: str) -> DataFrame:
    return issues.groupBy(*columns).agg(F.count("*").alias("issues"), F.count_distinct("source_table", "source_row_id").alias("affected_records"))


def dq_trend(issues: DataFrame, dates: DataFrame) -> DataFrame:
    """Issues and affected records of every day of a calendar, days without any included."""
    dated = issues.select(F.to_date("quarantine_datetime_utc").alias("full_date"), F.struct("source_table", "source_row_id").alias("record"))
    each = dated.groupBy("full_date").agg(F.count("*").alias("issues"), F.count_distinct("record").alias("affected_records"))
    return dates.select("full_date").join(each, "full_date", "left").fillna(0, ["issues", "affected_records"])


def dq_by_place(issues: DataFrame) -> DataFrame:
    """Issues by the state that the row itself names."""
    return issues.groupBy("source_table", F.get_json_object("source_payload_json", "$.state").alias("state")).agg(F.count("*").alias("issues"))


def remediation(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """What has to be mended: an issue with its rule and the row as it came."""
    keep = rules.select("dq_rule_key", "dq_rule_name", "severity")
    return issues.join(keep, "dq_rule_key", "left").select("source_table", "source_row_id", "source_file_name", "dq_error_code", "dq_rule_name", "severity", "dq_status", "source_payload_json")
