"""Dimensions: calendar, geography, categories, default members and insert-only loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import calendar, region, region_of_state
from ..functions.fixed_values import UNKNOWN_KEY
from ..plans.schemas import columns
from .checks import require_no_rows, require_unique
from .keys import next_key, with_small_keys
from .store import merged, missing_rows


def calendar_between(bounds: DataFrame) -> DataFrame:
    """Every day from ``lo`` to ``hi`` of a one-row frame with its attributes; no bounds, no days."""
    days = bounds.where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("full_date"))
    return days.select(*(c.alias(name) for name, c in calendar("full_date").items()))


def date_dimension(dates: DataFrame, column: str) -> DataFrame:
    """The calendar that covers a column of dates."""
    return calendar_between(dates.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))


def extended_calendar(existing: DataFrame, *dates: DataFrame) -> DataFrame:
    """``existing`` and the missing days, so that it covers one-column frames of dates, with no gap between."""
    all_ = existing.select(F.col("full_date").alias("d"))
    for frame in dates:
        all_ = all_.unionByName(frame.select(F.col(frame.columns[0]).cast("date").alias("d")))
    days = date_dimension(all_, "d")
    return existing.unionByName(missing_rows(days, existing, ["date_key"]).select(*existing.columns))


def geography_source(stores: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct places of both; a place's region is its state's, whatever the source says."""
    both = stores.select(F.col("region").alias("source_region"), "state", "city", "zip_code").unionByName(customers.select(F.lit(None).cast("string").alias("source_region"), "state", "city", "zip_code"))
    return both.select(region("state", "source_region").alias("region"), "state", "city", "zip_code").distinct()


def unmapped_states(places: DataFrame) -> DataFrame:
    """States that are given but known to no region."""
    return places.where(F.col("state").isNotNull() & region_of_state("state").isNull()).select("state").distinct()


def insert_only(source: DataFrame, existing: DataFrame, natural: list[str], key: str) -> DataFrame:
    """``existing`` and, with new keys, the rows of ``source`` whose natural keys it lacks. Nulls are equal."""
    require_unique(source, natural, f"source of {key}")
    new = missing_rows(source, existing, natural)
    numbered = with_small_keys(new, key, natural, next_key(existing, key))
    return existing.unionByName(numbered.select(*existing.columns))


def repaired_regions(existing: DataFrame) -> DataFrame:
    """``existing`` geography with regions that its states call for, where they differ."""
    right = existing.where("state is not null").select("geography_key", region("state", "region").alias("region"), "state", "city", "zip_code")
    return merged(existing, right, ["geography_key"], update=["region"], when="not (t.region <=> s.region)")


def default_member(spark: SparkSession, ddl: str, key: str, **values: object) -> DataFrame:
    """One row of key -1; text columns are ``Unknown`` unless given, other columns null."""
    blank = spark.createDataFrame([tuple(None for _ in columns(ddl))], ddl)
    kinds = dict(blank.dtypes)
    value = lambda c: F.lit(UNKNOWN_KEY) if c == key else F.lit(values[c]) if c in values else F.lit("Unknown") if kinds[c] == "string" else F.lit(None)
    return blank.select(*(value(c).cast(kinds[c]).alias(c) for c in blank.columns))


def with_default(existing: DataFrame, key: str, member: DataFrame) -> DataFrame:
    """``existing`` and the default member, unless it is there."""
    return existing.unionByName(member.join(existing.where(F.col(key) == UNKNOWN_KEY).select(key), key, "left_anti").select(*existing.columns))


def lookup_geography(df: DataFrame, geography: DataFrame, source_region: str | None = None) -> DataFrame:
    """``df`` with the key of its place: region, state, city and zip code, nulls being equal."""
    region_ = region("state", F.col(source_region) if source_region else F.lit(None).cast("string"))
    g = geography.where(F.col("geography_key") != UNKNOWN_KEY).alias("g")
    same = F.col("d._region").eqNullSafe(F.col("g.region"))
    for c in ("state", "city", "zip_code"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}"))
    return df.withColumn("_region", region_).alias("d").join(g, same, "left").select("d.*", F.col("g.geography_key")).drop("_region")


def categories(products: DataFrame) -> DataFrame:
    return products.select(F.col("category").alias("category_name")).distinct()


def subcategories(products: DataFrame, category_dim: DataFrame) -> DataFrame:
    """Distinct subcategories with their category's key."""
    pairs = products.select("category", F.col("subcategory").alias("subcategory_name")).distinct()
    out = pairs.join(category_dim, F.col("category") == F.col("category_name")).select("category_key", "subcategory_name")
    return out


def require_mapped(places: DataFrame) -> None:
    require_no_rows(unmapped_states(places), "states of no known region", sample=20)
