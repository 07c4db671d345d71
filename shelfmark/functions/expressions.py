"""Column expressions of the retail model. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import DATE_FORMATS, FALSE_WORDS, REGION_STATES, TRUE_WORDS

MONEY, MONEY_SUM = "decimal(18,2)", "decimal(20,2)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_blank(c: str | Column) -> Column:
    """Whether there is more than white space; false, not null, for a null."""
    return F.coalesce(F.length(F.trim(col(c).cast("string"))) > 0, F.lit(False))


def parse_date(c: str | Column) -> Column:
    """The date of a text in one of the accepted spellings; null for others."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS)).cast("date")


def parse_decimal(c: str | Column) -> Column:
    return F.trim(col(c)).try_cast(MONEY)


def parse_long(c: str | Column) -> Column:
    return F.trim(col(c)).try_cast("bigint")


def parse_boolean(c: str | Column) -> Column:
    """True, false, or null for an unknown word."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def region_of_state(state: str | Column) -> Column:
    """The region of a state's abbreviation, whatever its case; null for an unknown or null one."""
    code = F.upper(F.trim(col(state)))
    known = reduce(lambda chain, item: chain.when(code.isin(*item[1]), item[0]), REGION_STATES.items(), F.when(F.lit(False), F.lit("")))
    return known


def region(state: str | Column, source_region: str | Column) -> Column:
    """The state's region; without one, the source's own in title case."""
    return F.coalesce(region_of_state(state), F.initcap(F.trim(col(source_region))))


def line_revenue(quantity: str | Column = "quantity", price: str | Column = "unit_price", discount: str | Column = "discount") -> Column:
    """Quantity times price less the discount, an absolute amount."""
    return (col(quantity) * col(price) - F.coalesce(col(discount), F.lit(0).cast(MONEY))).cast(MONEY_SUM)


def line_cost(quantity: str | Column = "quantity", cost: str | Column = "cost") -> Column:
    return (col(quantity) * F.coalesce(col(cost), F.lit(0).cast(MONEY))).cast(MONEY_SUM)


def date_key(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyyMMdd").cast("int")


def month_date_key(c: str | Column) -> Column:
    """The key of the month's first day."""
    return date_key(F.trunc(col(c), "month"))


def calendar(c: str | Column) -> dict[str, Column]:
    """The attributes of a day."""
    d = col(c)
    weekday = F.dayofweek(d)
    return {
        "date_key": date_key(d),
        "full_date": d,
        "day": F.dayofmonth(d),
        "day_of_week": weekday,
        "day_name": F.date_format(d, "EEEE"),
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "month_name": F.date_format(d, "MMMM"),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "year_month": F.date_format(d, "yyyy-MM"),
        "year_quarter": F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")),
        "is_weekend": weekday.isin(1, 7),
        "is_month_start": F.dayofmonth(d) == 1,
        "is_month_end": F.last_day(d) == d,
    }


def ratio(part: str | Column, whole: str | Column, kind: str = "decimal(18,6)") -> Column:
    """A ratio of two sums; null where the whole is zero or null."""
    return F.try_divide(col(part).cast("decimal(28,6)"), F.nullif(col(whole).cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))).cast(kind)


def attribute_hash(columns: list[str]) -> Column:
    """A hash of the columns in which a null differs from every text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def spread(df: DataFrame, key: str, given: Column) -> Column:
    """A join key that deals rows without a key out over all tasks: the key, or a hash of the row.

    The join's condition must hold ``given`` too, as a hash may happen to be a key.
    """
    return F.when(given, F.col(key)).otherwise(F.xxhash64(*df.columns).cast(df.schema[key].dataType))


def row_id(path: str | Column, index: str | Column) -> Column:
    """The identity of a row of a file: its path and place, whatever the split it was read in."""
    return F.sha2(F.concat_ws("|", col(path), col(index).cast("string")), 256)


def any_difference(left: str, right: str, columns: list[str]) -> Column:
    """Whether any column of two aliased frames differs, a null being equal to a null only."""
    return reduce(lambda a, b: a | b, (~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def all_equal(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of columns of two aliased frames; Spark can still hash them."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two frames of one row each as one row: the other is a scalar subquery, not a join."""
    row = other.select(F.struct("*")).scalar().alias("_row")
    return one.select("*", row).select(*(F.col(c) for c in one.columns), "_row.*")
