"""Guards that stop a load and tests that report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(RuntimeError):
    """Rows were found that must not exist."""


def require_no_rows(df: DataFrame, what: str, sample: int = 10) -> None:
    """Raise with up to ``sample`` of the rows, if there are any."""
    rows = df.limit(sample).collect()
    if rows:
        raise CheckFailed(f"{what}: {[r.asDict() for r in rows]}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, nulls being equal, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    require_no_rows(duplicates(df, keys), f"{what} has several rows for a key")


def require_columns(df: DataFrame, wanted: list[str], what: str, ordered: bool = False) -> None:
    """Raise unless the columns are those wanted, in that order if asked for."""
    missing, extra = sorted(set(wanted) - set(df.columns)), sorted(set(df.columns) - set(wanted))
    if missing or extra or (ordered and df.columns != wanted):
        raise CheckFailed(f"{what}: missing {missing}, extra {extra}" + (", order differs" if not (missing or extra) else ""))
