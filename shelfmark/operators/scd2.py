"""Type-2 dimensions: versions of an entity, each valid from a start up to, but not including, its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import attribute_hash, spread
from ..functions.fixed_values import FIRST_START, OPEN_END, UNKNOWN_KEY
from .checks import CheckFailed, require_no_rows, require_unique
from .keys import next_key, with_keys


def changes(source: DataFrame, dimension: DataFrame, natural: str, tracked: list[str]) -> DataFrame:
    """Source rows that are new or differ from their current version, with ``_known`` telling which.

    A difference is one of the hashes of the tracked attributes.
    """
    hashed = source.withColumn("attribute_hash", attribute_hash(tracked))
    current = dimension.where("is_current").select(F.col(natural).alias("_nk"), F.col("attribute_hash").alias("_hash"))
    joined = hashed.join(current, F.col(natural) == F.col("_nk"), "left")
    return joined.where(F.col("_nk").isNull() | ~F.col("attribute_hash").eqNullSafe(F.col("_hash"))).withColumn("_known", F.col("_nk").isNotNull()).drop("_nk", "_hash")


def merge_scd2(source: DataFrame, dimension: DataFrame, natural: str, key: str, tracked: list[str], as_of: str, first_seen: str | None = None) -> DataFrame:
    """The dimension after a load at ``as_of``: changed versions close and their successors open at that moment.

    A new entity's first version starts at its ``first_seen`` date, the earliest transaction, so that sales
    before the load find it; without one, at the beginning of time. One timestamp serves the whole load, and
    both changes are one result, so nothing is computed from a half-changed table.
    """
    require_no_rows(source.where(F.col(natural).isNull()), f"null {natural}")
    require_unique(source, [natural], f"source of {key}")
    now = F.lit(as_of).cast("timestamp")
    changed = changes(source, dimension, natural, tracked)
    start = F.col(first_seen).cast("timestamp") if first_seen else F.lit(None).cast("timestamp")
    opened = changed.withColumns(
        {
            "effective_from": F.when(F.col("_known"), now).otherwise(F.coalesce(start, F.lit(FIRST_START).cast("timestamp"))),
            "effective_to": F.lit(OPEN_END).cast("timestamp"),
            "is_current": F.lit(True),
        }
    )
    opened = with_keys(opened, key, [natural], next_key(dimension, key)).select(*dimension.columns)
    closing = changed.where("_known").select(F.col(natural).alias("_nk"))
    held = dimension.join(closing, (F.col(natural) == F.col("_nk")) & F.col("is_current"), "left")
    closed = held.withColumn("effective_to", F.when(F.col("_nk").isNotNull(), now).otherwise(F.col("effective_to"))).withColumn("is_current", F.col("is_current") & F.col("_nk").isNull())
    return closed.select(*dimension.columns).unionByName(opened)


def versions_from_log(log: DataFrame, natural: list[str], at: str, tie: list[str]) -> DataFrame:
    """A log of changes as versions, each closed by the next one's start. ``tie`` orders changes of one moment."""
    window = Window.partitionBy(*natural).orderBy(at, *tie)
    end = F.lead(at).over(window)
    return log.withColumns({"effective_from": F.col(at), "effective_to": F.coalesce(end, F.lit(OPEN_END).cast(log.schema[at].dataType)), "is_current": end.isNull()})


def holds_at(moment: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Whether a version holds at a moment: from its start on, before its end."""
    return (moment >= F.col(start)) & (moment < F.col(end))


def as_of_join(facts: DataFrame, dimension: DataFrame, natural: str, date: str, take: list[str]) -> DataFrame:
    """``facts`` with the columns ``take`` of the version that held at their date; null where none did.

    An equi-join on the natural key with the interval as a residual condition, so it hashes or sorts on the key;
    rows without one are dealt out rather than meeting in one task.
    """
    versions = dimension.select(F.col(natural).alias("_nk"), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), *take)
    dealt = facts.withColumn("_key", spread(facts, natural, F.col(natural).isNotNull()))
    held = F.col(natural).isNotNull() & (F.col("_key") == F.col("_nk")) & holds_at(F.col(date).cast("timestamp"), "_from", "_to")
    return dealt.join(versions, held, "left").drop("_key", "_nk", "_from", "_to")


def as_of_matches(facts: DataFrame, dimension: DataFrame, natural: str, date: str, row: list[str]) -> DataFrame:
    """How many versions each row with a natural key finds; one is right."""
    with_key = facts.where(F.col(natural).isNotNull())
    mark = dimension.withColumn("_hit", F.lit(1))
    return as_of_join(with_key, mark, natural, date, ["_hit"]).groupBy(*row).agg(F.count("_hit").alias("matches"))


def require_single_match(facts: DataFrame, dimension: DataFrame, natural: str, date: str, row: list[str], what: str) -> None:
    require_no_rows(as_of_matches(facts, dimension, natural, date, row).where("matches != 1"), f"{what}: a row has no version or several")


def overlaps(dimension: DataFrame, natural: str, key: str) -> DataFrame:
    """All pairs of an entity's versions of which the later starts before the earlier ends.

    A running maximum of their ends cuts the versions into runs that hang together. Only the versions of a run of
    several are paired, so sound entities cost no join rows.
    """
    order = Window.partitionBy(natural).orderBy("effective_from", key)
    before = F.max("effective_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = dimension.select(natural, F.col(key).alias("_key"), "effective_from", "effective_to", F.when(F.col("effective_from") < before, 0).otherwise(1).alias("_starts"))
    runs = starts.withColumn("_run", F.sum("_starts").over(Window.partitionBy(natural).orderBy("effective_from", "_key")))
    several = runs.withColumn("_n", F.count("*").over(Window.partitionBy(natural, "_run"))).where("_n > 1")
    a, b = (several.select(natural, "_run", *(F.col(c).alias(f"{c}{i}") for c in ("_key", "effective_from", "effective_to"))) for i in (1, 2))
    later = (F.col("effective_from2") > F.col("effective_from1")) | ((F.col("effective_from2") == F.col("effective_from1")) & (F.col("_key2") > F.col("_key1")))
    pairs = a.join(b, [natural, "_run"]).where(later & (F.col("effective_from2") < F.col("effective_to1")))
    return pairs.select(natural, F.col("_key1").alias("version_key"), F.col("_key2").alias("next_key"))


def faults(dimension: DataFrame, natural: str, key: str) -> dict[str, DataFrame]:
    """Frames of rows that must not exist: empty intervals, entities without just one current version, overlaps."""
    known = dimension.where(F.col(key) != UNKNOWN_KEY)
    return {
        "empty_interval": known.where("effective_from >= effective_to"),
        "not_one_current": known.groupBy(natural).agg(F.count_if("is_current").alias("n_current")).where("n_current != 1"),
        "overlap": overlaps(known, natural, key),
    }


def require_sound(dimension: DataFrame, natural: str, key: str) -> None:
    for what, rows in faults(dimension, natural, key).items():
        try:
            require_no_rows(rows, what)
        except CheckFailed as e:
            raise CheckFailed(f"{key}: {e}") from None
