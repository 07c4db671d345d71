"""Surrogate keys."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_key(existing: DataFrame | None, key: str) -> int:
    """The largest key in use; 0 where only the default member, or nothing, is there."""
    if existing is None:
        return 0
    return max(0, existing.agg(F.max(key)).first()[0] or 0)


def with_small_keys(df: DataFrame, key: str, order: list[str], after: int = 0) -> DataFrame:
    """Consecutive keys in the order of ``order``, nulls first. One task numbers all rows: for dimensions only."""
    window = Window.orderBy(*(F.col(c).asc_nulls_first() for c in order))
    return df.withColumn(key, (F.row_number().over(window) + F.lit(after)).cast("bigint"))


def with_keys(df: DataFrame, key: str, order: list[str], after: int = 0, partitions: int | None = None) -> DataFrame:
    """The same keys for tables of any size.

    Rows are range-partitioned and sorted; the partitions' row counts, one number each, come to the driver and
    go back as offsets. ``order`` must tell the rows apart. The ranges are kept, for both passes must see the
    same ones: sampling them anew could draw other bounds.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *by).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], after
    for part in range(max(sizes, default=-1) + 1):
        offsets.append((part, total))
        total += sizes.get(part, 0)
    starts = df.sparkSession.createDataFrame(offsets or [(0, after)], "_part int, _start bigint")
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    return numbered.join(F.broadcast(starts), "_part").withColumn(key, F.col("_start") + F.col("_row")).drop("_part", "_start", "_row")
