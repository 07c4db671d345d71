"""RAW files to Bronze: incremental, with the lineage of every row, as a batch or as a stream.

A row is known by its file and its place in the file, so a file that is read again gives the same ids, and a
merge on them makes a repeated load harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import row_id
from ..operators.checks import require_columns
from ..operators.store import TableStore
from ..plans.schemas import BRONZE, SOURCE, columns
from ..sources.files import discover

LOG = "bronze/_file_ingestion_log"
LOG_DDL = "table_name string, source_file_path string, status string, processed_utc timestamp"


def with_lineage(df: DataFrame, as_of: str) -> DataFrame:
    """Business columns as text, and the file, row id and times of every row. ``df`` is a fresh file scan."""
    now = F.lit(as_of).cast("timestamp")
    names = [c for c in df.columns if not c.startswith("_")]
    return df.select(
        *(F.col(c).cast("string") for c in names),
        now.alias("_insert_datetime_utc"),
        now.alias("_update_datetime_utc"),
        F.col("_metadata.file_name").alias("_source_file_name"),
        row_id("_metadata.file_path", "_metadata.row_index").alias("_source_row_id"),
    )


def merge_bronze(store: TableStore, table: str, rows: DataFrame) -> None:
    """Upsert by row id; the time of the first load stays."""
    require_columns(rows, columns(BRONZE[table]), f"bronze {table}", ordered=True)
    store.create(f"bronze/{table}", BRONZE[table])
    update = [c for c in rows.columns if c not in ("_source_row_id", "_insert_datetime_utc")]
    store.merge(f"bronze/{table}", rows, ["_source_row_id"], update=update)


def append_bronze(store: TableStore, table: str, rows: DataFrame) -> None:
    """Rows of files that the table doesn't have; what is there is not rewritten."""
    require_columns(rows, columns(BRONZE[table]), f"bronze {table}", ordered=True)
    store.create(f"bronze/{table}", BRONZE[table])
    store.append(f"bronze/{table}", rows)


def processed(store: TableStore, table: str) -> set[str]:
    """Paths of the files that have been loaded."""
    return logged(store, table, "SUCCESS")


def logged(store: TableStore, table: str, status: str) -> set[str]:
    """Paths that the log has with a status: one short text for each file."""
    if not store.exists(LOG):
        return set()
    log = store.read(LOG).where((F.col("table_name") == table) & (F.col("status") == status))
    return {r[0] for r in log.select("source_file_path").distinct().collect()}


def mark(store: TableStore, table: str, paths: list[str], as_of: str, status: str = "SUCCESS") -> None:
    if not paths:
        return
    store.create(LOG, LOG_DDL)
    rows = store.spark.createDataFrame([(table, p, status) for p in paths], "table_name string, source_file_path string, status string")
    store.append(LOG, rows.withColumn("processed_utc", F.lit(as_of).cast("timestamp")))


def ingest(spark: SparkSession, store: TableStore, raw: str, table: str, as_of: str) -> list[str]:
    """Load the table's new files; returns their paths.

    They are logged before and after. Rows of a file that was never begun cannot be there yet, so they are
    appended; only files that an earlier run began and did not finish are merged.
    """
    new = discover(spark, raw, table, processed(store, table))
    begun = logged(store, table, "STARTED") & set(new)
    mark(store, table, [p for p in new if p not in begun], as_of, "STARTED")
    for paths, load in (([p for p in new if p not in begun], append_bronze), (sorted(begun), merge_bronze)):
        if paths:
            scan = spark.read.parquet(*paths)
            require_columns(scan, SOURCE[table], f"files of {table}", ordered=True)
            load(store, table, with_lineage(scan, as_of))
            mark(store, table, paths, as_of)
    return new


def ingest_stream(spark: SparkSession, store: TableStore, raw: str, table: str, checkpoint: str, as_of: str) -> int:
    """The same by a file stream that takes what is there and ends; its checkpoint knows the files it has seen.

    Returns the rows of this run. A batch that is repeated after a failure merges the same row ids again.
    """
    schema = ", ".join(f"{c} string" for c in SOURCE[table])
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}_????_??_??_part-?????*.parquet").parquet(raw)
    loaded = 0

    def load(batch: DataFrame, _: int) -> None:
        nonlocal loaded
        # The ids need the scan's own metadata, so they were made before the batch came here.
        loaded += batch.count()
        merge_bronze(store, table, batch)

    run = with_lineage(stream, as_of).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(load).start()
    run.awaitTermination()
    return loaded
