"""An optional JDBC source. One connection reads one snapshot; parallel reads would see several."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def options(url: str, schema: str, table: str, fetch: int = 50_000, **more: str) -> dict[str, str]:
    """Reader options for a whole table in one repeatable-read transaction, streamed in batches."""
    return {"url": url, "dbtable": f"{quoted(schema)}.{quoted(table)}", "fetchsize": str(fetch), "sessionInitStatement": "SET SESSION CHARACTERISTICS AS TRANSACTION ISOLATION LEVEL REPEATABLE READ", "isolationLevel": "REPEATABLE_READ"} | more


def read(spark: SparkSession, url: str, schema: str, table: str, **more: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options(url, schema, table, **more)).load()


def base_tables(spark: SparkSession, url: str, schema: str, wanted: list[str] | None = None, **more: str) -> list[str]:
    """Names of the schema's base tables: all, sorted, or those wanted in that order. Unknown names are an error."""
    sql = "(SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema = '" + schema.replace("'", "''") + "') t"
    found = {r[0] for r in spark.read.format("jdbc").options(**(options(url, schema, "x", **more) | {"dbtable": sql})).load().collect()}
    return chosen_tables(found, wanted)


def chosen_tables(found: set[str], wanted: list[str] | None) -> list[str]:
    if not wanted:
        return sorted(found)
    if unknown := [t for t in wanted if t not in found]:
        raise LookupError(f"unknown tables: {', '.join(unknown)}")
    return list(dict.fromkeys(wanted))
