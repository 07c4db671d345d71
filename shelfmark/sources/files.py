"""File sources and sinks: CSV by header name, dated Parquet parts, discovery, manifests, uploads."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

PART = re.compile(r"^(?P<table>[A-Za-z0-9_]+?)_(?P<date>\d{4}_\d{2}_\d{2})_part-(?P<number>\d{5,})\.parquet$")


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.at().getFileSystem(self._conf)

    def at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name) if name else self.at())

    def names(self) -> list[str]:
        """Names of the files right in the folder, sorted."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at()) if s.isFile()) if self.exists() else []

    def files(self) -> list[str]:
        """Full paths of all files below, sorted."""
        out = []
        if self.exists():
            found = self._fs.listFiles(self.at(), True)
            while found.hasNext():
                out.append(found.next().getPath().toString())
        return sorted(out)

    def rename(self, source: str, name: str) -> None:
        if not self._fs.rename(self._jvm.org.apache.hadoop.fs.Path(source), self.at(name)):
            raise OSError(f"cannot rename {source} to {name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def make(self) -> None:
        self._fs.mkdirs(self.at())

    def write(self, name: str, text: str) -> None:
        """Write under another name, then rename, so that no half-written file is ever seen."""
        draft = f".{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self.at(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.delete(name)
        self.rename(f"{self.path}/{draft}", name)

    def copy_from(self, source: str, name: str) -> None:
        util = self._jvm.org.apache.hadoop.fs.FileUtil
        path = self._jvm.org.apache.hadoop.fs.Path(source)
        util.copy(path.getFileSystem(self._conf), path, self._fs, self.at(name), False, True, self._conf)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header as text columns, found by their names; columns that it lacks are null."""
    header = spark.read.csv(path, header=True, inferSchema=False)
    return header.select(*(F.col(c) if c in header.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_csv_if_there(spark: SparkSession, folder: str, names: list[str], columns: list[str]) -> DataFrame | None:
    """The first of the files that exists, as a full file and then a sample; None if there is none."""
    at = Folder(spark, folder)
    for name in names:
        if at.exists(name):
            return read_csv(spark, f"{folder}/{name}", columns)
    return None


def split_sales(raw: DataFrame, header: list[str], line: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct headers, and every line, of a table that repeats the header on each line."""
    return raw.select(*header).distinct(), raw.select(*line)


def transportable(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text and binary ones as hex; other types as they are."""
    nested = (ArrayType, MapType, StructType)
    value = lambda f: F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.hex(f.name).alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f.name)
    return df.select(*map(value, df.schema))


def typed_rows(spark: SparkSession, rows: list[dict], names: list[str]) -> DataFrame:
    """Rows of a source without declared types: each column's type is that of its first value, else text.

    A later value of another type is an error rather than a null.
    """
    import decimal

    from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, LongType, TimestampType

    def kind(value: object):
        for python, spark_type in ((bool, BooleanType()), (int, LongType()), (float, DoubleType()), (decimal.Decimal, DecimalType(38, 18)), (dt.datetime, TimestampType()), (dt.date, DateType()), (bytes, BinaryType())):
            if isinstance(value, python):
                return spark_type
        return StringType()

    plain = [{n: json.dumps(r.get(n), sort_keys=True) if isinstance(r.get(n), (dict, list)) else str(r[n]) if isinstance(r.get(n), uuid.UUID) else r.get(n) for n in names} for r in rows]
    first = {n: next((r[n] for r in plain if r[n] is not None), None) for n in names}
    schema = StructType([StructField(n, kind(first[n])) for n in names])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in plain], schema, verifySchema=True)


def part_name(table: str, date: dt.date, number: int) -> str:
    return f"{table}_{date:%Y_%m_%d}_part-{number:05d}.parquet"


def write_parts(df: DataFrame, folder: str, table: str, date: dt.date, *, rows_per_file: int = 500_000, compression: str = "snappy", overwrite: bool = False) -> dict:
    """Write a table as dated Parquet parts of at most so many rows, and its manifest; returns the manifest.

    Existing parts of the table and date are an error unless they may be overwritten. Parts are written aside
    and renamed into place, and those that they replace are moved aside until all are; a failure removes those of
    this call and puts the old ones back.
    """
    spark = df.sparkSession
    at = Folder(spark, folder)
    own = re.compile(re.escape(f"{table}_{date:%Y_%m_%d}_part-") + r"\d{5,}\.parquet$")
    existing = [n for n in at.names() if own.match(n)]
    if existing and not overwrite:
        raise FileExistsError(f"{len(existing)} parts of {table} for {date} are there")
    started = dt.datetime.now(dt.timezone.utc)
    source_rows = df.count()
    staging = f".staging-{uuid.uuid4().hex}"
    placed: list[str] = []
    aside: list[str] = []
    kept = f".replaced-{uuid.uuid4().hex}"
    try:
        at.make()
        transportable(df).write.option("maxRecordsPerFile", rows_per_file).option("compression", compression).parquet(f"{folder}/{staging}")
        written = [p for p in Folder(spark, f"{folder}/{staging}").files() if p.endswith(".parquet")]
        rows = spark.read.parquet(f"{folder}/{staging}").count()
        if rows != source_rows:
            raise RuntimeError(f"{table}: {source_rows} rows in the source, {rows} written")
        if existing:
            Folder(spark, f"{folder}/{kept}").make()
        for name in existing:
            at.rename(f"{at.path}/{name}", f"{kept}/{name}")
            aside.append(name)
        for i, path in enumerate(written):
            at.rename(path, part_name(table, date, i))
            placed.append(part_name(table, date, i))
    except Exception:
        for name in placed:
            at.delete(name)
        for name in aside:
            at.rename(f"{at.path}/{kept}/{name}", name)
        raise
    finally:
        at.delete(staging)
        at.delete(kept)
    manifest = {"table": table, "date": f"{date:%Y-%m-%d}", "started_utc": started.isoformat(), "finished_utc": dt.datetime.now(dt.timezone.utc).isoformat(), "source_rows": source_rows, "rows": rows, "reconciled": True, "compression": compression, "rows_per_file": rows_per_file, "files": placed, "columns": df.dtypes}
    at.write(f"{table}_{date:%Y_%m_%d}_manifest.json", json.dumps(manifest, indent=2))
    return manifest


def write_run_manifest(spark: SparkSession, folder: str, date: dt.date, manifests: list[dict]) -> dict:
    """One manifest for all tables of a run."""
    run = {"date": f"{date:%Y-%m-%d}", "tables": manifests, "rows": sum(m["rows"] for m in manifests), "reconciled": all(m["reconciled"] for m in manifests)}
    Folder(spark, folder).write(f"run_{date:%Y_%m_%d}_manifest.json", json.dumps(run, indent=2))
    return run


def discover(spark: SparkSession, folder: str, table: str, processed: set[str] = frozenset()) -> list[str]:
    """Paths of the table's parts that are not yet processed, sorted."""
    return [p for p in Folder(spark, folder).files() if p not in processed and (m := PART.match(p.rsplit("/", 1)[-1])) and m["table"] == table]


def upload(spark: SparkSession, source: str, target: str, *, date: str | None = None, file_name: str | None = None, manifests: bool = False, overwrite: bool = False) -> dict[str, list[str]]:
    """Copy parts to another folder: those of a date (``yyyy_MM_dd``), one file, or all; with manifests if wanted.

    A file that is there is skipped unless it may be overwritten. Returns the names copied and skipped.
    """
    if date is not None and not re.fullmatch(r"\d{4}_\d{2}_\d{2}", date):
        raise ValueError(f"not a date token: {date}")
    at, to = Folder(spark, source), Folder(spark, target)
    wanted = [n for n in at.names() if n == file_name or (file_name is None and (PART.match(n) or (manifests and n.endswith("_manifest.json"))) and (date is None or f"_{date}_" in n))]
    if not wanted:
        raise FileNotFoundError(f"nothing to upload in {source}")
    to.make()
    out: dict[str, list[str]] = {"copied": [], "skipped": []}
    for name in wanted:
        if to.exists(name) and not overwrite:
            out["skipped"].append(name)
            continue
        to.copy_from(f"{at.path}/{name}", name)
        out["copied"].append(name)
    return out
