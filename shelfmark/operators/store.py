"""A versioned Parquet table store with merges, on any file system that Spark reads.

A table is a folder of part folders and one pointer file that lists the live ones. Writers add a part folder and
then replace the pointer by a rename, so a reader sees the old state or the new one, and a write that fails
leaves the old one. A read pins the parts of the moment. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expressions import all_equal
from .checks import require_columns, require_no_rows, require_unique


@dataclass(frozen=True)
class Staged:
    """A table's next version before it is published."""

    name: str
    part: str
    schema: StructType
    frame: DataFrame


class TableStore:
    """Tables under ``root``; names may hold slashes, as in ``silver/invoices``."""

    POINTER = "_CURRENT"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _state(self, name: str) -> dict | None:
        path = self._path(name, self.POINTER)
        if not self._fs().exists(path):
            return None
        stream = self._fs().open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, name: str, parts: list[str], schema: StructType, version: int) -> None:
        """Write the pointer under another name, then rename it over the old one."""
        draft = self._path(name, f".{self.POINTER}.{uuid.uuid4().hex}")
        stream = self._fs().create(draft, True)
        stream.write(bytearray(json.dumps({"version": version, "parts": parts, "schema": schema.jsonValue()}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        options = self._spark_array([self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE])
        context.rename(draft, self._path(name, self.POINTER), options)

    def _spark_array(self, values: list):
        gateway = self.spark.sparkContext._gateway
        out = gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def _write_part(self, name: str, df: DataFrame, version: int) -> str:
        part = f"v={version}-{uuid.uuid4().hex[:8]}"
        df.write.parquet("/".join([self.root, name, part]))
        return part

    def exists(self, name: str) -> bool:
        return self._state(name) is not None

    def version(self, name: str) -> int:
        return (self._state(name) or {"version": 0})["version"]

    def require(self, names: list[str]) -> None:
        """Raise naming every table that is not there."""
        if missing := [n for n in names if not self.exists(n)]:
            raise LookupError(f"missing tables: {', '.join(missing)}")

    def tables(self, prefix: str = "") -> list[str]:
        """Names of the tables below ``prefix``, sorted."""
        top = self._path(prefix) if prefix else self._path()
        if not self._fs().exists(top):
            return []
        found, at = [], len(self._fs().makeQualified(self._path()).toString()) + 1
        files = self._fs().listFiles(top, True)
        while files.hasNext():
            path = files.next().getPath()
            if path.getName() == self.POINTER:
                found.append(path.getParent().toString()[at:])
        return sorted(found)

    def read(self, name: str) -> DataFrame:
        state = self._state(name)
        if state is None:
            raise LookupError(f"missing tables: {name}")
        schema = StructType.fromJson(state["schema"])
        if not state["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*("/".join([self.root, name, p]) for p in state["parts"]))

    def create(self, name: str, ddl: str) -> None:
        """An empty table, unless there is one."""
        if not self.exists(name):
            self._publish(name, [], self.spark.createDataFrame([], ddl).schema, 0)

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def overwrite(self, name: str, df: DataFrame) -> DataFrame:
        """A new version that holds ``df``, which may read the table itself."""
        return self.publish(self.stage(name, df))[0]

    def stage(self, name: str, df: DataFrame) -> Staged:
        """``df`` written beside the table's live parts; readers don't see it until it is published."""
        part = self._write_part(name, df, self.version(name) + 1)
        return Staged(name, part, df.schema, self.spark.read.schema(df.schema).parquet("/".join([self.root, name, part])))

    def publish(self, *staged: Staged) -> list[DataFrame]:
        """Staged tables become the live ones, each by one rename."""
        for s in staged:
            self._publish(s.name, [s.part], s.schema, self.version(s.name) + 1)
        return [self.read(s.name) for s in staged]

    def vacuum(self, *names: str) -> list[str]:
        """Removes part folders that no pointer names: replaced versions, and what failed runs left. Returns them.

        For times when nothing reads or writes the tables, as a read pins the parts of its moment.
        """
        gone = []
        for name in names or self.tables():
            live = set((self._state(name) or {"parts": []})["parts"])
            for status in self._fs().listStatus(self._path(name)):
                part = status.getPath().getName()
                if part.startswith("v=") and part not in live:
                    self._fs().delete(status.getPath(), True)
                    gone.append(f"{name}/{part}")
        return sorted(gone)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """The table and ``df``; what was there is not rewritten."""
        state = self._state(name)
        if state is None:
            return self.overwrite(name, df)
        schema = StructType.fromJson(state["schema"])
        require_columns(df, schema.names, name)
        version = state["version"] + 1
        part = self._write_part(name, df.select(*(F.col(f.name).cast(f.dataType) for f in schema)), version)
        self._publish(name, [*state["parts"], part], schema, version)
        return self.read(name)

    def append_new(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        """Append the rows whose keys, nulls being equal, the table doesn't have."""
        if not self.exists(name):
            return self.overwrite(name, df)
        return self.append(name, missing_rows(df, self.read(name), keys))

    def merge(self, name: str, source: DataFrame, keys: list[str], *, update: list[str] | None = None, when: str | None = None, nullable_keys: bool = False) -> DataFrame:
        """Upsert; see ``merged``. Columns and keys are checked first; an empty source changes nothing."""
        if not self.exists(name):
            require_merge_keys(source, keys, nullable_keys, name)
            return self.overwrite(name, source)
        target = self.read(name)
        require_columns(source, target.columns, name)
        if source.isEmpty():
            return target
        require_merge_keys(source, keys, nullable_keys, name)
        return self.overwrite(name, merged(target, source, keys, update=update, when=when))


def require_merge_keys(source: DataFrame, keys: list[str], nullable: bool, what: str) -> None:
    if not nullable:
        require_no_rows(source.where(" or ".join(f"`{k}` is null" for k in keys)).select(*keys), f"null key for {what}")
    require_unique(source, keys, f"source of {what}")


def missing_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose keys ``target`` doesn't have; nulls are equal."""
    return source.alias("s").join(target.select(*keys).alias("t"), all_equal("s", "t", keys), "left_anti")


def merged(target: DataFrame, source: DataFrame, keys: list[str], *, update: list[str] | None = None, when: str | None = None) -> DataFrame:
    """Target rows with ``update`` (all but the keys) taken from the source row of their key, and the new rows.

    ``when``: a condition on ``t`` and ``s`` without which a row stays as it is. One full outer join on hashable
    keys; nulls are equal.
    """
    update = update if update is not None else [c for c in target.columns if c not in keys]
    t = target.select("*", F.lit(True).alias("_in_target")).alias("t")
    s = source.select(*target.columns, F.lit(True).alias("_in_source")).alias("s")
    fresh = F.col("t._in_target").isNull()
    change = F.col("s._in_source").isNotNull() & (F.coalesce(F.expr(when), F.lit(False)) if when else F.lit(True))
    value = lambda c: F.when(fresh | (change if c in update else F.lit(False)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
    return t.join(s, all_equal("t", "s", keys), "full").select(*(value(c).alias(c) for c in target.columns))
