"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: a space, or one of tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Lets the Python workers of a local session import this package from where the driver did, whatever their folder.

    On a cluster nothing is done: there the package goes with the job, as by ``--py-files``.
    """
    if not spark.sparkContext.master.startswith("local"):
        return
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; Spark's reader resolves the path, so any store that Spark reads will do."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's own tables, below ``spark.checkpoint.dir``, which driver and executors share.

    A local session without that setting (tests, trials) gets a temporary folder; on a cluster it is an error, as
    each machine would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/shelfmark-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder on any file system that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Removes all tables that operators have written for themselves; for jobs whose results are stored."""
    delete(spark, shared_folder(spark))


@contextmanager
def settings(spark: SparkSession, **values: str | int) -> Iterator[None]:
    """Jobs that are started meanwhile run under these settings; ``__`` stands for a dot."""
    wanted = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def collect_executors(spark: SparkSession, executors: int | None = None) -> None:
    """Collects the heap of every executor, by a job of one task for each, so that it shrinks to what is in use.

    Between jobs an executor's heap stays as large as it ever was, and buffers outside of it go only once it is collected;
    both count beside the Python workers. If an executor is busy with other jobs, another may get its task: nothing
    depends on it. Local sessions run their tasks in the driver, where
    ``Scratch`` collects already.
    """
    if executors is None:
        executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if executors > 0:
        collected = F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("collected")
        spark.range(0, executors, 1, executors).select(collected).write.format("noop").mode("overwrite").save()


class Scratch:
    """Tables that an operator writes for itself and reads again.

    Writing cuts the lineage: a lost executor makes Spark reread these files, not recompute what led to them. Spark
    removes the shuffle files of such a job at its end, as nothing reads them again. ``drop`` deletes what no later
    step reads; what the operator's lazy result still reads stays until ``release``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            df.write.parquet(path)
        # Plans of many exchanges leave the driver's heap grown, and shuffles and broadcasts go once it is collected.
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame, path in list(self.paths):
            if any(frame is f for f in frames):
                delete(self.spark, path)
                self.paths.remove((frame, path))


def own_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has that name (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
