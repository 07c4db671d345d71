"""The training-data pipeline: five operators of ``shelfmark.llm`` in turn, each on all that the one before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All
but the last return the columns of ``documents``. Each first has the executors collect what the one before left in their heaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import collect_executors, delete, read_table, shared_path
from shelfmark.llm.decontamination import drop_leaks
from shelfmark.llm.jaccard_join import keep_one
from shelfmark.llm.learning import in_training
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.secrets import drop_live_secrets
from shelfmark.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that compression distance calls toxic; the model is trained on labelled ones of them."""
    collect_executors(spark)
    labels = read_table(spark, sf_dir, "labels").where(in_training("doc_id"))
    return drop_toxic(docs, fit_toxicity(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id."""
    collect_executors(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    collect_executors(spark)
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a live secret; copied examples and placeholders are no reason to go."""
    collect_executors(spark)
    return drop_live_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces of sequences of at most 2048 tokens."""
    collect_executors(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    A stage's table is deleted once the next one has been written.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
