"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of n shingles is in a document if at least ``ceil(threshold * n)`` of them are. The items are
partitioned by n (powers of two). An item's sketch is its bottom-k MinHash values, with ``k = n - ceil(threshold *
n) + 1``: any set that holds enough of the item's shingles holds one of those k, so the search misses nothing,
however long the document. A partition's largest sketch value is the partition's bound: a document's own sketch
for the partition is its hashes up to that bound, and a document smaller than the partition's least overlap
skips it. Candidates are verified by the shingles' words.

Banded MinHash signatures of fixed length can't find forty words in twenty thousand (the Jaccard similarity is
0.002), whatever the size partition; that is why sketches grow with the sets here.

The index of a block of items is broadcast, and a block is bounded by the bytes of its texts; further blocks are
further passes over the documents (one for each 16 MB of benchmark by default; benchmarks are small beside a
corpus), each with a broadcast that stays as long as the result may be read. Documents are never shuffled or collected.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import own_name, read_table
from .shingles import WIDTH, shingle_set, shingles, word_hashes, words_of


@dataclass
class Partition:
    """Items of one shingle width and size class: sorted sketch values and the item of each."""

    width: int
    least: int
    values: list = field(default_factory=list)
    items: list = field(default_factory=list)

    def freeze(self) -> None:
        order = np.argsort(np.array(self.values, np.uint64), kind="stable")
        self.values = np.array(self.values, np.uint64)[order]
        self.items = np.array(self.items, np.int64)[order]


class ItemIndex:
    """Sketches of items by size partition, and their shingles as words, for the verification."""

    def __init__(self, items: list[tuple], threshold: float, width: int = WIDTH) -> None:
        self.ids, self.sets, self.need, self.width = [], [], [], []
        parts: dict[tuple[int, int], Partition] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            own = min(width, len(words))
            hashes = shingle_set(words, width)
            need = math.ceil(threshold * len(hashes) - 1e-9)
            key = (own, len(hashes).bit_length())
            part = parts.setdefault(key, Partition(own, need))
            part.least = min(part.least, need)
            sketch = hashes[: len(hashes) - need + 1]
            part.values += sketch.tolist()
            part.items += [len(self.ids)] * len(sketch)
            self.ids.append(item)
            self.sets.append({tuple(words[i : i + own]) for i in range(len(words) - own + 1)})
            self.need.append(need)
            self.width.append(own)
        self.parts = list(parts.values())
        for part in self.parts:
            part.freeze()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """``(item, shared shingles)`` of the items that the text holds."""
        words = words_of(text)
        if not words:
            return []
        hashes = word_hashes(words)
        by_width: dict[int, np.ndarray] = {}
        found: dict[int, None] = {}
        for part in self.parts:
            if part.width not in by_width:
                by_width[part.width] = shingles(hashes, part.width)
            own = by_width[part.width]
            if len(own) < part.least:
                continue
            sketch = own[own <= part.values[-1]]
            at = np.searchsorted(part.values, sketch)
            hits = np.unique(sketch[part.values[at] == sketch])
            for i in np.unique(part.items[np.isin(part.values, hits)]):
                found[int(i)] = None
        out, sets = [], defaultdict(set)
        for i in found:
            width = self.width[i]
            if not sets[width]:
                sets[width] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
            shared = len(self.sets[i] & sets[width])
            if shared >= self.need[i]:
                out.append((i, shared))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most ``most_bytes`` of text (or one item), streamed through the driver."""
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        n = len((row[1] or "").encode())
        if block and size + n > most_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, threshold: float = 0.75, most_bytes: int = 16_000_000) -> DataFrame:
    """``id_col, item_col, shared, item_shingles, containment``: a row for each row and item that it holds.

    Shingles are five words; an item of fewer words is one shingle of them all. Null and empty texts hold and
    are nothing. Repeated rows are rows of their own, and so are repeated items. Without rows or items the
    result is empty. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    doc_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    item_arrow = to_arrow_type(item_type)
    item_name = item_col if item_col != id_col else f"{item_col}_item"
    schema = f"`{id_col}` {doc_type.simpleString()}, `{item_name}` {item_type.simpleString()}, shared long, item_shingles long, containment double"
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(blocks(items, item_col, item_text_col, most_bytes)):
        held = spark.sparkContext.broadcast(ItemIndex(block, threshold))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    got = index.matches(text)
                    rows += [row] * len(got)
                    found += got
                if rows:
                    sizes = [len(index.sets[i]) for i, _ in found]
                    shared = [s for _, s in found]
                    ids = batch.column(0).take(pa.array(rows))
                    item_ids = pa.array([index.ids[i] for i, _ in found], item_arrow)
                    yield pa.RecordBatch.from_arrays([ids, item_ids, pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()), pa.array([s / z for s, z in zip(shared, sizes)], pa.float64())], names=[id_col, item_name, "shared", "item_shingles", "containment"])

        part = docs.select(id_col, text_col).mapInArrow(search, schema)
        out = part if n == 0 else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", *, threshold: float = 0.75, most_bytes: int = 16_000_000) -> DataFrame:
    """``docs`` without the rows that hold an item; columns as they were. Edge cases are as in ``find_leaks``."""
    spark = docs.sparkSession
    for block in blocks(items.select(F.lit(0).alias("i"), F.col(item_text_col).alias("t")), "i", "t", most_bytes):
        held = spark.sparkContext.broadcast(ItemIndex(block, threshold))

        @F.pandas_udf("boolean")
        def holds(texts, held=held):
            import pandas as pd

            return pd.Series([bool(held.value.matches(t)) for t in texts], dtype="bool")

        flag = own_name(docs, "_leak")
        docs = docs.withColumn(flag, holds(F.coalesce(F.col(text_col), F.lit("")))).where(~F.col(flag)).drop(flag)
    return docs


def op3_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it holds at least three quarters of."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, r, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM d WHERE len(w) >= 5
), its AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM i WHERE len(w) >= 5
), n AS (SELECT k, count(*) AS n FROM its GROUP BY k)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS shared, CAST(max(n) AS BIGINT) AS item_shingles, count(*) / CAST(max(n) AS DOUBLE) AS containment
FROM ds JOIN its USING (s) JOIN n USING (k)
GROUP BY r, k, doc_id, item_id HAVING 100 * count(*) >= 75 * max(n)
"""
