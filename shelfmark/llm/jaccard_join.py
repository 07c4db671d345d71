"""Exact Jaccard join of documents on word shingles, with set-relation skipping.

Two documents link if their shingle sets have a Jaccard similarity of at least ``percent`` in 100. Linked sets
share one of the first ``n - ceil(percent * n / 100) + 1`` shingles of each in any common order, so the lists of
an index of those prefixes hold every pair. Relations between sets keep the lists from being paired out:

* Computed answers: in every list, sets are first compared with one set only, that of the earliest place, which
  is the least changed of a group of near copies. A set that links to it takes over its answers: it joins its
  component, and from then on only sets of different components are compared. What was computed also answers for
  pairs that were not compared: two sets share no more than what both share with the first one and what both have
  besides it, and a pair whose bound is too low is left out.
* Block skipping: the lists that still hold several components are cut into blocks by size, place and a salt. Two
  blocks of a list are skipped as a whole where their sizes and places rule out every pair, or where they hold
  one component only. One side of a pair is never of the list's largest component, so a group of near copies
  isn't paired with itself. Only the pairs of blocks that remain are paired out, each pair of blocks by itself.

The order puts rare shingles first (by hash) and frequent ones last (by document frequency, then hash), so
passages that many documents share head no prefix unless a document has little else. Frequencies are counted
over all documents; which of them are listed as frequent only affects speed.

Every step is a shuffle by hash range, list, block, set or component; lists that may be long are dealt out by a salt,
and so are the members of a component. Sets with equal shingles are one set from the start. What is broadcast is
bounded: at most ``most_frequent`` frequent shingles, and bitmaps of at most 2 ** 28 bits that only save
shuffling. Shingles are known by 64-bit hashes, sets by 128-bit hashes of theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, collect_executors, own_name, read_table, settings
from .shingles import shingle_set, words_of

DOC, ENTRY, PAIR = 0, 1, 2


def _node(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _nodes(ids: np.ndarray) -> pa.Array:
    """Rows of two 64-bit halves as 16 bytes each."""
    n = len(ids)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((16 * np.arange(n + 1)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def _rows(batches: Iterator[pa.RecordBatch], chunk: int = 256) -> Iterator[tuple]:
    """The rows of the batches, of which only ``chunk`` are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            yield from zip(*(c.slice(at, chunk).to_pylist() for c in batch.columns))


class Bitmap:
    """A bounded filter for ids of any type: never false for an id that it was built from."""

    def __init__(self, ids: DataFrame, col: str, most_bits: int = 1 << 28) -> None:
        self.n = ids.count()
        self.bits = min(most_bits, max(1 << 15, 1 << (64 * self.n).bit_length()))
        at = self.position(F.col(col)) + 1
        rows = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
        data = np.zeros(self.bits // 8, np.uint8)
        for r in rows:
            data[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        self.held = ids.sparkSession.sparkContext.broadcast(data)

    def position(self, id_col: Column) -> Column:
        return F.xxhash64(id_col).bitwiseAND(F.lit(self.bits - 1))

    def position_of(self, data: bytes) -> int:
        """The same for binary ids, outside of Spark."""
        return xxhash.xxh64_intdigest(data, 42) & (self.bits - 1)

    def may_hold(self, id_col: Column) -> Column:
        held = self.held

        @F.pandas_udf("boolean")
        def test(at: pd.Series) -> pd.Series:
            at = at.to_numpy()
            return pd.Series(held.value[at >> 3] >> (at & 7) & 1 == 1)

        return test(self.position(id_col))


@dataclass
class Counts:
    """What the corpus says of its shingles, in bounded space.

    ``tokens`` (leading 32 + ``bits`` hash bits) and ``n``: the frequent ones and how many rows have them.
    ``repeated``: a bitmap by the leading ``places`` hash bits; where it is 0, no shingle is in two rows.
    """

    tokens: np.ndarray
    n: np.ndarray
    repeated: np.ndarray
    places: int


def _counts(docs: DataFrame, text_col: str, rows: int, bits: int, above: int, most: int, scratch: Scratch) -> Counts:
    """Counts every shingle of every row; ``above`` and ``most`` bound which are listed as frequent.

    The bitmap has a bit for each shingle or so, up to 2 ** 28; beyond that it only tells less.
    """
    places = min(28, max(bits + 3, (512 * rows).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32))
            parts = [(k, v.astype("<u4"), c) for k, (v, c) in enumerate(zip(np.split(values, cuts), np.split(n, cuts))) if len(v)]
            out_ = [(k, v[c == 1].tobytes(), b"") for k, v, c in parts] + [(k, v[c > 1].tobytes(), c[c > 1].astype("<u4").tobytes()) for k, v, c in parts if (c > 1).any()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out_], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "tokens", "counts"])

        for (text,) in _rows(batches):
            own = shingle_set(words_of(text)) >> np.uint64(32 - bits)
            held.append(own)
            size += len(own)
            if size > 1 << 20:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def total(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        tokens = [np.frombuffer(x, "<u4") for x in table.column("tokens").to_pylist()]
        counts = [np.frombuffer(x, "<u4") if x else np.ones(len(t), "<u4") for x, t in zip(table.column("counts").to_pylist(), tokens)]
        values, where = np.unique(np.concatenate(tokens), return_inverse=True)
        n = np.bincount(where, np.concatenate(counts), len(values)).astype(np.int64)
        marks = np.zeros(1 << (places - bits), np.uint8)
        marks[values[n > 1] >> np.uint32(32 - places + bits)] = 1
        keep = n > above
        k = int(keep.sum())
        return pa.table(
            {
                "part": pa.array([part] * (k + 1), pa.int32()),
                "token": pa.array([*(values[keep].astype(np.int64) + (part << 32)).tolist(), None], pa.int64()),
                "n": pa.array([*n[keep].tolist(), None], pa.int64()),
                "marks": pa.array([None] * k + [np.packbits(marks, bitorder="little").tobytes()], pa.binary()),
            }
        )

    packed = docs.select(text_col).mapInArrow(count, "part int, tokens binary, counts binary")
    found = scratch.write(packed.groupBy("part").applyInArrow(total, "part int, token long, n long, marks binary"), "join-counts")
    often = found.where("token is not null").select("token", "n").orderBy(F.desc("n"), "token").limit(most).toArrow()
    tokens, n = often.column("token").to_numpy().astype(np.uint64), often.column("n").to_numpy()
    order = np.argsort(tokens)
    repeated = np.zeros((1 << places) // 8, np.uint8)
    slices = found.where("marks is not null").select("part", "marks").toArrow()
    for part, marks in zip(slices.column("part").to_pylist(), slices.column("marks").to_pylist()):
        size = len(marks)
        repeated[part * size : (part + 1) * size] = np.frombuffer(marks, np.uint8)
    scratch.drop(found)
    return Counts(tokens[order], n[order], repeated, places)


def _ordered(hashes: np.ndarray, tokens: np.ndarray, n: np.ndarray, shift: np.uint64) -> np.ndarray:
    """A set in the common order: rare shingles by hash, then frequent ones by frequency."""
    if not len(tokens):
        return hashes
    key = hashes >> shift
    at = np.minimum(np.searchsorted(tokens, key), len(tokens) - 1)
    often = tokens[at] == key
    if not often.any():
        return hashes
    last = hashes[often]
    return np.concatenate([hashes[~often], last[np.lexsort((last, n[at[often]]))]])


def _index(docs: DataFrame, id_col: str, text_col: str, percent: int, bits: int, counts: Counts, list_rows: int) -> DataFrame:
    """One table of three kinds of rows: each row's set; the lists' entries; and the sets compared first.

    A list's sets are each compared first with the one of the earliest place, so what is kept as its entries are
    the others, where there are two or more. A list of a shingle that more than ``list_rows`` rows have is dealt
    out in parts of about as many; each part has its own earliest set, and all are kept. Shingles of one row
    only are left out, as far as the bitmap tells.
    ``DOC``: ``id, a`` (set, null if empty), ``n``. ``ENTRY``: ``token, a, n, place, b`` (the earliest set).
    ``PAIR``: ``a, b``.
    """
    id_type, id_arrow = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    held = docs.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(32 - bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        top = np.uint64(64 - known.places)
        long = known.n > list_rows
        long_tokens, long_parts = known.tokens[long], -(-known.n[long] // list_rows)
        seen: set[bytes] = set()
        entries: list[tuple] = []
        docs_: list[tuple] = []
        size = round_ = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal round_
            rows = []
            if entries:
                token = np.concatenate([e[0] for e in entries])
                lengths = [len(e[0]) for e in entries]
                node = np.repeat(np.frombuffer(b"".join(e[1] for e in entries), np.uint64).reshape(-1, 2), lengths, axis=0)
                salt = np.zeros(len(token), np.int64)
                if len(long_tokens):
                    at = np.minimum(np.searchsorted(long_tokens, token >> shift), len(long_tokens) - 1)
                    is_long = long_tokens[at] == token >> shift
                    salt[is_long] = 1 + (node[is_long, 0] % long_parts[at[is_long]].astype(np.uint64)).astype(np.int64)
                part = (token >> np.uint64(64 - bits)).astype(np.int64)
                order = np.lexsort((token, salt, part))
                columns = (token, node, np.repeat(np.array([e[2] for e in entries], np.uint32), lengths), np.concatenate([e[3] for e in entries]))
                columns, part, salt = [c[order] for c in columns], part[order], salt[order]
                cuts = np.flatnonzero((part[1:] != part[:-1]) | (salt[1:] != salt[:-1])) + 1
                for at, *cells in zip(np.append(0, cuts).tolist(), *(np.split(c, cuts) for c in columns)):
                    rows.append((int(part[at]), int(salt[at]), *(c.tobytes() for c in cells), []))
            rows.append((round_ % (1 << bits), 0, b"", b"".join(d[1] for d in docs_), np.array([d[2] for d in docs_], np.uint32).tobytes(), b"", [d[0] for d in docs_]))
            round_ += 1
            types = (pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(id_arrow))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["part", "salt", "token", "a", "n", "place", "ids"])

        for row, text in _rows(batches):
            own = shingle_set(words_of(text))
            n = len(own)
            node = _node(own) if n else bytes(16)
            docs_.append((row, node, n))
            if n and node not in seen:
                seen.add(node)
                prefix = _ordered(own, known.tokens, known.n, shift)[: n - (percent * n + 99) // 100 + 1]
                at = prefix >> top
                places = np.flatnonzero(known.repeated[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                if len(places):
                    entries.append((prefix[places], node, n, places.astype(np.uint32)))
                    size += len(places)
            if size > 1 << 18 or len(docs_) >= 20_000:
                yield from out()
                entries, docs_, size = [], [], 0
        if docs_:
            yield from out()

    def lists(key: tuple, table: pa.Table) -> pa.Table:
        whole_list = key[1].as_py() == 0
        ids = table.column("ids").combine_chunks()
        whole = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("token", np.uint64), ("a", np.uint64), ("n", np.uint32), ("place", np.uint32))]
        is_doc = [not len(t) for t in whole[0]]
        token, a, n, place = (np.concatenate([x for x, d in zip(c, is_doc) if not d] or [np.zeros(0, k)]) for c, k in zip(whole, (np.uint64, np.uint64, np.uint32, np.uint32)))
        doc_a, doc_n = (np.concatenate([x for x, d in zip(c, is_doc) if d] or [np.zeros(0, k)]) for c, k in zip(whole[1:3], (np.uint64, np.uint32)))
        a, doc_a = a.reshape(-1, 2), doc_a.reshape(-1, 2)
        order = np.lexsort((a[:, 1], a[:, 0], n, place, token))
        token, a, n, place = token[order], a[order], n[order].astype(np.int64), place[order].astype(np.int64)
        # Equal sets from several tasks: the same token, place, size and set follow each other.
        fresh = np.r_[True, (token[1:] != token[:-1]) | (a[1:] != a[:-1]).any(1)][: len(token)]
        token, a, n, place = token[fresh], a[fresh], n[fresh], place[fresh]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
        many = np.diff(np.r_[first, len(token)])
        hub = np.repeat(first, many)
        is_hub = hub == np.arange(len(token))
        shared = (~is_hub & (np.repeat(many, many) > 2)) if whole_list else np.ones(len(token), bool)
        near = ~is_hub & _may_link(n, place, n[hub], place[hub], percent)
        pairs = np.unique(np.concatenate([a[near], a[hub[near]]], 1), axis=0)
        e, p, d = int(shared.sum()), len(pairs), len(doc_a)
        long, int_, data = pa.int64(), pa.int32(), pa.binary()
        join = lambda *parts: pa.chunked_array([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in parts])
        empty = pa.array(doc_n == 0)
        return pa.table(
            {
                "kind": pa.array(np.repeat([DOC, ENTRY, PAIR], [d, e, p]).astype(np.int32)),
                "id": join(ids.flatten(), pa.nulls(e + p, ids.type.value_type)),
                "a": join(pc.if_else(empty, pa.scalar(None, data), _nodes(doc_a)), _nodes(a[shared]), _nodes(pairs[:, :2])),
                "b": join(pa.nulls(d, data), _nodes(a[hub[shared]]), _nodes(pairs[:, 2:])),
                "token": join(pa.nulls(d, long), pa.array(token[shared].view(np.int64), long), pa.nulls(p, long)),
                "n": join(pa.array(doc_n.astype(np.int32), int_), pa.array(n[shared].astype(np.int32), int_), pa.nulls(p, int_)),
                "place": join(pa.nulls(d, int_), pa.array(place[shared].astype(np.int32), int_), pa.nulls(p, int_)),
            }
        )

    packed = docs.select(id_col, text_col).mapInArrow(emit, f"part int, salt int, token binary, a binary, n binary, place binary, ids array<{id_type}>")
    return packed.groupBy("part", "salt").applyInArrow(lists, f"kind int, id {id_type}, a binary, b binary, token long, n int, place int")


def _may_link(n1, place1, n2, place2, percent: int):
    """Whether two entries of a list may be of linked sets; numpy arrays or columns. Exact where the list's
    shingle is the first that the two share, which it is in one of the lists that hold both.
    """
    least = F.least if isinstance(n1, Column) else np.minimum
    left = least(n1 - place1, n2 - place2)
    return ((100 + percent) * left >= percent * (n1 + n2)) & (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1)


def _sets(docs: DataFrame, text_col: str, wanted: Bitmap) -> DataFrame:
    """``a, tokens``: the sets that the bitmap may hold, as packed hashes, once each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.held.value
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for text in batch.column(0).slice(at, 256).to_pylist():
                    own = shingle_set(words_of(text))
                    if len(own) and (node := _node(own)) not in seen and bits[(place := wanted.position_of(node)) >> 3] >> (place & 7) & 1:
                        seen.add(node)
                        rows.append((node, own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["a", "tokens"])

    return docs.select(text_col).mapInArrow(build, "a binary, tokens binary").dropDuplicates(["a"])


def _groups(pairs: DataFrame, group_pairs: int) -> DataFrame:
    """``a, b, part``: the pairs in parts of about ``group_pairs``, those of a set that many are compared with together.

    A pair goes with the one of its sets that has more pairs; sets of more than ``group_pairs`` have several parts.
    """
    parts = max(1, math.ceil(pairs.count() / group_pairs))
    several = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k")).where("k > 1")
    counted = pairs
    for own, k in (("a", "k1"), ("b", "k2")):
        counted = counted.join(several.select(F.col("id").alias(own), F.col("k").alias(k)), own, "left").fillna(1, [k])
    by_a = F.col("k1") > F.col("k2")
    hub, other = F.when(by_a, F.col("a")).otherwise(F.col("b")), F.when(by_a, F.col("b")).otherwise(F.col("a"))
    salt = F.pmod(F.xxhash64(other), F.ceil(F.greatest("k1", "k2") / group_pairs))
    return counted.select("a", "b", F.pmod(F.xxhash64(hub, salt), F.lit(parts)).alias("part"))


def _compared(pairs: DataFrame, docs: DataFrame, text_col: str, percent: int, scratch: Scratch, group_pairs: int = 256, moves: int = 2) -> DataFrame:
    """``a, b, shared, linked``, written: how many shingles the sets of each pair share, counted in the whole sets.

    A set is moved once by its id, and then once to each part that has pairs of it, never with a pair. Where that is
    more than ``moves`` times on average, the sets are written and the parts are done in several rounds, so that the
    disk in use is bounded by the sets, however many pairs there are.
    """
    grouped = scratch.write(_groups(pairs, group_pairs), "join-parts")
    needed_in = lambda parts: parts.select("part", F.explode(F.array("a", "b")).alias("a")).distinct()
    wanted = Bitmap(needed_in(grouped).select("a").distinct(), "a")
    sets = _sets(docs, text_col, wanted)
    rounds = max(1, math.ceil(needed_in(grouped).count() / max(1, moves * wanted.n)))
    if rounds > 1:
        sets = scratch.write(sets, "join-sets")

    def compare(table: pa.Table) -> pa.Table:
        is_set = pc.is_valid(table.column("tokens"))
        own = table.filter(is_set)
        held = {a: np.frombuffer(t, np.uint64) for a, t in zip(own.column("a").to_pylist(), own.column("tokens").to_pylist())}
        rest = table.filter(pc.invert(is_set)).select(["a", "b"])
        shared, linked = [], []
        for p, q in zip(rest.column("a").to_pylist(), rest.column("b").to_pylist()):
            both = np.concatenate([held[p], held[q]])
            both.sort(kind="stable")
            n = int((both[1:] == both[:-1]).sum())
            shared.append(n)
            linked.append(100 * n >= percent * (len(both) - n))
        return rest.append_column("shared", pa.array(shared, pa.int32())).append_column("linked", pa.array(linked, pa.bool_()))

    none = lambda c: F.lit(None).cast("binary").alias(c)
    done = []
    for i in range(rounds):
        own = grouped.where(F.col("part") % rounds == i)
        moved = needed_in(own).join(sets, "a").select("part", "a", none("b"), "tokens").unionByName(own.select("part", "a", "b", none("tokens")))
        done.append(scratch.write(moved.groupBy("part").applyInArrow(compare, "a binary, b binary, shared int, linked boolean"), "join-compared"))
        collect_executors(docs.sparkSession)
    scratch.drop(grouped, sets)
    return reduce(DataFrame.unionByName, done)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for the ends of ``edges`` (``a, b``): the smallest node that links reach.

    Large-star and small-star steps, a written table each round; they end when the edges no longer change,
    after about as many rounds as the logarithm of the longest chain.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "components")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, scratch.write(small, "components")
        scratch.drop(before)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen["n"], seen["x"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (seen["n"], seen["x"])


def _open_pairs(entries: DataFrame, percent: int, block_rows: int, scratch: Scratch) -> DataFrame:
    """``a, b``: the pairs of sets of different components that may link, by the lists that hold several.

    ``entries``: ``token, a, n, place, component``, and ``b, shared``, the first set that ``a`` was compared with.
    """
    each = entries.groupBy("token", "component").agg(F.count("*").alias("k"))
    mixed = each.groupBy("token").agg(F.max_by("component", "k").alias("largest"), F.sum("k").alias("entries"), F.count("*").alias("components")).where("components > 1")
    salt = F.pmod(F.xxhash64("a"), F.ceil(F.col("entries") / block_rows))
    block = F.struct(F.floor(F.log(F.col("n")) * 8).alias("size"), F.floor(16 * F.col("place") / F.col("n")).alias("place"), salt.alias("salt"))
    open_ = scratch.write(entries.join(mixed.select("token", "largest", "entries"), "token").withColumn("block", block), "join-open")
    low_high = [f(c).alias(f"{name}_{c}") for c in ("n", "component") for name, f in (("low", F.min), ("high", F.max))]
    blocks = open_.groupBy("token", "block").agg(*low_high, F.max(F.col("n") - F.col("place")).alias("left"))
    others = open_.where("component != largest")  # of two components, one at least isn't the largest
    other_blocks = others.groupBy("token", "block").agg(*low_high, F.max(F.col("n") - F.col("place")).alias("left"))
    one, two = (b.select("token", *(F.col(c).alias(f"{c}{i}") for c in b.columns if c != "token")) for i, b in ((1, blocks), (2, other_blocks)))
    col = lambda c: F.col(c).cast("long")
    sizes = (100 * col("high_n1") >= percent * col("low_n2")) & (100 * col("high_n2") >= percent * col("low_n1"))
    places = (100 + percent) * F.least(col("left1"), col("left2")) >= percent * (col("low_n1") + col("low_n2"))
    several = ~((F.col("low_component1") == F.col("high_component1")) & (F.col("low_component2") == F.col("high_component2")) & (F.col("low_component1") == F.col("low_component2")))
    kept = one.join(two, "token").where(sizes & places & several).select("token", "block1", "block2")
    names = ("a", "n", "place", "component", "b", "shared", "block")
    first, second = (x.select("token", *(F.col(c).alias(f"{c}{i}") for c in names)) for i, x in ((1, open_), (2, others)))
    both = kept.join(second, ["token", "block2"]).join(first, ["token", "block1"])
    may = _may_link(col("n1"), F.col("place1"), col("n2"), F.col("place2"), percent)
    # What the two share is shared with the set that both were compared with, or is what both have besides.
    most = F.least("shared1", "shared2") + F.least(F.col("n1") - F.col("shared1"), F.col("n2") - F.col("shared2"))
    ruled_out = F.coalesce((F.col("b1") == F.col("b2")) & ((100 + percent) * most.cast("long") < percent * (col("n1") + col("n2"))), F.lit(False))
    return both.where((F.col("component1") != F.col("component2")) & may & ~ruled_out).select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b")).distinct()


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75, frequent_above: int = 8, most_frequent: int = 1_000_000, list_rows: int = 20_000, block_rows: int = 512, salts: int = 8) -> DataFrame:
    """``id_col, n_shingles, component_id``, a row for each row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included. A text of fewer than five
    words has one shingle, all its words; a null text or one without words has none and links with nothing,
    not even its like. Repeated rows link with each other. A null id is never the smallest, unless there is no
    other. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.count()
    bits = min(24, max(5, math.ceil(math.log2(max(1, rows / 1024)))))
    scratch = Scratch(docs.sparkSession)
    small_batches = lambda: settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=2000)
    with small_batches():
        counts = _counts(docs, text_col, rows, bits, frequent_above, most_frequent, scratch)
        collect_executors(docs.sparkSession)
        index = scratch.write(_index(docs, id_col, text_col, percent, bits, counts, list_rows), "join-index")
    collect_executors(docs.sparkSession)
    pairs = scratch.write(index.where(F.col("kind") == PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-pairs")
    with small_batches():
        compared = _compared(pairs, docs, text_col, percent, scratch)
    edges = compared.where("linked").select("a", "b")
    known = components(edges, scratch)
    # Sets that link to nothing are their own component.
    entries = index.where(F.col("kind") == ENTRY).select("token", "a", "n", "place", "b").join(known.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    either_way = compared.select("a", "b", "shared").unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    open_ = _open_pairs(entries.join(either_way, ["a", "b"], "left"), percent, block_rows, scratch)
    more = scratch.write(open_.join(compared.select("a", "b"), ["a", "b"], "left_anti"), "join-more")
    if not more.isEmpty():
        with small_batches():
            further = _compared(more, docs, text_col, percent, scratch).where("linked").select("a", "b")
        known = components(edges.unionByName(further), scratch)
    sets = index.where(F.col("kind") == DOC).select("id", "a", "n")
    by_set = sets.where("a is not null").groupBy("a").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    grouped = by_set.join(known.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1").select("component", "component_id")
    answer = grouped.withColumn("salt", salt("a")).join(least.withColumn("salt", every_salt), ["component", "salt"]).select("a", "component_id").withColumn("salt", every_salt)
    out = sets.withColumn("salt", salt("id")).join(answer, ["a", "salt"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; columns as they were.

    Rows that repeat an id and its text count once, unless the text has no words: such rows link with nothing and
    all stay. So do rows without an id, and rows of one id whose texts differ, if that id is the smallest.
    """
    scratch = Scratch(docs.sparkSession)
    linked = scratch.write(link_documents(docs, id_col, text_col, **options).withColumnRenamed(id_col, "id"), "join-components")
    gone = scratch.write(linked.where("component_id != id").select("id").distinct(), "join-gone")
    again = linked.where("n_shingles > 0 and component_id = id").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    # Only rows that the bitmap may hold meet the exact joins; the others pass without a shuffle.
    touched = scratch.write(gone.unionByName(again), "join-touched")
    bitmap = Bitmap(touched, "id")
    scratch.drop(linked, touched)
    flag = own_name(docs, "_maybe")
    marked = docs.withColumn(flag, F.coalesce(bitmap.may_hold(F.col(id_col)), F.lit(False)))
    sure = marked.where(~F.col(flag)).drop(flag)
    rest = marked.where(F.col(flag)).drop(flag).join(gone.withColumnRenamed("id", id_col), id_col, "left_anti").select(*docs.columns)
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return sure.unionByName(rest.where(worded).dropDuplicates([id_col, text_col])).unionByName(rest.where(~worded))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return link_documents(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (max(nx.n) + max(ny.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
