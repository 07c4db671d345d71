import pytest
from pyspark.sql import functions as F

from shelfmark.operators import keys
from shelfmark.operators.checks import CheckFailed
from shelfmark.operators.store import TableStore, merged, missing_rows


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(spark, data):
    return spark.createDataFrame(data, "k int, v string")


def test_overwrite_append_and_versions(spark, store):
    store.create("a/t", "k int, v string")
    assert store.read("a/t").count() == 0 and store.version("a/t") == 0
    store.overwrite("a/t", make(spark, [(1, "x")]))
    pinned = store.read("a/t")
    store.append("a/t", make(spark, [(2, "y")]))
    assert rows(store.read("a/t")) == [(1, "x"), (2, "y")]
    assert rows(pinned) == [(1, "x")]
    store.overwrite("a/t", store.read("a/t").where("k = 2"))
    assert rows(store.read("a/t")) == [(2, "y")] and store.version("a/t") == 3
    store.create("a/t", "k int, v string")
    assert store.read("a/t").count() == 1
    assert store.tables() == ["a/t"] and store.tables("a") == ["a/t"] and store.tables("b") == []


def test_a_failed_write_leaves_the_old_state(spark, store):
    store.overwrite("t", make(spark, [(1, "x")]))
    bad = make(spark, [(1, "x")]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.overwrite("t", bad)
    assert rows(store.read("t")) == [(1, "x")] and store.version("t") == 1


def test_merge(spark, store):
    store.overwrite("t", make(spark, [(1, "a"), (2, "b")]))
    store.merge("t", make(spark, [(2, "B"), (3, "C")]), ["k"])
    assert rows(store.read("t")) == [(1, "a"), (2, "B"), (3, "C")]
    version = store.version("t")
    store.merge("t", make(spark, []), ["k"])
    assert store.version("t") == version
    for data, why in (([(4, "x"), (4, "y")], "several rows"), ([(None, "x")], "null key")):
        with pytest.raises(CheckFailed, match=why):
            store.merge("t", make(spark, data), ["k"])
    with pytest.raises(CheckFailed, match="missing"):
        store.merge("t", make(spark, [(1, "x")]).drop("v"), ["k"])


def test_merge_with_condition_update_list_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a", 1), (None, "b", 1)], "k int, v string, n int")
    source = spark.createDataFrame([(1, "A", 9), (None, None, 9), (5, "E", 9)], "k int, v string, n int")
    assert rows(merged(target, source, ["k"], update=["v"], when="s.v is not null")) == [(1, "A", 1), (5, "E", 9), (None, "b", 1)]


def test_anti_joins_treat_nulls_as_equal(spark, store):
    a, b = make(spark, [(1, None), (1, "x"), (2, None)]), make(spark, [(1, None)])
    assert rows(missing_rows(a, b, ["k", "v"])) == [(1, "x"), (2, None)]
    store.append_new("t", b, ["k", "v"])
    store.append_new("t", a, ["k", "v"])
    assert rows(store.read("t")) == [(1, "x"), (1, None), (2, None)]


def test_missing_tables_are_named(store):
    with pytest.raises(LookupError, match="x, y"):
        store.require(["x", "y"])


def test_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n")).repartition(5)
    for made in (keys.with_small_keys(df, "k", ["n"], 10), keys.with_keys(df, "k", ["n"], 10, partitions=6)):
        assert [r.k for r in made.orderBy("n").collect()] == list(range(11, 1011))
    assert keys.with_keys(df.where("n < 0"), "k", ["n"]).count() == 0
    assert keys.next_key(None, "k") == 0
    assert keys.next_key(spark.createDataFrame([(-1,)], "k long"), "k") == 0
    assert keys.next_key(spark.createDataFrame([(-1,), (7,)], "k long"), "k") == 7


def test_staged_tables_are_seen_once_published(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.overwrite("t", spark.range(3))
    staged = store.stage("t", spark.range(5))
    assert store.read("t").count() == 3 and staged.frame.count() == 5
    store.publish(staged)
    assert store.read("t").count() == 5


def test_vacuum_removes_what_no_pointer_names(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.overwrite("a/t", spark.range(3))
    store.overwrite("a/t", spark.range(4))
    store.append("a/t", spark.range(2))
    store.stage("a/t", spark.range(9))
    assert len(store.vacuum()) == 2 and store.vacuum() == []
    assert store.read("a/t").count() == 6
