"""Reference checks by bitmaps of the parent's keys."""

import pytest
from pyspark.sql import functions as F

from tallymart.operators import key_index
from tallymart.operators.checks import unmatched_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("nulls", [False, True])
def test_same_orphans_as_the_join(spark, nulls):
    parent = spark.createDataFrame([(k,) for k in (*range(-40000, 40000, 7), 0, 1, -1, 32767, 32768, 32769, -32768, None)], "k long")
    child = spark.range(-41000, 41000, 3).select(F.col("id").cast("int").alias("k")).unionByName(spark.createDataFrame([(None,), (None,), (5,), (5,)], "k int"))
    got = key_index.orphan_counts(child, "k", parent, "k", nulls)
    assert rows(got) == rows(unmatched_counts(child, "k", parent, "k", nulls)) and got.count() > 1000
    none = parent.filter("false")
    assert rows(key_index.orphan_counts(child, "k", none, "k", nulls)) == rows(unmatched_counts(child, "k", none, "k", nulls))


def test_no_child_row_is_shuffled(spark):
    index = key_index.build(spark.range(1000), "id")
    plan = key_index.orphans(spark.range(2000).toDF("k"), "k", index)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical


def test_other_keys_and_sizes_have_no_index(spark):
    text = spark.createDataFrame([("a",), ("b",)], "k string")
    assert key_index.build(text, "k") is None
    assert rows(key_index.orphan_counts(spark.createDataFrame([("a",), ("c",)], "k string"), "k", text, "k")) == [("c", 1)]
    sparse = spark.range(200).select((F.col("id") * 10**9).alias("k"))
    assert key_index.build(sparse, "k", 100 * 4096) is None and key_index.build(sparse, "k") is not None
    assert rows(key_index.orphan_counts(sparse.select((F.col("k") + 1).alias("k")).limit(1), "k", sparse, "k", most_bytes=4096)) == [(1, 1)]
