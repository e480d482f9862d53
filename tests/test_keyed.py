"""Stored keyed tables, one row a key, dense keys."""

import pytest
from pyspark.sql import functions as F

from tallymart.operators import star
from tallymart.sources import files, tables
from tallymart.sources.keyed import KeyedTable, MergeConflict


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def snapshot(spark, path):
    return {name: (size, at) for name, size, at in files.stamps(spark, path)}


@pytest.fixture
def people(spark, tmp_path):
    t = KeyedTable.create(spark, f"file://{tmp_path}/people", ["id"], "k", buckets=8)
    t.merge(spark.createDataFrame([(k, f"n{k}") for k in range(40)], "id long, name string"))
    return t


def test_merge_keeps_keys_and_reduces_what_comes_in(spark, people):
    old = dict(rows(people.read(), "id", "k"))
    assert sorted(old.values()) == list(range(1, 41))
    came = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (50, "x", 1), (50, "y", 3), (50, "z", None), (None, "no", 9), (2, "n2", 1)], "id long, name string, seen int")
    done = people.merge(came, newest=["seen"])
    assert (done.inserted, done.updated, done.version) == (1, 1, 2)
    now = {r.id: (r.name, r.k) for r in people.read().collect()}
    assert len(now) == 41 and now[1] == ("b", old[1]) and now[50] == ("y", 41) and now[2] == ("n2", old[2])
    assert people.read().columns == ["k", "id", "name"]


def test_only_touched_buckets_change_and_a_rerun_changes_no_file(spark, people):
    before = snapshot(spark, people.path)
    one = spark.createDataFrame([("new", 3)], "name string, id long")
    done = people.merge(one)
    after = snapshot(spark, people.path)
    assert (done.buckets_read, done.buckets_written, done.updated) == (1, 1, 1)
    assert before.items() <= after.items()  # files of other buckets, and of the version before, are as they were
    again = people.merge(one)
    assert again.version == done.version and again.buckets_written == 0 and snapshot(spark, people.path) == after
    assert len(people.read(1).filter("name = 'new'").collect()) == 0 and people.read().count() == 40
    people.vacuum()
    assert rows(KeyedTable(spark, people.path).read(), "id", "name") == rows(people.read(), "id", "name")
    assert len(snapshot(spark, people.path)) < len(after)


def test_insert_only_and_empty_merges(spark, people):
    came = spark.createDataFrame([(3, "other"), (77, "a"), (77, "b")], "id long, name string")
    done = people.merge(came, insert_only=True)
    assert (done.inserted, done.updated) == (1, 0)
    assert rows(people.read().filter("id = 3"), "name") == [("n3",)]
    assert people.merge(came.filter("false")).version == done.version == people.merge(came.filter("id = 3"), insert_only=True).version


def test_of_two_merges_at_once_one_fails(spark, people):
    other = KeyedTable(spark, people.path)
    people.merge(spark.createDataFrame([(1, "first")], "id long, name string"))
    with pytest.raises(MergeConflict):
        other.merge(spark.createDataFrame([(1, "second")], "id long, name string"))
    assert rows(KeyedTable(spark, people.path).read().filter("id = 1"), "name") == [("first",)]
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark, people.path, ["id"])


def test_compound_keys_nulls_and_hot_keys(spark, tmp_path):
    t = KeyedTable.create(spark, f"file://{tmp_path}/c", ["a", "b"], buckets=4)
    hot = spark.range(3000).select(F.lit(1).alias("a"), F.lit("x").alias("b"), F.col("id").alias("v"))
    t.merge(hot.unionByName(spark.createDataFrame([(1, "y", None), (2, None, 5)], "a int, b string, v long")), newest=["v"])
    assert rows(t.read(), "a", "b", "v") == [(1, "x", 2999), (1, "y", None)]


def test_frames_take_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, k long")
    came = spark.createDataFrame([(1, "c"), (1, "d"), (3, "e"), (3, "f"), (3, "f")], "id long, name string")
    up = rows(tables.upsert(old, came, ["id"], "k"), "id", "k")
    assert up == [(1, 1), (2, 2), (3, 3)] == rows(tables.insert_absent(old, came, ["id"], "k"), "id", "k")
    same = [rows(tables.latest(came.repartition(n), ["id"]), "id", "name") for n in (1, 3, 7)]
    assert same[0] == same[1] == same[2] and len(same[0]) == 2


def test_dimensions_have_one_row_a_key(spark):
    c = spark.createDataFrame([("c1", "u", 1, "A", "X"), ("c1", "u", 2, "B", "X"), ("c1", "u", 2, "B", "X"), (None, "u", 1, "A", "X")], "customer_id string, customer_unique_id string, customer_zip_code_prefix int, customer_city string, customer_state string")
    assert rows(star.dim_customer(c), "customer_id", "customer_key") == [("c1", 1)]
    assert rows(tables.version_conflicts(c, ["customer_id"]), "customer_id", "rows", "versions") == [("c1", 3, 2)]
    assert star.dim_customer(c, star.dim_customer(c)).count() == 1
    p = spark.createDataFrame([("p", "cat")], "product_id string, product_category_name string")
    t = spark.createDataFrame([("cat", "one"), ("cat", "two")], "product_category_name string, product_category_name_english string")
    assert star.dim_product(p, t).count() == 1
    s = spark.createDataFrame([("s", 1, "A", "X"), ("s", 1, "B", "X")], "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string")
    assert star.dim_seller(s).count() == 1


@pytest.mark.parametrize("rows_", [None, 10, 1 << 20, 1 << 40])
def test_keys_do_not_depend_on_the_ranges(spark, rows_):
    df = spark.range(500).select(F.col("id").alias("a"))
    got = dict(rows(tables.number_rows(df, ["a"], "k", rows=rows_), "a", "k"))
    assert sorted(got.values()) == list(range(1, 501)) and got == dict(rows(tables.number_rows(df, ["a"], "k"), "a", "k"))
    assert 2 ** tables.range_bits(1 << 40) * tables.RANGE_ROWS >= 1 << 40


def test_reload_of_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(tables, "STRETCH", 7)
    df = spark.range(60).select((F.col("id") % 3 == 0).alias("a"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("b"))
    got = rows(tables.reload(df, "k"), "k", "a", "b")
    assert [g[0] for g in sorted(got)] == list(range(1, 61)) and got == rows(tables.reload(df.repartition(5), "k"), "k", "a", "b")
    assert sorted(g[1:] for g in got) == sorted((r.a, r.b) for r in df.collect())
