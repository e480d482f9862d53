"""Edge rows with exact results."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallymart.functions import columns as C
from tallymart.operators import checks, clean, kpi, preprocess, profile, reconcile, star
from tallymart.plans.rulebook import rulebook
from tallymart.sources import tables
from tallymart.specs import EDGES, RETAIL, DatasetSpec, Edge


def values(df, column):
    return [r[column] for r in df.collect()]


def test_null_tokens_before_trimming(spark):
    df = spark.createDataFrame([("NA",), (" ",), ("   ",), ("not_defined",), (None,)], "x string").coalesce(1)
    spec = DatasetSpec("t", {"x": "string"})
    assert values(preprocess.preprocess_dataframe(df, spec), "x") == [None, None, "", "not_defined", None]
    assert values(preprocess.preprocess_dataframe(df, spec, strict_nulls=True), "x") == [None, None, None, "not_defined", None]


def test_white_space_is_unicode(spark):
    df = spark.createDataFrame([("  São  Paulo\t",), (" a b ",)], "x string").coalesce(1)
    assert values(preprocess.normalize_text(df), "x") == ["São Paulo", "a b"]
    assert values(preprocess.normalize_categories(df, ["x"]), "x") == ["são paulo", "a b"]


def test_integers_and_timestamps(spark):
    df = spark.createDataFrame([("3.0",), ("3.7",), ("abc",), (None,)], "x string").coalesce(1)
    assert values(preprocess.convert_integer(df, ["x"]), "x") == [3, None, None, None]
    assert df.filter(C.is_fraction(F.col("x"))).count() == 1
    df = spark.createDataFrame([("2017-10-02 10:56:33",), ("2017-13-01",)], "x string").coalesce(1)
    assert values(preprocess.parse_timestamps(df, ["x"]), "x") == [dt.datetime(2017, 10, 2, 10, 56, 33), None]
    with pytest.raises(ValueError):
        preprocess.preprocess_dataset(df, "no such")


def test_chained_and_independent(spark):
    df = spark.createDataFrame([(5, 4, 3)], "purchase int, carrier int, customer int")
    chain = [("carrier", "purchase"), ("customer", "carrier")]
    assert clean.nullify_chain(df, chain, "chained").first()[1:] == (None, 3)
    assert clean.nullify_chain(df, chain, "independent").first()[1:] == (None, None)


def test_three_measures_of_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "x string")
    r = preprocess.duplicate_summary(df).first()
    assert (r.total_rows, r.participating_rows, r.excess_rows, r.duplicate_groups) == (4, 3, 2, 1)
    assert clean.drop_duplicate_rows(clean.drop_duplicate_rows(df)).count() == 2


def test_null_child_keys(spark):
    t = {"c": spark.createDataFrame([(1,), (None,), (9,)], "k int"), "p": spark.createDataFrame([(1,)], "k int")}
    e = Edge("c", "k", "p", "k")
    assert clean.edge_report(t, (e,)).first().orphans == 1
    assert clean.edge_report(t, (e,), True).first().orphans == 2
    r = profile.relationship(t["c"], ["k"], t["p"], ["k"], "x").first()
    assert r.child_rows_checked == r.match_count + r.non_match_count == 2
    with pytest.raises(ValueError, match="orphans"):
        clean.require_edges(t, (e,))


def test_skewness_and_quartiles(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    assert math.isclose(profile.skew_profile(df, ["x"]).first().skewness, 1.763632614803888, rel_tol=1e-12)
    r = profile.five_numbers(df, ["x"]).first()
    assert (r.q1, r.median) == (1.75, 2.5)
    assert profile.skew_profile(df.limit(2), ["x"]).first()["shape"] == "Undefined"


def test_calendar(spark):
    rows = {r.date_key: r for r in star.dim_date(spark.createDataFrame([(dt.datetime(2026, 11, 28), dt.datetime(2027, 1, 1, 5))], "order_purchase_timestamp timestamp, order_estimated_delivery_date timestamp")).collect()}
    assert len(rows) == 35 and rows[20261128].day_of_week == 6 and rows[20261128].is_weekend
    assert rows[20270101].week_of_year == 53 and rows[20270101].month_year == "2027-01" and rows[20270101].quarter_name == "Q1"


def test_no_fan_out(spark):
    items = spark.createDataFrame([(1, 5.0, 1.0)] * 3, "order_id int, price double, freight_value double")
    payments = spark.createDataFrame([(1, 10.0)] * 2, "order_id int, payment_value double")
    r = star.order_totals(items, payments).first()
    assert (r.payment_value, r.items_value, r.n_items, r.n_payments) == (20.0, 15.0, 3, 2)


def test_upsert_keeps_keys_and_repeats(spark):
    old = tables.number_rows(spark.createDataFrame([(i, "a") for i in range(20)], "id int, v string"), ["id"], "k")
    new = spark.createDataFrame([(3, None), (25, "c"), (26, "d")], "id int, v string")
    once = {r.id: (r.k, r.v) for r in tables.upsert(old, new, ["id"], "k").collect()}
    twice = {r.id: (r.k, r.v) for r in tables.upsert(tables.upsert(old, new, ["id"], "k"), new, ["id"], "k").collect()}
    before = {r.id: r.k for r in old.collect()}
    assert once == twice and sorted(k for k, _ in once.values()) == list(range(1, 23))
    assert all(once[i][0] == k for i, k in before.items()) and once[3][1] is None and once[4][1] == "a"
    assert {r.id: r.v for r in tables.insert_absent(old, new, ["id"], "k").collect()}[3] == "a"


def test_keys_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 7)
    a = {r.id: r.k for r in tables.number_rows(df, ["id"], "k", bits=2).collect()}
    b = {r.id: r.k for r in tables.number_rows(df.repartition(5), ["id"], "k", bits=8).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 501))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, v double")
    got = {r.test_id: r for r in checks.run_rules(spark, {"t": none}, [checks.EmptyRule("E", "t", "*", "Completeness", "rows", "CRITICAL"), checks.RowRule("R", "t", "v", "Validity", "v", "HIGH", "v < 0"), checks.KeyRule("K", "t", "k", "Uniqueness", "k", "HIGH", ("k",))]).collect()}
    assert got["E"].status == "FAIL" and got["E"].severity == "CRITICAL"
    assert got["R"].failure_rate == 0 and got["R"].status == "PASS" and got["K"].severity == "NONE"
    assert preprocess.missing_summary(none).first().missing_rate == 0
    assert profile.numeric_profile(none, "t", ["v"]).first()["count"] == 0
    assert star.dim_date(spark.createDataFrame([], "order_purchase_timestamp timestamp, order_estimated_delivery_date timestamp")).count() == 0


def test_fused_rules_equal_rules_one_by_one(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("b"))
    rules = [checks.RowRule(f"R{k}", "t", "a", "Validity", "x", "LOW", f, w) for k, (f, w) in enumerate([("a = 0", "true"), ("b IS NULL", "a > 4"), ("b < 50", "b IS NOT NULL"), ("b > a", "true")])]
    together = {r.test_id: r for r in checks.run_rules(spark, {"t": df}, rules).collect()}
    for r in rules:
        alone = checks.run_rules(spark, {"t": df}, [r]).first()
        assert alone == together[r.test_id]
        assert alone.failed_count == df.filter(f"({r.among}) AND ({r.fails})").count()


def test_rulebook_and_catalogue_sizes():
    rules = rulebook(RETAIL)
    assert len(rules) == 64 and len({r.test_id for r in rules}) == 64
    assert len(EDGES) == 6


def test_csv_with_line_breaks_and_missing_source(spark, tmp_path):
    (tmp_path / "r.csv").write_text('review_id,order_id,review_comment_title,review_comment_message,review_score,review_creation_date,review_answer_timestamp\n1,2,"a ""b""","two\nlines",5,2018-01-01,bad\n')
    found, missing = tables.load_all(spark, {"reviews": str(tmp_path / "r.csv"), "gone": str(tmp_path / "gone.csv")}, RETAIL, "csv")
    assert missing == {"gone": "PATH_NOT_FOUND"}
    r = preprocess.preprocess_dataset(found["reviews"].select("review_id", "order_id", "review_comment_title", "review_comment_message", "review_score", "review_creation_date", "review_answer_timestamp"), "reviews").first()
    assert r.review_answer_timestamp is None


def test_save_and_catalogue(spark, tmp_path):
    df = spark.range(3)
    for fmt in ("parquet", "csv", "json"):
        tables.save(df, str(tmp_path / fmt), fmt)
        assert tables.load(spark, str(tmp_path / fmt), None, fmt).count() == 3
    tables.save_table(df, "kept_rows")
    tables.save_table(df.limit(2), "kept_rows")
    assert spark.table("kept_rows").count() == 2
    got = {r.dataset: r.table_exists for r in tables.existing_tables(spark, ["kept_rows", "lost_rows"]).collect()}
    assert got == {"kept_rows": True, "lost_rows": False}
    spark.sql("DROP TABLE kept_rows")


def test_classification_and_gates(spark):
    odd = spark.createDataFrame([("x", "MAYBE", "HIGH"), ("y", "PASS", "NONE")], "test_id string, status string, severity string")
    assert values(checks.check_classification(odd), "test_id") == ["x"]
    with pytest.raises(ValueError):
        reconcile.require_pass(odd.withColumn("status", F.lit("FAIL")))
    with pytest.raises(clean.RowCountChanged):
        clean.require_same_row_count(odd, odd.limit(1))
    with pytest.raises(ValueError, match="keys"):
        clean.require_keys({"sellers": spark.createDataFrame([(1,), (1,)], "seller_id int")}, {"sellers": RETAIL["sellers"]})


def test_gaps_and_growth(spark):
    t = [dt.datetime(2020, 1, 1, 1), dt.datetime(2020, 1, 1, 1), dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 3, 1), dt.datetime(2020, 1, 3, 2)]
    gaps = profile.largest_gaps(spark.createDataFrame([(x,) for x in t] + [(None,)], "t timestamp"), "t", 5).collect()
    assert [r.gap_seconds for r in gaps] == [26 * 3600, 22 * 3600, 3600]
    s = {"fact_orders": spark.createDataFrame([(1, 20200101), (2, 20200301)], "order_id int, purchase_date_key int"), "fact_payments": spark.createDataFrame([(1, 10), (2, 15)], "order_id int, payment_value int")}
    assert [(r.month, r.growth_pct) for r in kpi.monthly_growth(s).orderBy("month").collect()] == [("2020-01", None), ("2020-03", 50.0)]
