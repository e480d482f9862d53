"""Audits observed by the write, digests, sketches, gaps, probes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymart.operators import checks, clean, digests, observed, profile, reconcile, sketches
from tallymart.sources import tables
from tallymart.specs import DatasetSpec


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_one_write_counts_and_cleans(spark, tmp_path):
    raw = {
        "payments": spark.createDataFrame([("a", 0, 0.0), ("b", 2, 0.0), ("c", 0, 5.0)], "order_id string, payment_installments long, payment_value double"),
        "reviews": spark.createDataFrame([("r", None), ("r", None), ("s", "x")], "review_comment_title string, review_comment_message string"),
    }
    written, done = observed.write_clean(raw, f"{tmp_path}/c")
    log = {(r.dataset, r.column, r.action): (r.rows_affected, r.rows_before, r.rows_after) for r in observed.audit_log(spark, done).collect()}
    assert log == {
        ("payments", "payment_installments", clean.SET_NULL_VALUE): (2, 3, 3),
        ("payments", "payment_value", clean.RETAIN): (2, 3, 3),
        ("reviews", "__FULL_ROW__", clean.DEDUPLICATE): (1, 3, 2),
        ("reviews", "review_comment_title", clean.RETAIN_NULL): (0, 2, 2),
        ("reviews", "review_comment_message", clean.RETAIN_NULL): (1, 2, 2),
    }
    assert rows(written["payments"], "order_id", "payment_installments") == [("a", None), ("b", 2), ("c", None)]
    assert rows(observed.row_invariants(spark, done), "dataset", "rows_before", "rows_after", "unchanged") == [("payments", 3, 3, True), ("reviews", 3, 2, False)]
    assert all("CollectMetrics" in plan(o.df) for o in done)


def test_a_write_reads_its_source_once(spark, sf):
    from tallymart.plans.roles import roles

    o = observed.Observed("order_items", roles(spark, sf, "order_items")["order_items"], observed.retail_steps()["order_items"])
    physical = plan(o.df).split("== Physical Plan ==")[1]
    assert physical.count("CollectMetrics") == 3 and physical.count("FileScan") == 1


def test_empty_tables_and_lost_rows(spark, tmp_path):
    none = spark.createDataFrame([], "order_id string, payment_installments long, payment_value double")
    _, done = observed.write_clean({"payments": none}, f"{tmp_path}/e")
    assert [r.rows_affected for r in observed.audit_log(spark, done).collect()] == [0, 0]
    lossy = {"t": [observed.Change(lambda df: df.filter("x > 1"))]}
    _, done = observed.write_clean({"t": spark.range(4).select(F.col("id").alias("x"))}, f"{tmp_path}/l", lossy)
    with pytest.raises(clean.RowCountChanged):
        observed.audit_log(spark, done)
    with pytest.raises(ValueError, match="before a shuffle"):
        observed.Observed("t", spark.range(1), [clean.retain_zero("t", "id"), observed.Deduplicate()])


def test_digests_tell_rows_apart(spark):
    df = spark.createDataFrame([(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), (None, "a", float("nan")), (None, "a", float("nan")), ("b", "b", None)], "x string, y string, z double")
    r = digests.repeat_figures(df).first()
    assert (r.total_rows, r.distinct_rows, r.participating_rows, r.excess_rows, r.duplicate_groups) == (6, 4, 4, 2, 2)
    assert sorted(n for *_, n in rows(digests.repeated_rows(df))) == [2, 2]
    e = digests.repeat_figures(df.filter("false")).first()
    assert (e.total_rows, e.excess_rows) == (0, 0)
    wide = spark.range(50).select(*(F.when(F.col("id") % 50 == k, F.lit(None)).otherwise(F.lit(1)).alias(f"c{k}") for k in range(70)))
    assert digests.repeat_figures(wide).first().distinct_rows == 50


def test_only_digests_are_shuffled(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    exchanges = [line for line in plan(digests.repeat_figures(df)).split("== Physical Plan ==")[1].splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("text" not in line for line in exchanges)


def test_sets_by_digests(spark):
    a, b = spark.range(5000).select("id", (F.col("id") % 7).cast("int").alias("v")), spark.range(5000).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    assert digests.same_set(a, b, ["id", "v"]).first().same and "Join" not in plan(digests.set_digest(a, ["id"]))
    changed = b.withColumn("v", F.when(F.col("id") == 4321, F.lit(99)).otherwise(F.col("v")))
    assert not digests.same_set(a, changed, ["id", "v"]).first().same
    assert rows(digests.set_difference(a, changed, ["id", "v"])) == [(4321, 2, "a"), (4321, 99, "b")]
    assert rows(digests.set_difference(a, b, ["id", "v"])) == []
    many = b.filter("id % 3 <> 0")
    assert len(rows(digests.set_difference(a, many, ["id", "v"]))) == 1667  # more ranges than are looked into one by one
    twice = a.unionByName(a.filter("id = 5"))
    assert digests.same_set(a, twice, ["id"]).first().same and not digests.same_set(a, twice, ["id"], distinct=False).first().same
    assert rows(digests.set_difference(twice, a, ["id", "v"], distinct=False)) == [(5, 5, "a")]
    assert rows(digests.set_difference(a.filter("false"), a.filter("id = 1"), ["id"])) == [(1, "b")]


def test_distinct_counts_without_expand(spark):
    df = spark.range(4000).select((F.col("id") - 2000).alias("dense"), (F.col("id") * 10**12).alias("sparse"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("v"), F.col("id") % 10)).alias("text"), F.lit(None).cast("int").alias("none"), (F.col("id") % 3).cast("double").alias("real"))
    got = {r["column"]: r.distinct_values for r in sketches.distinct_counts(df).collect()}
    assert got == {"dense": 4000, "sparse": 4000, "text": 5, "none": 0, "real": 3}
    summary = profile.column_summary(df)
    assert {r["column"]: r.distinct_values for r in summary.collect()} == got and "Expand" not in plan(summary)
    near = {r["column"]: r.distinct_values for r in profile.column_summary(df, approximate=True).collect()}
    assert all(abs(near[c] - n) <= 0.08 * n + 1 for c, n in got.items())
    assert {r["column"]: r.distinct_values for r in sketches.distinct_counts(df.limit(0)).collect()} == dict.fromkeys(df.columns, 0)


def test_stored_sketches_merge(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") % 3).alias("day"), F.col("id").alias("user"))
    sketches.distinct_sketches(df, ["user"], by=["day"]).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    one = sketches.estimates(sketches.merge_sketches(stored)).first()
    whole = sketches.estimates(sketches.distinct_sketches(df, ["user"])).first()
    assert one.rows == 3000 and abs(one.distinct_values - 3000) < 250 and abs(one.distinct_values - whole.distinct_values) < 100


@pytest.mark.parametrize("intervals", [4, 4096])
def test_largest_gaps_in_one_day_and_many(spark, monkeypatch, intervals):
    monkeypatch.setattr(profile, "INTERVALS", intervals)
    base = dt.datetime(2020, 1, 1)
    for seconds in ([0, 1, 2, 4, 8, 9, 20, 21, 50, 51, 52], [k * 7 for k in range(300)] + [5000, 90000, 90001, 10**7], [3, 3], []):
        df = spark.createDataFrame([(base + dt.timedelta(seconds=s),) for s in seconds] + [(None,)], "t timestamp_ntz")
        order = sorted(set(seconds))
        want = sorted(((b - a, a) for a, b in zip(order, order[1:])), key=lambda x: (-x[0], x[1]))[:5]
        got = [(r.gap_seconds, (r.gap_start - base).total_seconds()) for r in profile.largest_gaps(df, "t").collect()]
        assert sorted(got) == sorted((float(g), float(a)) for g, a in want)


def test_existence_is_looked_up(spark, sf, tmp_path):
    (tmp_path / "broken.parquet").write_text("no table")
    paths = {"there": f"{sf}/nation.parquet", "gone": f"{tmp_path}/gone", "broken": f"{tmp_path}/broken.parquet"}
    seen = {r.dataset: (r.is_present, r.columns > 0) for r in tables.probe(spark, {k: v for k, v in paths.items() if k != "broken"}).collect()}
    assert seen == {"there": (True, True), "gone": (False, False)}
    assert rows(reconcile.tables_exist(spark, {"there": paths["there"], "gone": paths["gone"]}), "dataset", "status") == [("gone", "FAIL"), ("there", "PASS")]
    got = checks.run_rules(spark, {}, checks.existence(spark, {"gone": paths["gone"]})).first()
    assert (got.status, got.severity, got.actual) == ("FAIL", "CRITICAL", "missing")


def test_key_policy_looks_at_the_table(spark):
    t = {"reviews": spark.createDataFrame([("r",), ("r",), ("s",), (None,), (None,)], "review_id string")}
    spec = DatasetSpec("reviews", {"review_id": "string"})
    assert reconcile.not_a_key(t, {"reviews": spec}, "reviews", "review_id").first().status == "PASS"
    bad = reconcile.not_a_key(t, {"reviews": DatasetSpec("reviews", {"review_id": "string"}, ("review_id",))}, "reviews", "review_id").first()
    assert (bad.status, bad.actual) == ("FAIL", "1")


def test_staged_tables_go(spark):
    staged = tables.stage({"x": spark.range(3).toDF("x")})
    at = staged["x"].staged_at
    kept = tables.settle(staged["x"])
    tables.discard(spark, staged)
    from tallymart.sources import files

    assert not files.exists(spark, at) and kept.count() == 3


def test_existence_has_the_rows_of_each_written_table(spark, sf):
    from tallymart.plans.q_clean import cleaned
    from tallymart.plans.registry import QUERIES

    rows = {r.dataset: (r.status, r.total_rows) for r in QUERIES["post_existence"](spark, sf).collect()}
    assert rows.pop("returns") == ("FAIL", None)
    assert rows == {n: ("PASS", df.count()) for n, df in cleaned(spark, sf)[0].items()}


def test_all_checks_after_cleaning_write_each_table_once_and_leave_nothing(spark, sf, monkeypatch):
    from tallymart.plans import q_clean
    from tallymart.sources import files, tables

    staged, stage = [], tables.stage
    monkeypatch.setattr(tables, "stage", lambda found: staged.append(stage(found)) or staged[-1])
    q_clean.post_all(spark, sf).collect()
    assert [set(s) for s in staged] == [set(q_clean.SPECS)] * 2
    assert not any(files.exists(spark, next(iter(s.values())).staged_at) for s in staged)
