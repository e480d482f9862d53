"""Checks of the model: what they write, and that it goes."""

from tallymart.operators import reconcile, star
from tallymart.plans import q_star
from tallymart.sources import files


def test_an_area_writes_what_it_reads_once_and_leaves_nothing(spark, sf, monkeypatch):
    staged, stage = [], q_star.stage
    note = lambda found: staged.append(stage(found)) or staged[-1]
    monkeypatch.setattr(q_star, "stage", note)
    monkeypatch.setattr(star, "stage", note)
    got = q_star.run_checks(q_star.MODEL_CHECKS["model_business_total"][0], spark, sf, q_star.READ["model_business_total"])
    assert got.count() == len(reconcile.TOTALS)
    names = [n for s in staged for n in s]
    assert len(names) == len(set(names)) and {"order_items", "payments", "fact_order_items", "fact_payments"} <= set(names)
    assert not {"reviews", "geolocation", "fact_reviews", "dim_date"} & set(names)
    assert not any(files.exists(spark, df.staged_at) for s in staged for df in s.values())


def test_sources_of_a_table():
    assert star.with_sources(("fact_payments",)) == {"fact_payments", "payments", "fact_orders", "orders", "dim_customer", "customers", "dim_order_status"}


def test_few_sellers_and_statuses_are_broadcast(spark, sf):
    """Whatever Spark estimates for them: facts are not shuffled by a key with few values."""
    from tallymart.plans.q_clean import cleaned

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = star.build_star(cleaned(spark, sf)[0])
        plan = q_star.with_business_keys(m, "fact_order_items")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin [product_id" in plan
    assert not any(f"SortMergeJoin [{c}" in plan for c in ("seller_id", "seller_key", "order_status"))
