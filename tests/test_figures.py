"""Stored monthly sums against a full recomputation."""

import datetime as dt

from pyspark.sql import functions as F

from tallymart.operators.figures import SUMS, MonthlyFigures, order_rows

ORDER = "order_id long, order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"


def load(spark, ids, shift=0):
    at = lambda k: dt.datetime(2020, 1 + (k + shift) % 12, 1 + k % 28)
    rows = [(k, at(k) if k % 17 else None, at(k) + dt.timedelta(days=k % 9) if k % 3 else None, at(k) + dt.timedelta(days=4)) for k in ids]
    paid = [(k, float(k) + shift + p / 4) for k in ids for p in range(k % 4)]
    return spark.createDataFrame(rows, ORDER), spark.createDataFrame(paid, "order_id long, payment_value double")


def recomputed(*loads):
    o, p = {}, {}
    for orders, payments in loads:
        for r in order_rows(orders, payments).collect():
            o[r.order_id] = r
    out = {}
    for r in o.values():
        sums = out.setdefault(r.month, dict.fromkeys(SUMS, 0))
        for c in SUMS:
            sums[c] += r[c]
    return {m: {c: float(v) for c, v in s.items()} for m, s in out.items()}


def stored(f):
    return {r.month: {c: float(r[c]) for c in SUMS} for r in f.months.read().collect() if r.orders}


def test_small_loads_equal_recomputing(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    first, second = load(spark, range(300)), load(spark, [*range(0, 40, 5), *range(300, 320)], shift=3)
    f = MonthlyFigures(spark, path, buckets=16)
    f.refresh(*first)
    assert stored(f) == recomputed(first)
    f.refresh(*second)
    want = recomputed(first, second)
    assert stored(MonthlyFigures(spark, path)) == want
    version = f.months.version
    f.refresh(*second)
    f.refresh(*(d.filter("false") for d in second))
    assert f.months.version == version and stored(f) == want
    total = f.totals().first()
    assert total.total_orders == sum(s["orders"] for s in want.values()) and abs(total.total_revenue - sum(s["revenue"] for s in want.values())) < 0.01
    months = f.by_month().orderBy("month").collect()
    assert months[0].growth_pct is None and all(m.growth_pct == round((m.revenue - b.revenue) * 100 / b.revenue, 2) for b, m in zip(months, months[1:]))


def test_a_load_that_died_is_caught_up_with(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    first, second = load(spark, range(60)), load(spark, range(30, 80), shift=1)
    f = MonthlyFigures(spark, path, buckets=4)
    f.refresh(*first)
    f.orders.merge(order_rows(*second))  # and then nothing
    g = MonthlyFigures(spark, path)
    assert stored(g) == recomputed(first)
    g.catch_up()
    g.catch_up()
    assert stored(g) == recomputed(first, second)


def test_only_buckets_of_changed_orders_are_read(spark, tmp_path):
    f = MonthlyFigures(spark, f"file://{tmp_path}/f", buckets=16)
    f.refresh(*load(spark, range(200)))
    before = f.orders.version
    f.orders.merge(order_rows(*load(spark, [5], shift=2)))
    was, now = f.orders.changed_since(before)
    assert 0 < was.count() == now.count() < 60 and was.filter(F.col("order_id") == 5).count() == 1
