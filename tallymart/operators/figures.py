"""Key figures from stored sums by month, refreshed from changed orders only.

Two keyed tables: one row an order with what it adds to its month, and one row a month with the sums. A load merges the
changed orders; the months then follow by the difference between the order table's version that they have seen and the
present one, which lies in the buckets that the load has written. The version is remembered by the same merge that changes
the months, so a load that dies half-way is caught up with by the next one, and nothing is counted twice. All sums are
whole numbers or decimals, so figures equal those of a full recomputation.

Defined results: an order without payments adds no revenue; orders without a purchase time belong to no month and are
left out; an order that moves to another month leaves its old one; a month that loses all its orders stays with zeros; an
empty load changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymart.functions.columns import percent
from tallymart.operators.kpi import money
from tallymart.sources import files
from tallymart.sources.keyed import KeyedTable

SUMS = ("orders", "payments", "revenue", "delivered", "delivery_days", "on_time")


def order_rows(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """(order_id, month, and what the order adds to each sum); ``payments`` holds all payments of these orders."""
    paid = payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("payments"), F.sum(F.col("payment_value").cast("decimal(18,2)")).cast("decimal(28,2)").alias("revenue"))
    bought, came, due = (F.to_date(c) for c in ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    rows = orders.filter(F.col("order_purchase_timestamp").isNotNull()).select(
        "order_id", F.date_format(bought, "yyyy-MM").alias("month"), F.lit(1).cast("bigint").alias("orders"),
        flag(came.isNotNull()).alias("delivered"), F.coalesce(F.datediff(came, bought), F.lit(0)).cast("bigint").alias("delivery_days"), flag(came <= due).alias("on_time"),
    )
    none = F.lit(0)
    return rows.join(paid, "order_id", "left").select("order_id", "month", "orders", F.coalesce("payments", none).cast("bigint").alias("payments"), F.coalesce("revenue", none).cast("decimal(28,2)").alias("revenue"), "delivered", "delivery_days", "on_time")


class MonthlyFigures:
    """Stored sums in a folder, made there if there are none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        for name, key, n in (("orders", "order_id", buckets), ("months", "month", 1)):
            if not files.names(spark, f"{path}/{name}/_versions"):
                KeyedTable.create(spark, f"{path}/{name}", [key], buckets=n)
        self.orders, self.months = KeyedTable(spark, f"{path}/orders"), KeyedTable(spark, f"{path}/months")

    def refresh(self, orders: DataFrame, payments: DataFrame) -> None:
        """Takes new and changed orders over, with all their payments."""
        self.orders.merge(order_rows(orders, payments))
        self.catch_up()

    def catch_up(self) -> None:
        """Brings the months to the present version of the orders."""
        seen = self.months.note.get("orders", 0)
        if seen == self.orders.version:
            return
        was, now = self.orders.changed_since(seen)
        signed = now.select("month", *SUMS).unionByName(was.select("month", *((-F.col(c)).cast(was.schema[c].dataType).alias(c) for c in SUMS)))
        delta = signed.groupBy("month").agg(*(F.sum(c).alias(c) for c in SUMS))
        if self.months.version:
            delta = delta.unionByName(self.months.read().select("month", *SUMS).join(delta.select("month"), "month", "left_semi"))
        kind = lambda c: "decimal(28,2)" if c == "revenue" else "bigint"
        self.months.merge(delta.groupBy("month").agg(*(F.sum(c).cast(kind(c)).alias(c) for c in SUMS)), note={"orders": self.orders.version})

    def by_month(self) -> DataFrame:
        """(month, sums, average_order_value, growth_pct); the window runs over months alone."""
        before = F.lag("revenue").over(Window.orderBy("month")).cast("double")
        growth = F.round(F.try_divide((F.col("revenue").cast("double") - before) * 100, before), 2)
        return self.months.read().select("month", *(money(c).alias(c) if c == "revenue" else F.col(c) for c in SUMS), _ratio("revenue", "orders").alias("average_order_value"), growth.alias("growth_pct"))

    def totals(self) -> DataFrame:
        """One row: total_revenue, total_orders, average_order_value, average_delivery_days, on_time_pct."""
        one = self.months.read().agg(*(F.sum(c).alias(c) for c in SUMS))
        return one.select(money("revenue").alias("total_revenue"), F.col("orders").alias("total_orders"), _ratio("revenue", "orders").alias("average_order_value"), _ratio("delivery_days", "delivered").alias("average_delivery_days"), percent(F.col("on_time"), F.col("delivered"), 2).alias("on_time_pct"))


def _ratio(part: str, whole: str) -> Column:
    return F.round(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), 2)
