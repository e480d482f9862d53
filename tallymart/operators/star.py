"""The star schema: dimensions with stable surrogate keys, facts at declared grains, loads that can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.columns import date_key
from tallymart.sources.tables import insert_absent, latest, number_rows, reload, stage, upsert

Tables = dict[str, DataFrame]

#: Rows of a dimension that is broadcast to the facts at most. What Spark estimates for a numbered table is far too much, so
#: it would shuffle the facts by a key with few values.
FEW = 1 << 18


def broadcast_if_few(dimension: DataFrame, source: DataFrame) -> DataFrame:
    """A dimension of at most one row for each row of ``source``, marked to be broadcast if these are few."""
    return F.broadcast(dimension) if source.count() <= FEW else dimension


def load_dimension(incoming: DataFrame, keys: list[str], surrogate: str, existing: DataFrame | None = None, newest: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key. A first load numbers the rows; a later one keeps keys and takes new values over. Of rows
    that share a key the one with the largest ``newest`` columns counts, then the one of the largest row hash (see
    ``tables.latest``); ``tables.version_conflicts`` reports such keys. Rows without a key are left out."""
    rows = latest(incoming, keys, newest)
    return upsert(existing, rows, keys, surrogate) if existing is not None else number_rows(rows, keys, surrogate)


def dim_customer(customers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = customers.select("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state")
    return load_dimension(rows, ["customer_id"], "customer_key", existing)


def dim_person(customers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each person (customer_unique_id): what their latest customer row says."""
    rows = customers.select("customer_unique_id", "customer_id", "customer_zip_code_prefix", "customer_city", "customer_state")
    return load_dimension(rows, ["customer_unique_id"], "person_key", existing, ("customer_id",))


def dim_seller(sellers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")
    return load_dimension(rows, ["seller_id"], "seller_key", existing)


def dim_product(products: DataFrame, translation: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The English category is looked up; products without one stay. A category that is translated twice has one of its
    translations, so it doubles no product."""
    one = latest(translation, ["product_category_name"])
    return load_dimension(products.join(one, "product_category_name", "left"), ["product_id"], "product_key", existing)


def dim_geography(geolocation: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each ZIP prefix: the first by city, state, latitude, longitude, nulls last. A minimum of structs,
    which combines before the shuffle; null flags before the values put nulls last."""
    order = ["geolocation_city", "geolocation_state", "geolocation_lat", "geolocation_lng"]
    first = F.min(F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))).alias("b")
    rows = geolocation.filter(F.col("geolocation_zip_code_prefix").isNotNull()).groupBy(F.col("geolocation_zip_code_prefix").alias("zip_code_prefix")).agg(first)
    rows = rows.select("zip_code_prefix", F.col("b.geolocation_city").alias("city"), F.col("b.geolocation_state").alias("state"), F.col("b.geolocation_lat").alias("latitude"), F.col("b.geolocation_lng").alias("longitude"))
    return load_dimension(rows, ["zip_code_prefix"], "geography_key", existing)


def dim_order_status(orders: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = orders.filter(F.col("order_status").isNotNull()).select("order_status").distinct()
    return insert_absent(existing, rows, ["order_status"], "order_status_key") if existing is not None else number_rows(rows, ["order_status"], "order_status_key")


def dim_date(orders: DataFrame, first: str = "order_purchase_timestamp", last: str = "order_estimated_delivery_date", extend_to: tuple[str, ...] = ()) -> DataFrame:
    """The calendar from the first purchase to the last estimate (or to the last of ``extend_to`` as well). The ISO
    week stands beside the calendar year."""
    ends = F.greatest(*(F.max(F.to_date(c)) for c in (last, *extend_to))) if extend_to else F.max(F.to_date(last))
    span = orders.agg(F.min(F.to_date(first)).alias("lo"), ends.alias("hi")).filter("lo IS NOT NULL AND hi IS NOT NULL AND lo <= hi")
    d = F.col("full_date")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("full_date")).select(
        date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "yyyy-MM").alias("month_year"),
        F.weekofyear(d).alias("week_of_year"), F.dayofmonth(d).alias("day_of_month"), (F.weekday(d) + 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).alias("is_weekend"),
    )


def fact_orders(orders: DataFrame, customers: DataFrame, statuses: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Grain order_id; five date keys. Statuses are few, one row each."""
    rows = orders.join(customers.select("customer_id", "customer_key"), "customer_id").join(statuses.select("order_status", "order_status_key"), "order_status")
    rows = rows.select("order_id", "customer_key", "order_status_key", date_key(F.col("order_purchase_timestamp")).alias("purchase_date_key"), date_key(F.col("order_approved_at")).alias("approved_date_key"), date_key(F.col("order_delivered_carrier_date")).alias("delivered_carrier_date_key"), date_key(F.col("order_delivered_customer_date")).alias("delivered_customer_date_key"), date_key(F.col("order_estimated_delivery_date")).alias("estimated_delivery_date_key"))
    return load_dimension(rows, ["order_id"], "order_key", existing)


def fact_order_items(items: DataFrame, orders: DataFrame, products: DataFrame, sellers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Grain (order_id, order_item_id); the order's purchase date."""
    rows = items.join(products.select("product_id", "product_key"), "product_id").join(sellers.select("seller_id", "seller_key"), "seller_id").join(orders.select("order_id", F.col("purchase_date_key").alias("order_date_key")), "order_id")
    rows = rows.select("order_id", "order_item_id", "product_key", "seller_key", "order_date_key", F.col("price").cast("decimal(12,2)").alias("price"), F.col("freight_value").cast("decimal(12,2)").alias("freight_value"))
    return load_dimension(rows, ["order_id", "order_item_id"], "order_item_key", existing)


def fact_payments(payments: DataFrame, orders: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Grain (order_id, payment_sequential); payments have no date of their own."""
    rows = payments.join(orders.select("order_id", "customer_key"), "order_id")
    rows = rows.select("order_id", "payment_sequential", "customer_key", F.lit(None).cast("int").alias("payment_date_key"), "payment_type", "payment_installments", F.col("payment_value").cast("decimal(12,2)").alias("payment_value"))
    return load_dimension(rows, ["order_id", "payment_sequential"], "payment_key", existing)


def fact_reviews(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """One row for each source row; keys follow the content, so loading again changes nothing."""
    rows = reviews.join(orders.select("order_id", "customer_key"), "order_id")
    rows = rows.select("review_id", "order_id", "customer_key", date_key(F.col("review_creation_date")).alias("review_date_key"), "review_score", "review_comment_title", "review_comment_message", "review_answer_timestamp")
    return reload(rows, "review_key")


#: What each table of the model is made from: cleaned tables and tables of the model.
MADE_FROM = {
    "dim_date": ("orders",), "dim_customer": ("customers",), "dim_seller": ("sellers",), "dim_product": ("products", "category_translation"), "dim_geography": ("geolocation",), "dim_order_status": ("orders",),
    "fact_orders": ("orders", "dim_customer", "dim_order_status"), "fact_order_items": ("order_items", "fact_orders", "dim_product", "dim_seller"), "fact_payments": ("payments", "fact_orders"), "fact_reviews": ("reviews", "fact_orders"),
}


def with_sources(names: tuple[str, ...]) -> set[str]:
    """These tables and all that they are made from."""
    return set(names).union(*(with_sources(MADE_FROM[n]) for n in names if n in MADE_FROM))


def build_star(t: Tables, staged: bool = False, needed: tuple[str, ...] = tuple(MADE_FROM)) -> Tables:
    """The tables of the model (or those ``needed``, and what these are made from) from cleaned ones, in the order of
    their dependencies. ``staged``: each table is written before those that read it, so that nothing is worked out
    twice."""
    wanted, s = with_sources(needed), {}
    levels = (
        {"dim_date": lambda: dim_date(t["orders"]), "dim_customer": lambda: dim_customer(t["customers"]), "dim_seller": lambda: broadcast_if_few(dim_seller(t["sellers"]), t["sellers"]), "dim_product": lambda: dim_product(t["products"], t["category_translation"]), "dim_geography": lambda: dim_geography(t["geolocation"]), "dim_order_status": lambda: F.broadcast(dim_order_status(t["orders"]))},
        {"fact_orders": lambda: fact_orders(t["orders"], s["dim_customer"], s["dim_order_status"])},
        {"fact_order_items": lambda: fact_order_items(t["order_items"], s["fact_orders"], s["dim_product"], s["dim_seller"]), "fact_payments": lambda: fact_payments(t["payments"], s["fact_orders"]), "fact_reviews": lambda: fact_reviews(t["reviews"], s["fact_orders"])},
    )
    for level in levels:
        made = {n: make() for n, make in level.items() if n in wanted}
        s |= stage(made) if staged and made else made
    return s


def order_totals(items: DataFrame, payments: DataFrame) -> DataFrame:
    """Items and payments at the grain of orders: each is summed before they meet, so neither multiplies the other."""
    i = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("price").alias("items_value"), F.sum("freight_value").alias("freight_value"))
    p = payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_payments"), F.sum("payment_value").alias("payment_value"))
    return i.join(p, "order_id", "full_outer")


def fanout_guard(joined: DataFrame, fact: DataFrame) -> DataFrame:
    """(fact_rows, joined_rows, status): a join to dimensions must not change the rows of a fact."""
    counts = fact.agg(F.count(F.lit(1)).alias("fact_rows")).crossJoin(F.broadcast(joined.agg(F.count(F.lit(1)).alias("joined_rows"))))
    return counts.withColumn("status", F.when(F.col("fact_rows") == F.col("joined_rows"), "PASS").otherwise("FAIL"))
