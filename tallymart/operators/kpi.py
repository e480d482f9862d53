"""Key figures and business questions over the star schema. Money is summed as decimals; ratios divide sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions.columns import percent

Star = dict[str, DataFrame]


def money(c: Column | str, digits: int = 2) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def key_date(c: str) -> Column:
    """A date from its key."""
    k = F.col(c)
    return F.make_date((k / 10000).cast("int"), (k / 100).cast("int") % 100, k % 100)


def key_month(c: str) -> Column:
    """yyyy-MM from a date key."""
    k = F.col(c)
    return F.concat((k / 10000).cast("int").cast("string"), F.lit("-"), F.lpad(((k / 100).cast("int") % 100).cast("string"), 2, "0"))


def share(df: DataFrame, amount: str, name: str, digits: int = 2) -> DataFrame:
    """Adds the share of a column's total: a one-row sum beside the rows."""
    total = df.agg(F.sum(amount).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, percent(F.col(amount).cast("double"), F.col("__total").cast("double"), digits)).drop("__total")


def total_revenue(s: Star) -> DataFrame:
    return s["fact_payments"].agg(money(F.sum("payment_value")).alias("total_revenue"))


def total_orders(s: Star, approximate: bool = False) -> DataFrame:
    return s["fact_orders"].agg((F.approx_count_distinct("order_id") if approximate else F.count_distinct("order_id")).alias("total_orders"))


def average_order_value(s: Star) -> DataFrame:
    both = s["fact_payments"].agg(F.sum("payment_value").alias("v")).crossJoin(F.broadcast(total_orders(s)))
    return both.select(F.round(F.try_divide(F.col("v").cast("double"), F.col("total_orders").cast("double")), 2).alias("average_order_value"))


def _monthly(s: Star) -> DataFrame:
    """(month, revenue) by the month of purchase."""
    paid = s["fact_payments"].join(s["fact_orders"].select("order_id", "purchase_date_key"), "order_id")
    return paid.groupBy(key_month("purchase_date_key").alias("month")).agg(F.sum("payment_value").alias("revenue"))


def monthly_growth(s: Star) -> DataFrame:
    """Months are few; the window runs over them alone."""
    before = F.lag("revenue").over(Window.orderBy("month")).cast("double")
    return _monthly(s).select("month", money("revenue").alias("revenue"), F.round(F.try_divide((F.col("revenue").cast("double") - before) * 100, before), 2).alias("growth_pct"))


def _by_category(s: Star) -> DataFrame:
    name = F.coalesce("product_category_name_english", "product_category_name", F.lit("unknown"))
    sold = s["fact_order_items"].join(s["dim_product"].select("product_key", name.alias("category")), "product_key")
    return sold.groupBy("category").agg(F.sum("price").alias("revenue"), F.count_distinct("order_id").alias("orders"))


def top_categories(s: Star, by: str = "revenue", k: int = 5) -> DataFrame:
    ranked = _by_category(s).withColumn("rank", F.rank().over(Window.orderBy(F.desc(by), "category")))
    return ranked.filter(F.col("rank") <= k).select("rank", "category", money("revenue").alias("revenue"), "orders")


def top_sellers(s: Star, by: str = "revenue", k: int = 10) -> DataFrame:
    """By ``revenue`` or ``completed_orders``, of equal ones the smallest ids; completed orders are delivered ones."""
    delivered = s["fact_orders"].join(s["dim_order_status"], "order_status_key").filter(F.col("order_status") == "delivered").select("order_id", F.lit(1).alias("done"))
    sold = s["fact_order_items"].join(delivered, "order_id", "left")
    each = sold.groupBy("seller_key").agg(F.sum("price").alias("revenue"), F.count_distinct(F.when(F.col("done") == 1, F.col("order_id"))).alias("completed_orders"))
    named = each.join(s["dim_seller"].select("seller_key", "seller_id", "seller_state"), "seller_key")
    return named.orderBy(F.desc(by), F.desc("revenue"), "seller_id").limit(k).select("seller_id", "seller_state", money("revenue").alias("revenue"), "completed_orders")


def revenue_by_state(s: Star) -> DataFrame:
    paid = s["fact_payments"].join(s["dim_customer"].select("customer_key", "customer_state"), "customer_key")
    return paid.groupBy("customer_state").agg(money(F.sum("payment_value")).alias("revenue"), F.count_distinct("order_id").alias("orders"))


def _delivered(s: Star) -> DataFrame:
    f = s["fact_orders"].filter(F.col("delivered_customer_date_key").isNotNull())
    return f.withColumns({"delivered": key_date("delivered_customer_date_key"), "purchased": key_date("purchase_date_key"), "estimated": key_date("estimated_delivery_date_key")})


def delivery_days(s: Star) -> DataFrame:
    return _delivered(s).agg(F.round(F.avg(F.datediff("delivered", "purchased")), 2).alias("average_delivery_days"))


def on_time_rate(s: Star) -> DataFrame:
    d = _delivered(s)
    return d.agg(percent(F.count_if(F.col("delivered") <= F.col("estimated")), F.count(F.lit(1)), 2).alias("on_time_pct"))


def average_review(s: Star) -> DataFrame:
    return s["fact_reviews"].agg(F.round(F.avg("review_score"), 2).alias("average_review_score"), F.count("review_score").alias("reviews"))


def status_distribution(s: Star) -> DataFrame:
    n = s["fact_orders"].groupBy("order_status_key").agg(F.count(F.lit(1)).alias("orders")).join(s["dim_order_status"], "order_status_key")
    return share(n.select("order_status", "orders"), "orders", "pct")


def payment_methods(s: Star) -> DataFrame:
    """Both readings: the share of payments and the share of orders that use a method."""
    n = s["fact_payments"].groupBy("payment_type").agg(F.count(F.lit(1)).alias("payments"), F.count_distinct("order_id").alias("orders"))
    orders = s["fact_payments"].agg(F.count_distinct("order_id").alias("__orders"))
    return share(n, "payments", "pct_of_payments").crossJoin(F.broadcast(orders)).withColumn("pct_of_orders", percent(F.col("orders"), F.col("__orders"), 2)).drop("__orders")


# ---------------------------------------------------------------- business questions


def sales_trend(s: Star) -> DataFrame:
    """(month, quarter, year, revenue, revenue a year before, change in per cent)."""
    m = _monthly(s).withColumns({"year": F.substring("month", 1, 4).cast("int"), "quarter": F.ceil(F.substring("month", 6, 2).cast("int") / 3).cast("int")})
    earlier = m.select(F.concat((F.col("year") + 1).cast("string"), F.substring("month", 5, 3)).alias("month"), F.col("revenue").alias("earlier"))
    return m.join(earlier, "month", "left").select("month", "quarter", "year", money("revenue").alias("revenue"), money("earlier").alias("revenue_last_year"), F.round(F.try_divide((F.col("revenue") - F.col("earlier")).cast("double") * 100, F.col("earlier").cast("double")), 2).alias("yoy_pct"))


def sales_by_period(s: Star, period: str = "year") -> DataFrame:
    """(period, revenue, revenue a year before, change in per cent) by ``quarter`` (as 1995-Q2) or ``year``."""
    year = F.substring("month", 1, 4)
    name = year if period == "year" else F.concat(year, F.lit("-Q"), F.ceil(F.substring("month", 6, 2).cast("int") / 3).cast("string"))
    p = _monthly(s).groupBy(name.alias("period")).agg(F.sum("revenue").alias("revenue"))
    earlier = p.select(F.concat((F.substring("period", 1, 4).cast("int") + 1).cast("string"), F.substring("period", 5, 3)).alias("period"), F.col("revenue").alias("earlier"))
    return p.join(earlier, "period", "left").select("period", money("revenue").alias("revenue"), money("earlier").alias("revenue_last_year"), F.round(F.try_divide((F.col("revenue") - F.col("earlier")).cast("double") * 100, F.col("earlier").cast("double")), 2).alias("yoy_pct"))


def customers_by_place(s: Star) -> DataFrame:
    c = s["dim_customer"].join(s["fact_orders"].select("customer_key", "order_id"), "customer_key", "left")
    return c.groupBy("customer_state", "customer_city").agg(F.count_distinct("customer_unique_id").alias("customers"), F.count("order_id").alias("orders"))


def seasonality(s: Star) -> DataFrame:
    d = s["dim_date"].select("date_key", "month", "month_name", "day_of_week", "day_name")
    return s["fact_orders"].join(d, F.col("purchase_date_key") == F.col("date_key")).groupBy("month", "month_name", "day_of_week", "day_name").agg(F.count(F.lit(1)).alias("orders"))


def top_products(s: Star, k: int = 10) -> DataFrame:
    n = s["fact_order_items"].groupBy("product_key").agg(F.count(F.lit(1)).alias("items_sold")).join(s["dim_product"].select("product_key", "product_id"), "product_key")
    return n.select("product_id", "items_sold").orderBy(F.desc("items_sold"), "product_id").limit(k)


def category_contribution(s: Star, groups: int = 4) -> DataFrame:
    """Share of revenue and quartile of each category (1: the strongest)."""
    c = share(_by_category(s), "revenue", "contribution_pct")
    return c.select("category", money("revenue").alias("revenue"), "orders", "contribution_pct", F.ntile(groups).over(Window.orderBy(F.desc("revenue"), "category")).alias("quartile"))


def sellers_by_state(s: Star) -> DataFrame:
    sold = s["fact_order_items"].join(s["dim_seller"].select("seller_key", "seller_state"), "seller_key")
    return sold.groupBy("seller_state").agg(F.count_distinct("seller_key").alias("active_sellers"), F.count_distinct("order_id").alias("orders"), money(F.sum("price")).alias("revenue"))


def delayed_orders(s: Star) -> DataFrame:
    return _delivered(s).filter(F.col("delivered") > F.col("estimated")).select("order_id", "delivered", "estimated", F.datediff("delivered", "estimated").alias("delay_days"))


def delay_and_score(s: Star) -> DataFrame:
    """Average score by days of delay, in bands, and the correlation over all rows beside it."""
    d = _delivered(s).select("order_id", F.datediff("delivered", "estimated").alias("delay"))
    r = s["fact_reviews"].select("order_id", "review_score").join(d, "order_id")
    band = F.when(F.col("delay") <= 0, "on time").when(F.col("delay") <= 7, "1-7 days").when(F.col("delay") <= 30, "8-30 days").otherwise("over 30 days")
    bands = r.groupBy(band.alias("delay_band")).agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("review_score"), 4).alias("average_score"))
    return bands.crossJoin(F.broadcast(r.agg(F.round(F.corr(F.col("delay").cast("double"), F.col("review_score").cast("double")), 6).alias("correlation"))))


def score_distribution(s: Star) -> DataFrame:
    return share(s["fact_reviews"].groupBy("review_score").agg(F.count(F.lit(1)).alias("reviews")), "reviews", "pct")


def satisfaction_trend(s: Star) -> DataFrame:
    return s["fact_reviews"].groupBy(key_month("review_date_key").alias("month")).agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("review_score"), 4).alias("average_score"))


def installments(s: Star) -> DataFrame:
    return s["fact_payments"].groupBy("payment_installments").agg(F.count(F.lit(1)).alias("payments"), money(F.sum("payment_value")).alias("value"), F.round(F.avg(F.col("payment_value").cast("double")), 2).alias("average_value"))


def freight_share(s: Star) -> DataFrame:
    one = s["fact_order_items"].agg(F.sum("price").alias("p"), F.sum("freight_value").alias("f"))
    return one.select(money("p").alias("price"), money("f").alias("freight"), F.round(F.try_divide(F.col("f").cast("double") * 100, F.col("p").cast("double")), 4).alias("freight_pct"))


def customer_growth(s: Star) -> DataFrame:
    """New customers by month of first purchase, all so far, and how many of them bought again."""
    o = s["fact_orders"].join(s["dim_customer"].select("customer_key", "customer_unique_id"), "customer_key")
    first = o.groupBy("customer_unique_id").agg(F.min("purchase_date_key").alias("first_key"), F.count(F.lit(1)).alias("orders"))
    months = first.groupBy(key_month("first_key").alias("month")).agg(F.count(F.lit(1)).alias("new_customers"), F.count_if(F.col("orders") > 1).alias("repeat_customers"))
    return months.withColumn("customers_so_far", F.sum("new_customers").over(Window.orderBy("month")))
