"""Queries of the star schema, its reconciliation, key figures and business questions.

Surrogate keys are hashed, so SQL compares what they point to: keys are exchanged for business keys first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators import kpi, reconcile, star
from tallymart.operators.figures import MonthlyFigures
from tallymart.plans.q_clean import CLEANED, cleaned
from tallymart.plans.registry import add
from tallymart.plans.roles import role
from tallymart.sources import files
from tallymart.sources.tables import discard, settle, shared_folder, stage, version_conflicts

_dk = lambda c: f"CAST(strftime({c}, '%Y%m%d') AS INTEGER)"

#: The model in SQL over cleaned tables, with business keys in place of surrogates.
MODEL = {
    "s_customer": "SELECT DISTINCT * FROM c_customers WHERE customer_id IS NOT NULL",
    "s_seller": "SELECT DISTINCT * FROM c_sellers WHERE seller_id IS NOT NULL",
    "s_product": "SELECT p.*, t.product_category_name_english FROM c_products AS p LEFT JOIN c_category_translation AS t ON t.product_category_name = p.product_category_name WHERE product_id IS NOT NULL",
    "s_geography": "SELECT zip_code_prefix, city, state, latitude, longitude FROM (SELECT geolocation_zip_code_prefix AS zip_code_prefix, geolocation_city AS city, geolocation_state AS state, geolocation_lat AS latitude, geolocation_lng AS longitude, row_number() OVER (PARTITION BY geolocation_zip_code_prefix ORDER BY geolocation_city NULLS LAST, geolocation_state NULLS LAST, geolocation_lat NULLS LAST, geolocation_lng NULLS LAST) AS rn FROM c_geolocation WHERE geolocation_zip_code_prefix IS NOT NULL) AS g WHERE rn = 1",
    "s_date": f"""SELECT {_dk('full_date')} AS date_key, full_date, CAST(year(full_date) AS INTEGER) AS year, CAST(quarter(full_date) AS INTEGER) AS quarter, 'Q' || quarter(full_date) AS quarter_name, CAST(month(full_date) AS INTEGER) AS month, monthname(full_date) AS month_name, strftime(full_date, '%Y-%m') AS month_year,
        CAST(weekofyear(full_date) AS INTEGER) AS week_of_year, CAST(day(full_date) AS INTEGER) AS day_of_month, CAST(isodow(full_date) AS INTEGER) AS day_of_week, dayname(full_date) AS day_name, isodow(full_date) >= 6 AS is_weekend
        FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS full_date FROM (SELECT CAST(min(order_purchase_timestamp) AS DATE) AS lo, CAST(max(order_estimated_delivery_date) AS DATE) AS hi FROM c_orders) AS x) AS y""",
    "f_orders": f"SELECT order_id, o.customer_id, order_status, {_dk('order_purchase_timestamp')} AS purchase_date_key, {_dk('order_approved_at')} AS approved_date_key, {_dk('order_delivered_carrier_date')} AS delivered_carrier_date_key, {_dk('order_delivered_customer_date')} AS delivered_customer_date_key, {_dk('order_estimated_delivery_date')} AS estimated_delivery_date_key FROM c_orders AS o JOIN s_customer AS c ON c.customer_id = o.customer_id WHERE order_status IS NOT NULL",
    "f_items": "SELECT i.order_id, order_item_id, i.product_id, i.seller_id, purchase_date_key AS order_date_key, price, freight_value FROM c_order_items AS i JOIN s_product AS p ON p.product_id = i.product_id JOIN s_seller AS s ON s.seller_id = i.seller_id JOIN f_orders AS o ON o.order_id = i.order_id",
    "f_payments": "SELECT p.order_id, payment_sequential, customer_id, CAST(NULL AS INTEGER) AS payment_date_key, payment_type, payment_installments, payment_value FROM c_payments AS p JOIN f_orders AS o ON o.order_id = p.order_id",
    "f_reviews": f"SELECT review_id, r.order_id, customer_id, {_dk('review_creation_date')} AS review_date_key, review_score, review_comment_title, review_comment_message, review_answer_timestamp FROM c_reviews AS r JOIN f_orders AS o ON o.order_id = r.order_id",
}


def model_sql(body: str) -> str:
    """Common table expressions of the model and the cleaned tables that ``body`` leads to."""
    import re

    every = {**{f"c_{n}": q for n, q in CLEANED.items()}, **MODEL}
    needed: set[str] = set()

    def walk(sql: str) -> None:
        for n in every:
            if n not in needed and re.search(rf"\b{n}\b", sql):
                needed.add(n)
                walk(every[n])

    walk(body)
    return f"WITH {', '.join(f'{n} AS ({q})' for n, q in every.items() if n in needed)} {body}"


def built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return star.build_star(cleaned(spark, sf_dir)[0])


def model(name: str, query, sql: str | None) -> None:
    add(name, lambda s, d: query(built(s, d)), model_sql(sql) if sql else None)


def with_business_keys(m: dict[str, DataFrame], fact: str) -> DataFrame:
    """A fact with what its surrogate keys stand for, and without its own key."""
    keys = {"customer_key": ("dim_customer", "customer_id"), "order_status_key": ("dim_order_status", "order_status"), "product_key": ("dim_product", "product_id"), "seller_key": ("dim_seller", "seller_id")}
    out = m[fact]
    for k, (dim, business) in keys.items():
        if k in out.columns:
            out = out.join(m[dim].select(k, business), k, "left").drop(k)
    return out.drop({"fact_orders": "order_key", "fact_order_items": "order_item_key", "fact_payments": "payment_key", "fact_reviews": "review_key"}[fact])


for _name, _key, _cte in (("dim_customer", "customer_key", "s_customer"), ("dim_seller", "seller_key", "s_seller"), ("dim_product", "product_key", "s_product"), ("dim_geography", "geography_key", "s_geography")):
    model(_name, lambda m, n=_name, k=_key: m[n].drop(k), f"SELECT * FROM {_cte}")
add("dim_person", lambda s, d: star.dim_person(cleaned(s, d)[0]["customers"]).drop("person_key"), model_sql("SELECT customer_unique_id, customer_id, customer_zip_code_prefix, customer_city, customer_state FROM c_customers WHERE customer_unique_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY customer_id DESC) = 1"))
add("dim_conflicts", lambda s, d: version_conflicts(cleaned(s, d)[0]["customers"], ["customer_unique_id"]), model_sql("SELECT customer_unique_id, count(*) AS rows, count(DISTINCT (customer_id, customer_zip_code_prefix, customer_city, customer_state)) AS versions FROM c_customers WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id HAVING count(DISTINCT (customer_id, customer_zip_code_prefix, customer_city, customer_state)) > 1"))
model("dim_status", lambda m: m["dim_order_status"].select("order_status"), "SELECT DISTINCT order_status FROM c_orders WHERE order_status IS NOT NULL")
model("dim_date", lambda m: m["dim_date"], "SELECT * FROM s_date")
for _name, _fact, _cte in (("fact_orders", "fact_orders", "f_orders"), ("fact_items", "fact_order_items", "f_items"), ("fact_payments", "fact_payments", "f_payments"), ("fact_reviews", "fact_reviews", "f_reviews")):
    model(_name, lambda m, f=_fact: with_business_keys(m, f), f"SELECT * FROM {_cte}")


def load_summary(m: dict[str, DataFrame]) -> DataFrame:
    from tallymart.sources.tables import overview

    return overview(m).select("dataset", "total_rows")


_sizes = {"dim_date": "s_date", "dim_customer": "s_customer", "dim_seller": "s_seller", "dim_product": "s_product", "dim_geography": "s_geography", "fact_orders": "f_orders", "fact_order_items": "f_items", "fact_payments": "f_payments", "fact_reviews": "f_reviews"}
model("load_summary", load_summary, " UNION ALL ".join([*(f"SELECT '{n}' AS dataset, count(*) AS total_rows FROM {c}" for n, c in _sizes.items()), "SELECT 'dim_order_status', count(DISTINCT order_status) FROM c_orders"]))
_totals = "SELECT order_id, n_items, items_value, freight_value, n_payments, payment_value FROM (SELECT order_id, count(*) AS n_items, sum(price) AS items_value, sum(freight_value) AS freight_value FROM f_items GROUP BY order_id) AS i FULL JOIN (SELECT order_id, count(*) AS n_payments, sum(payment_value) AS payment_value FROM f_payments GROUP BY order_id) AS p USING (order_id)"
_double = lambda df, *names: df.withColumns({n: F.round(F.col(n).cast("double"), 2) for n in names})
model("order_totals", lambda m: _double(star.order_totals(m["fact_order_items"], m["fact_payments"]), "items_value", "freight_value", "payment_value"), f"SELECT order_id, n_items, round(items_value::DOUBLE, 2) AS items_value, round(freight_value::DOUBLE, 2) AS freight_value, n_payments, round(payment_value::DOUBLE, 2) AS payment_value FROM ({_totals}) AS t")
model("fanout_guard", lambda m: star.fanout_guard(m["fact_payments"].join(m["dim_customer"], "customer_key"), m["fact_payments"]).unionByName(star.fanout_guard(m["fact_payments"].join(m["fact_order_items"].select("order_id"), "order_id"), m["fact_payments"])), "SELECT count(*) AS fact_rows, count(*) AS joined_rows, 'PASS' AS status FROM f_payments UNION ALL SELECT (SELECT count(*) FROM f_payments), (SELECT count(*) FROM f_payments JOIN f_items USING (order_id)), CASE WHEN (SELECT count(*) FROM f_payments) = (SELECT count(*) FROM f_payments JOIN f_items USING (order_id)) THEN 'PASS' ELSE 'FAIL' END")

# ---------------------------------------------------------------- reconciliation


def check(area: str, name: str, notes: str, source: str, target: str) -> str:
    return f"SELECT '{area}' AS validation_area, '{name}' AS check_name, CAST(a AS DOUBLE) AS source_count, CAST(b AS DOUBLE) AS target_count, round(CAST(a AS DOUBLE) - CAST(b AS DOUBLE), 2) AS difference, CASE WHEN round(CAST(a AS DOUBLE) - CAST(b AS DOUBLE), 2) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, '{notes}' AS notes FROM (SELECT {source} AS a, {target} AS b) AS x"


_n = lambda t: f"(SELECT count(*) FROM {t})"
_c = {"customers": "c_customers", "sellers": "c_sellers", "products": "c_products", "orders": "c_orders", "order_items": "c_order_items", "payments": "c_payments", "reviews": "c_reviews"}
_t = {"dim_customer": "s_customer", "dim_seller": "s_seller", "dim_product": "s_product", "fact_orders": "f_orders", "fact_order_items": "f_items", "fact_payments": "f_payments", "fact_reviews": "f_reviews"}
_dup = lambda t, keys: f"(SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(keys)} HAVING count(*) > 1) AS g)"
_distinct = lambda t, keys: f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {t}) AS u)" if keys else _n(t)
_business = {"customer_key": "customer_id", "order_status_key": "order_status", "product_key": "product_id", "seller_key": "seller_id"}
MODEL_CHECKS = {
    "model_row_count": (reconcile.row_counts, [*(check("ROW_COUNT", n, f"one row of {t} for each of {s}", _n(_c[s]), _n(_t[t])) for n, s, t in reconcile.ROW_COUNTS), check("ROW_COUNT", "Geolocation -> dim_geography", "at the grain of ZIP prefixes", "(SELECT count(DISTINCT geolocation_zip_code_prefix) FROM c_geolocation)", _n("s_geography"))]),
    "model_fact_grain": (lambda c, m: reconcile.fact_grain(m), [check("FACT_GRAIN", f"{t} duplicate {' + '.join(k)}", "one row for each", "0", "0" if t == "fact_reviews" else _dup(_t[t], k)) for t, k in reconcile.GRAINS.items()]),
    "model_primary_key": (lambda c, m: reconcile.surrogate_keys(m), [check("PRIMARY_KEY", f"{t} duplicate {k}", "a key is unique", "0", f"(SELECT 0 FROM {_n(_t[t])} AS z)") for t, k in reconcile.SURROGATES.items()]),
    "model_foreign_key": (lambda c, m: reconcile.foreign_keys(m), [check("FOREIGN_KEY", f"{f}.{k} -> {d}", "every key is found", "0", f"(SELECT count(*) FROM {_t[f]} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT date_key FROM s_date))" if d == "dim_date" else f"(SELECT count(*) FROM {_t[f]} WHERE {_business[k]} IS NULL)") for f, k, d, _, _ in reconcile.FOREIGN_KEYS]),
    "model_reconciliation": (reconcile.business_keys, [check("RECONCILIATION", n, "the source''s keys are all there", _distinct(_c[s], k), _distinct(_t[t], k)) for n, s, t, k in reconcile.BUSINESS_KEYS]),
    "model_business_total": (reconcile.business_totals, [check("BUSINESS_TOTAL", n, f"{c} adds up to the source", f"(SELECT sum({c}) FROM {_c[s]})", f"(SELECT sum({c}) FROM {_t[t]})") for n, s, t, c in reconcile.TOTALS]),
    "model_key_completeness": (lambda c, m: reconcile.mandatory_keys(m), [check("KEY_COMPLETENESS", f"{t} {k} NULL", "the key is mandatory", "0", f"(SELECT count(*) FROM {_t[t]} WHERE {_business[k]} IS NULL)") for t, k in reconcile.MANDATORY]),
    "model_date_dimension": (lambda c, m: reconcile.date_dimension(m), [check("DATE_DIMENSION", f"dim_date duplicate {k}", "one row for each", "0", _dup("s_date", (k,))) for k in reconcile.DATE_KEYS]),
}


#: What an area of checks reads; the others read all of the model and the cleaned tables.
READ = {
    "model_fact_grain": tuple(reconcile.GRAINS), "model_primary_key": tuple(reconcile.SURROGATES), "model_key_completeness": tuple({t: None for t, _ in reconcile.MANDATORY}), "model_date_dimension": ("dim_date",),
    "model_business_total": tuple({t: None for _, _, t, _ in reconcile.TOTALS}),
}


def run_checks(f, spark: SparkSession, sf_dir: str, needed: tuple[str, ...] = tuple(star.MADE_FROM)) -> DataFrame:
    """Checks read a table of the model several times, and tables of the model each other, so the cleaned tables and the
    model (or the tables ``needed``, and what these are made from) are written first, and deleted when the results are
    there."""
    wanted, written = star.with_sources(needed), {}
    c = stage({n: df for n, df in cleaned(spark, sf_dir)[0].items() if n in wanted})
    try:
        written = star.build_star(c, staged=True, needed=needed)
        return settle(f(c, written))
    finally:
        discard(spark, {**c, **written})


for _name, (_f, _sqls) in MODEL_CHECKS.items():
    add(_name, lambda s, d, f=_f, r=READ.get(_name, tuple(star.MADE_FROM)): run_checks(f, s, d, r), model_sql(" UNION ALL ".join(_sqls)))
_all = " UNION ALL ".join(x for _, sqls in MODEL_CHECKS.values() for x in sqls)
add("model_results", lambda s, d: reconcile.in_order(run_checks(reconcile.validate_model, s, d)), model_sql(_all))
add("model_set_proof", lambda s, d: run_checks(lambda c, m: reconcile.business_keys(c, m, prove_sets=True), s, d).select("check_name", "status"), model_sql(" UNION ALL ".join(f"SELECT '{n}' AS check_name, CASE WHEN {_distinct(_c[s], k)} = {_distinct(_t[t], k)} THEN 'PASS' ELSE 'FAIL' END AS status" for n, s, t, k in reconcile.BUSINESS_KEYS)))
add("model_summary", lambda s, d: reconcile.summary(run_checks(reconcile.validate_model, s, d)), model_sql(f"SELECT validation_area, count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed FROM ({_all}) AS r GROUP BY validation_area"))
add("model_verdict", lambda s, d: reconcile.verdict(run_checks(reconcile.validate_model, s, d)), model_sql(f"SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'FAIL') AS failed_checks, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status FROM ({_all}) AS r"))

# ---------------------------------------------------------------- key figures and questions

money = lambda x, name: f"round(CAST({x} AS DOUBLE), 2) AS {name}"
month = lambda k: f"substr(CAST({k} AS VARCHAR), 1, 4) || '-' || substr(CAST({k} AS VARCHAR), 5, 2)"
day = lambda k: f"CAST(strptime(CAST({k} AS VARCHAR), '%Y%m%d') AS DATE)"
pct = lambda a, b, n=2: f"coalesce(round({a} * 100.0E0 / nullif({b}, 0), {n}), 0)"
_monthly = f"SELECT {month('purchase_date_key')} AS month, sum(payment_value) AS revenue FROM f_payments JOIN f_orders USING (order_id) GROUP BY 1"
_category = "SELECT coalesce(product_category_name_english, product_category_name, 'unknown') AS category, sum(price) AS revenue, count(DISTINCT order_id) AS orders FROM f_items JOIN s_product USING (product_id) GROUP BY 1"
_delivered = f"SELECT order_id, {day('delivered_customer_date_key')} AS delivered, {day('purchase_date_key')} AS purchased, {day('estimated_delivery_date_key')} AS estimated FROM f_orders WHERE delivered_customer_date_key IS NOT NULL"
model("kpi_01_revenue", kpi.total_revenue, f"SELECT {money('sum(payment_value)', 'total_revenue')} FROM f_payments")
model("kpi_02_orders", kpi.total_orders, "SELECT count(DISTINCT order_id) AS total_orders FROM f_orders")
model("kpi_03_order_value", kpi.average_order_value, "SELECT round(CAST((SELECT sum(payment_value) FROM f_payments) AS DOUBLE) / (SELECT count(DISTINCT order_id) FROM f_orders), 2) AS average_order_value")
model("kpi_04_growth", kpi.monthly_growth, f"SELECT month, {money('revenue', 'revenue')}, round((CAST(revenue AS DOUBLE) - before) * 100 / nullif(before, 0), 2) AS growth_pct FROM (SELECT *, CAST(lag(revenue) OVER (ORDER BY month) AS DOUBLE) AS before FROM ({_monthly}) AS m) AS g")
model("kpi_05_top_categories", kpi.top_categories, f"SELECT CAST(rank AS INTEGER) AS rank, category, {money('revenue', 'revenue')}, orders FROM (SELECT *, rank() OVER (ORDER BY revenue DESC, category) AS rank FROM ({_category}) AS c) AS r WHERE rank <= 5")
_sold = "SELECT i.seller_id, seller_state, sum(price) AS revenue, count(DISTINCT CASE WHEN order_status = 'delivered' THEN i.order_id END) AS completed_orders FROM f_items AS i JOIN f_orders AS o ON o.order_id = i.order_id JOIN s_seller AS s ON s.seller_id = i.seller_id GROUP BY ALL"
model("kpi_06_top_sellers", kpi.top_sellers, f"SELECT seller_id, seller_state, {money('revenue', 'revenue')}, completed_orders FROM (SELECT * FROM ({_sold}) AS s ORDER BY s.revenue DESC, seller_id LIMIT 10) AS t")
model("kpi_05_top_categories_by_orders", lambda m: kpi.top_categories(m, "orders"), f"SELECT CAST(rank AS INTEGER) AS rank, category, {money('revenue', 'revenue')}, orders FROM (SELECT *, rank() OVER (ORDER BY orders DESC, category) AS rank FROM ({_category}) AS c) AS r WHERE rank <= 5")
model("kpi_06_top_sellers_by_orders", lambda m: kpi.top_sellers(m, "completed_orders"), f"SELECT seller_id, seller_state, {money('revenue', 'revenue')}, completed_orders FROM (SELECT * FROM ({_sold}) AS s ORDER BY completed_orders DESC, s.revenue DESC, seller_id LIMIT 10) AS t")
model("kpi_07_state_revenue", kpi.revenue_by_state, f"SELECT customer_state, {money('sum(payment_value)', 'revenue')}, count(DISTINCT order_id) AS orders FROM f_payments JOIN s_customer USING (customer_id) GROUP BY customer_state")
model("kpi_08_delivery_days", kpi.delivery_days, f"SELECT round(avg(date_diff('day', purchased, delivered)), 2) AS average_delivery_days FROM ({_delivered}) AS d")
model("kpi_09_on_time", kpi.on_time_rate, f"SELECT {pct('count(*) FILTER (WHERE delivered <= estimated)', 'count(*)')} AS on_time_pct FROM ({_delivered}) AS d")
model("kpi_10_review_score", kpi.average_review, "SELECT round(avg(review_score), 2) AS average_review_score, count(review_score) AS reviews FROM f_reviews")
model("kpi_11_statuses", kpi.status_distribution, f"SELECT order_status, count(*) AS orders, {pct('count(*)', '(SELECT count(*) FROM f_orders)')} AS pct FROM f_orders GROUP BY order_status")
model("kpi_12_payment_methods", kpi.payment_methods, f"SELECT payment_type, count(*) AS payments, count(DISTINCT order_id) AS orders, {pct('count(*)', '(SELECT count(*) FROM f_payments)')} AS pct_of_payments, {pct('count(DISTINCT order_id)', '(SELECT count(DISTINCT order_id) FROM f_payments)')} AS pct_of_orders FROM f_payments GROUP BY payment_type")
model("bq_01_sales_trend", kpi.sales_trend, f"SELECT m.month, CAST(ceil(CAST(substr(m.month, 6, 2) AS INTEGER) / 3.0) AS INTEGER) AS quarter, CAST(substr(m.month, 1, 4) AS INTEGER) AS year, {money('m.revenue', 'revenue')}, {money('e.revenue', 'revenue_last_year')}, round(CAST(m.revenue - e.revenue AS DOUBLE) * 100 / nullif(CAST(e.revenue AS DOUBLE), 0), 2) AS yoy_pct FROM ({_monthly}) AS m LEFT JOIN ({_monthly}) AS e ON e.month = CAST(CAST(substr(m.month, 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(m.month, 5, 3)")
for _period, _named in (("quarter", "substr(month, 1, 4) || '-Q' || CAST(CAST(ceil(CAST(substr(month, 6, 2) AS INTEGER) / 3.0) AS INTEGER) AS VARCHAR)"), ("year", "substr(month, 1, 4)")):
    _sums = f"SELECT {_named} AS period, sum(revenue) AS revenue FROM ({_monthly}) AS m GROUP BY 1"
    model(f"bq_01_sales_by_{_period}", lambda m, p=_period: kpi.sales_by_period(m, p), f"SELECT p.period, {money('p.revenue', 'revenue')}, {money('e.revenue', 'revenue_last_year')}, round(CAST(p.revenue - e.revenue AS DOUBLE) * 100 / nullif(CAST(e.revenue AS DOUBLE), 0), 2) AS yoy_pct FROM ({_sums}) AS p LEFT JOIN ({_sums}) AS e ON e.period = CAST(CAST(substr(p.period, 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(p.period, 5, 3)")
model("bq_02_customers_by_place", kpi.customers_by_place, "SELECT customer_state, customer_city, count(DISTINCT customer_unique_id) AS customers, count(order_id) AS orders FROM s_customer LEFT JOIN f_orders USING (customer_id) GROUP BY 1, 2")
model("bq_03_seasonality", kpi.seasonality, "SELECT month, month_name, day_of_week, day_name, count(*) AS orders FROM f_orders JOIN s_date ON date_key = purchase_date_key GROUP BY 1, 2, 3, 4")
model("bq_04_top_products", kpi.top_products, "SELECT product_id, count(*) AS items_sold FROM f_items GROUP BY product_id ORDER BY items_sold DESC, product_id LIMIT 10")
model("bq_05_category_contribution", kpi.category_contribution, f"SELECT category, {money('revenue', 'revenue')}, orders, {pct('CAST(revenue AS DOUBLE)', '(SELECT CAST(sum(price) AS DOUBLE) FROM f_items)')} AS contribution_pct, CAST(ntile(4) OVER (ORDER BY revenue DESC, category) AS INTEGER) AS quartile FROM ({_category}) AS c")
model("bq_06_sellers_by_state", kpi.sellers_by_state, f"SELECT seller_state, count(DISTINCT seller_id) AS active_sellers, count(DISTINCT order_id) AS orders, {money('sum(price)', 'revenue')} FROM f_items JOIN s_seller USING (seller_id) GROUP BY seller_state")
model("bq_07_delayed_orders", kpi.delayed_orders, f"SELECT order_id, delivered, estimated, CAST(date_diff('day', estimated, delivered) AS INTEGER) AS delay_days FROM ({_delivered}) AS d WHERE delivered > estimated")
_late = f"SELECT review_score, date_diff('day', estimated, delivered) AS delay FROM f_reviews JOIN ({_delivered}) AS d USING (order_id)"
model("bq_08_delay_and_score", kpi.delay_and_score, f"SELECT CASE WHEN delay <= 0 THEN 'on time' WHEN delay <= 7 THEN '1-7 days' WHEN delay <= 30 THEN '8-30 days' ELSE 'over 30 days' END AS delay_band, count(*) AS reviews, round(avg(review_score), 4) AS average_score, (SELECT round(corr(CAST(delay AS DOUBLE), CAST(review_score AS DOUBLE)), 6) FROM ({_late}) AS r) AS correlation FROM ({_late}) AS r GROUP BY 1")
model("bq_09_score_distribution", kpi.score_distribution, f"SELECT review_score, count(*) AS reviews, {pct('count(*)', '(SELECT count(*) FROM f_reviews)')} AS pct FROM f_reviews GROUP BY review_score")
model("bq_09_satisfaction_trend", kpi.satisfaction_trend, f"SELECT {month('review_date_key')} AS month, count(*) AS reviews, round(avg(review_score), 4) AS average_score FROM f_reviews GROUP BY 1")
model("bq_10_installments", kpi.installments, f"SELECT payment_installments, count(*) AS payments, {money('sum(payment_value)', 'value')}, round(avg(CAST(payment_value AS DOUBLE)), 2) AS average_value FROM f_payments GROUP BY payment_installments")
model("bq_10_freight_share", kpi.freight_share, f"SELECT {money('sum(price)', 'price')}, {money('sum(freight_value)', 'freight')}, round(CAST(sum(freight_value) AS DOUBLE) * 100 / nullif(CAST(sum(price) AS DOUBLE), 0), 4) AS freight_pct FROM f_items")
model("bq_11_customer_growth", kpi.customer_growth, f"SELECT month, new_customers, repeat_customers, CAST(sum(new_customers) OVER (ORDER BY month) AS BIGINT) AS customers_so_far FROM (SELECT {month('k')} AS month, count(*) AS new_customers, count(*) FILTER (WHERE n > 1) AS repeat_customers FROM (SELECT customer_unique_id, min(purchase_date_key) AS k, count(*) AS n FROM f_orders JOIN s_customer USING (customer_id) GROUP BY 1) AS f GROUP BY 1) AS m")

# ---------------------------------------------------------------- figures kept and refreshed


def kept_figures(spark: SparkSession, sf_dir: str, use) -> DataFrame:
    """Stored monthly sums: most orders first; then a small load with the others, and with some whose payments doubled."""
    path = f"{shared_folder(spark)}/figures-{uuid.uuid4().hex}"
    orders, payments = role(spark, sf_dir, "orders"), role(spark, sf_dir, "payments")
    try:
        f = MonthlyFigures(spark, path, buckets=16)
        f.refresh(orders.filter("order_id % 97 <> 0"), payments.filter("order_id % 97 <> 0"))
        some = "order_id % 97 = 0 OR order_id % 50 = 0"
        twice = F.when(F.col("order_id") % 50 == 0, F.col("payment_value") * 2).otherwise(F.col("payment_value"))
        f.refresh(orders.filter(some), payments.filter(some).withColumn("payment_value", twice))
        return settle(use(f))
    finally:
        files.delete(spark, path)


_paid = "SELECT order_id, count(*) AS payments, sum(CASE WHEN order_id % 50 = 0 THEN payment_value * 2 ELSE payment_value END) AS revenue FROM r_payments GROUP BY order_id"
_came, _bought = "CAST(order_delivered_customer_date AS DATE)", "CAST(order_purchase_timestamp AS DATE)"
_sums = f"SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month, count(*) AS orders, CAST(sum(coalesce(payments, 0)) AS BIGINT) AS payments, sum(coalesce(revenue, 0)) AS revenue, count({_came}) AS delivered, CAST(coalesce(sum(date_diff('day', {_bought}, {_came})), 0) AS BIGINT) AS delivery_days, count(*) FILTER (WHERE {_came} <= CAST(order_estimated_delivery_date AS DATE)) AS on_time FROM r_orders LEFT JOIN ({_paid}) AS p USING (order_id) GROUP BY 1"
_r2 = lambda part, whole: f"round(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), 2)"
add("kpi_stored_by_month", lambda s, d: kept_figures(s, d, MonthlyFigures.by_month), f"SELECT month, orders, payments, round(CAST(revenue AS DOUBLE), 2) AS revenue, delivered, delivery_days, on_time, {_r2('revenue', 'orders')} AS average_order_value, round((CAST(revenue AS DOUBLE) - before) * 100 / nullif(before, 0), 2) AS growth_pct FROM (SELECT *, CAST(lag(revenue) OVER (ORDER BY month) AS DOUBLE) AS before FROM ({_sums}) AS m) AS g")
add("kpi_stored_totals", lambda s, d: kept_figures(s, d, MonthlyFigures.totals), f"SELECT round(CAST(sum(revenue) AS DOUBLE), 2) AS total_revenue, CAST(sum(orders) AS BIGINT) AS total_orders, {_r2('sum(revenue)', 'sum(orders)')} AS average_order_value, {_r2('sum(delivery_days)', 'sum(delivered)')} AS average_delivery_days, coalesce(round(sum(on_time) * 100.0E0 / nullif(sum(delivered), 0), 2), 0) AS on_time_pct FROM ({_sums}) AS m")
