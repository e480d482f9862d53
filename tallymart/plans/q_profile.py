"""Queries of the profiles and the anomaly register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators import digests, profile, sketches
from tallymart.plans.registry import add
from tallymart.plans.roles import SPECS, role, roles
from tallymart.sources import tables
from tallymart.specs import EDGES, LOOKUPS

NUMERIC = {"order_items": ["price", "freight_value"], "payments": ["payment_installments", "payment_value"], "products": ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm", "product_photos_qty"], "reviews": ["review_score"]}
CATEGORIES = {"orders": ["order_status"], "payments": ["payment_type"], "customers": ["customer_state", "customer_city"], "products": ["product_category_name"], "reviews": ["review_comment_message"]}
SEQUENCES = {"orders": [("order_purchase_timestamp", "order_approved_at"), ("order_purchase_timestamp", "order_delivered_carrier_date"), ("order_delivered_carrier_date", "order_delivered_customer_date"), ("order_purchase_timestamp", "order_delivered_customer_date"), ("order_purchase_timestamp", "order_estimated_delivery_date")]}
DATES = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]
TABLES = ("customers", "orders", "order_items", "payments", "reviews", "products", "sellers", "geolocation", "category_translation")

union = "\nUNION ALL ".join
pct = lambda part, whole, digits: f"coalesce(round({part} * 100.0E0 / nullif({whole}, 0), {digits}), 0)"
missing = lambda c: f"count(*) FILTER (WHERE {c} IS NULL)"

TYPES = {"order_id": "bigint", "customer_id": "bigint", "order_status": "string", **dict.fromkeys(DATES, "timestamp_ntz")}
add("column_summary", lambda s, d: profile.column_summary(role(s, d, "orders")), union(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, {missing(c)} AS missing, {pct(missing(c), 'count(*)', 2)} AS missing_pct, count(DISTINCT {c}) AS distinct_values FROM r_orders" for c, k in TYPES.items()))


def null_sql(t: str, head: str = "") -> str:
    return union(f"SELECT {head}'{c}' AS \"column\", {missing(c)} AS null_count, count(*) AS total_rows, count({c}) AS non_null_count, {pct(missing(c), 'count(*)', 4)} AS null_pct FROM r_{t}" for c in SPECS[t].columns)


def all_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.union([profile.null_profile(df).withColumn("dataset", F.lit(t)) for t, df in roles(spark, sf_dir).items()])


NULLS = union(null_sql(t, f"'{t}' AS dataset, ") for t in SPECS)
add("null_profile", all_nulls, NULLS)
_num = NUMERIC["order_items"] + ["order_item_id"]
r6 = lambda x, name: f"round({x}, 6) AS {name}"


def rounded(df: DataFrame, names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names.split()})


add("numeric_basic", lambda s, d: rounded(profile.numeric_basic(role(s, d, "order_items"), _num), "mean std"), union(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {r6(f'avg({c}::DOUBLE)', 'mean')}, quantile_cont({c}::DOUBLE, 0.5) AS median, {r6(f'stddev_samp({c}::DOUBLE)', 'std')} FROM r_order_items" for c in _num))


def five_sql(t: str, c: str) -> str:
    x = f"{c}::DOUBLE"
    return f"SELECT '{c}' AS \"column\", min({x}) AS min, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3, max({x}) AS max FROM r_{t}"


FENCES = "q3 - q1 AS iqr, q1 - 1.5E0 * (q3 - q1) AS lower_bound, q3 + 1.5E0 * (q3 - q1) AS upper_bound"
add("five_number", lambda s, d: profile.five_numbers(role(s, d, "payments"), NUMERIC["payments"]), union(f"SELECT *, {FENCES} FROM ({five_sql('payments', c)}) AS f" for c in NUMERIC["payments"]))
_p = NUMERIC["products"] + ["product_name_lenght"]
_out = lambda t, c: f"(SELECT count(*) FROM r_{t}, (SELECT *, {FENCES} FROM ({five_sql(t, c)}) AS f) AS b WHERE {c}::DOUBLE < lower_bound OR {c}::DOUBLE > upper_bound)"
add("iqr_outliers", lambda s, d: profile.iqr_outliers(role(s, d, "products"), _p), union(f"SELECT \"column\", lower_bound, upper_bound, {_out('products', c)} AS potential_outliers, {pct(_out('products', c), f'(SELECT count({c}) FROM r_products)', 2)} AS outlier_pct FROM (SELECT *, {FENCES} FROM ({five_sql('products', c)}) AS f) AS b" for c in _p))
add("outlier_rows", lambda s, d: profile.outlier_rows(role(s, d, "products").select("product_id", "product_name_lenght"), "product_name_lenght"), f"SELECT product_id, product_name_lenght, lower_bound, upper_bound FROM r_products, (SELECT {FENCES} FROM ({five_sql('products', 'product_name_lenght')}) AS f) AS b WHERE product_name_lenght::DOUBLE < lower_bound OR product_name_lenght::DOUBLE > upper_bound")
shape = lambda s: f"CASE WHEN {s} IS NULL THEN 'Undefined' WHEN abs({s}) < 0.5 THEN 'Approximately symmetric' WHEN abs({s}) <= 1.0 THEN 'Moderately skewed' ELSE 'Highly skewed' END"
direction = lambda s: f"CASE WHEN {s} IS NULL THEN 'Undefined' WHEN abs({s}) < 0.5 THEN 'Approximately symmetric' WHEN {s} > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END"
add("skewness_g1", lambda s, d: rounded(profile.skew_profile(role(s, d, "order_items"), _num), "skewness").select("column", "skewness"), union(f"SELECT '{c}' AS \"column\", {r6(f'skewness({c}::DOUBLE)', 'skewness')} FROM r_order_items" for c in _num))
add("skew_class", lambda s, d: profile.skew_profile(role(s, d, "products"), _p).select("column", "shape", "direction"), union(f"SELECT '{c}' AS \"column\", {shape(f'skewness({c}::DOUBLE)')} AS shape, {direction(f'skewness({c}::DOUBLE)')} AS direction FROM r_products" for c in _p))
add("zero_negative", lambda s, d: profile.zero_negative(role(s, d, "products"), _p), union(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 0) AS zero_count, count(*) FILTER (WHERE {c} < 0) AS negative_count FROM r_products" for c in _p))


def numeric_sql(t: str, c: str) -> str:
    x = f"{c}::DOUBLE"
    return f"""SELECT '{t}' AS dataset, '{c}' AS "column", n AS count, min, q1, median, q3, max, {r6('mean', 'mean')}, {r6('std', 'std')}, iqr, {r6('skew', 'skewness')}, {shape('skew')} AS shape, {direction('skew')} AS direction, lower_bound, upper_bound,
        {_out(t, c)} AS potential_outliers, {pct(_out(t, c), 'n', 2)} AS outlier_pct, zero_count, negative_count FROM (SELECT *, {FENCES} FROM ({five_sql(t, c)}) AS f) AS b,
        (SELECT count({c}) AS n, avg({x}) AS mean, stddev_samp({x}) AS std, skewness({x}) AS skew, count(*) FILTER (WHERE {c} = 0) AS zero_count, count(*) FILTER (WHERE {c} < 0) AS negative_count FROM r_{t}) AS a"""


NUMBERS = union(numeric_sql(t, c) for t, cs in NUMERIC.items() for c in cs)
add("numeric_profile", lambda s, d: rounded(profile.union([profile.numeric_profile(role(s, d, t), t, cs) for t, cs in NUMERIC.items()]), "mean std skewness"), NUMBERS)


def frequency_sql(t: str, c: str, where: str = "true") -> str:
    return f"SELECT category, frequency, round(frequency * 100.0E0 / sum(frequency) OVER (), 4) AS pct, CASE WHEN frequency * 100.0E0 / sum(frequency) OVER () < 1 THEN 'YES' ELSE 'NO' END AS is_rare FROM (SELECT coalesce(CAST({c} AS VARCHAR), '[NULL]') AS category, count(*) AS frequency FROM r_{t} WHERE {where} GROUP BY 1) AS g"


add("category_freq", lambda s, d: profile.category_frequency(role(s, d, "customers"), "customer_city"), frequency_sql("customers", "customer_city"))
add("category_top5", lambda s, d: profile.top_categories(role(s, d, "customers"), "customer_state"), f"SELECT * FROM ({frequency_sql('customers', 'customer_state')}) AS f ORDER BY frequency DESC, category LIMIT 5")
add("rare_categories", lambda s, d: profile.rare_categories(role(s, d, "reviews"), "review_comment_message"), f"SELECT * FROM ({frequency_sql('reviews', 'review_comment_message', 'review_comment_message IS NOT NULL')}) AS f WHERE is_rare = 'YES'")


def category_sql(t: str, c: str) -> str:
    f = frequency_sql(t, c)
    return f"""SELECT '{t}' AS dataset, '{c}' AS "column", k AS unique_categories, (SELECT category FROM ({f}) AS f ORDER BY frequency DESC, category LIMIT 1) AS top_category, top AS top_frequency, {pct('top', 'n', 2)} AS top_pct, r AS rare_categories, {pct('r', 'k', 2)} AS rare_category_pct,
        CAST(rr AS BIGINT) AS rare_rows, {pct('rr', 'n', 2)} AS rare_rows_pct FROM (SELECT count(*) AS k, max(frequency) AS top, sum(frequency) AS n, count(*) FILTER (WHERE is_rare = 'YES') AS r, coalesce(sum(frequency) FILTER (WHERE is_rare = 'YES'), 0) AS rr FROM ({f}) AS f) AS a"""


add("category_summary", lambda s, d: profile.union([profile.category_summary(role(s, d, t), t, c) for t, cs in CATEGORIES.items() for c in cs]), union(category_sql(t, c) for t, cs in CATEGORIES.items() for c in cs))
_spoken = ["review_comment_title", "review_comment_message"]
add("top_value_per_column", lambda s, d: profile.top_values(role(s, d, "reviews"), _spoken), union(f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS top_value, count(*) AS frequency, {pct('count(*)', f'(SELECT count({c}) FROM r_reviews)', 2)} AS pct FROM r_reviews WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY frequency DESC, top_value LIMIT 1) AS t" for c in _spoken))

date_sql = lambda c: f"SELECT '{c}' AS \"column\", min({c}) AS min_date, max({c}) AS max_date, {missing(c)} AS missing_count, {pct(missing(c), 'count(*)', 2)} AS missing_pct FROM r_orders"
gap_sql = lambda t, c: f"SELECT lag({c}) OVER (ORDER BY {c}) AS gap_start, {c} AS gap_end FROM (SELECT DISTINCT {c} FROM r_{t} WHERE {c} IS NOT NULL) AS x"
seconds = "CAST(floor(date_diff('microsecond', gap_start, gap_end) / 1000000) AS BIGINT)"
add("date_stats", lambda s, d: profile.date_stats(role(s, d, "orders")), union(map(date_sql, DATES)))
add("date_profile", lambda s, d: profile.date_profile(role(s, d, "orders"), "orders", DATES), union(f"SELECT 'orders' AS dataset, \"column\", (SELECT count(*) FROM r_orders) AS total_records, min_date, max_date, missing_count, missing_pct, (SELECT max({seconds}) FROM ({gap_sql('orders', c)}) AS g) AS max_gap_seconds FROM ({date_sql(c)}) AS x" for c in DATES))
_texts = ("order_purchase_timestamp", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")
add("date_stats_by_name", lambda s, d: profile.date_stats(role(s, d, "orders").select("order_id", "order_approved_at", *(F.when(F.col("order_id") % 7 == 0, "soon").otherwise(F.col(c).cast("string")).alias(c) for c in _texts)), by_name=True), union(f"SELECT '{c}' AS \"column\", min({c}) FILTER (WHERE order_id % 7 <> 0) AS min_date, max({c}) FILTER (WHERE order_id % 7 <> 0) AS max_date, count(*) FILTER (WHERE order_id % 7 = 0 OR {c} IS NULL) AS missing_count, {pct(f'count(*) FILTER (WHERE order_id % 7 = 0 OR {c} IS NULL)', 'count(*)', 2)} AS missing_pct FROM r_orders" for c in _texts))
add("date_gaps_top5", lambda s, d: profile.largest_gaps(role(s, d, "reviews"), "review_creation_date"), f"SELECT gap_start, gap_end, {seconds} AS gap_seconds FROM ({gap_sql('reviews', 'review_creation_date')}) AS g WHERE gap_start IS NOT NULL ORDER BY gap_seconds DESC, gap_start LIMIT 5")
_at = "order_purchase_timestamp"
for _name, _f, _keys in (("year_dist", profile.year_distribution, ("year",)), ("month_dist", profile.month_distribution, ("month",)), ("year_month_dist", profile.year_month_distribution, ("year", "month"))):
    _parts = ", ".join(f"CAST({k}({_at}) AS INTEGER) AS {k}" for k in _keys)
    add(_name, lambda s, d, f=_f: f(role(s, d, "orders"), _at), f"SELECT {_parts}, count(*) AS records, {pct('count(*)', f'(SELECT count({_at}) FROM r_orders)', 2)} AS pct FROM r_orders WHERE {_at} IS NOT NULL GROUP BY {', '.join(str(i + 1) for i in range(len(_keys)))}")
SEQ = union(f"SELECT '{a} -> {b}' AS sequence, count(*) FILTER (WHERE {b} < {a}) AS violations, {pct(f'count(*) FILTER (WHERE {b} < {a})', 'count(*)', 4)} AS violation_pct FROM r_orders" for a, b in SEQUENCES["orders"])
add("sequence_checks", lambda s, d: profile.sequence_checks(role(s, d, "orders"), SEQUENCES["orders"]), SEQ)
add("chronology_rows", lambda s, d: profile.chronology_rows(role(s, d, "orders"), *SEQUENCES["orders"][2]), "SELECT * FROM r_orders WHERE order_delivered_customer_date < order_delivered_carrier_date")


def key_sql(t: str, label: str, keys: tuple[str, ...], source: str | None = None) -> str:
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    g = f"SELECT count(*) AS n, bool_or({null}) AS bad FROM {source or 'r_' + t} AS t GROUP BY {', '.join(keys)}"
    s = lambda c, w: f"CAST(coalesce(sum({c}) FILTER (WHERE {w}), 0) AS BIGINT)"
    inner = f"SELECT {s('n', 'true')} AS total_rows, {s('n', 'NOT bad')} AS valid_rows, count(*) FILTER (WHERE NOT bad) AS unique_key_count, {s('n', 'NOT bad AND n > 1')} AS duplicate_key_rows, {s('n - 1', 'NOT bad')} AS excess_rows, {s('n', 'bad')} AS null_key_rows FROM ({g}) AS g"
    return f"SELECT '{label}' AS dataset, '{', '.join(keys)}' AS key_name, *, {pct('unique_key_count', 'valid_rows', 2)} AS uniqueness_pct, {pct('duplicate_key_rows', 'valid_rows', 2)} AS duplicate_pct FROM ({inner}) AS k"


add("key_profile_single", lambda s, d: profile.union([profile.key_profile(role(s, d, "reviews"), "reviews", ["review_id"]), profile.key_profile(role(s, d, "orders"), "orders", ["customer_id"])]), union([key_sql("reviews", "reviews", ("review_id",)), key_sql("orders", "orders", ("customer_id",))]))
add("key_profile_composite", lambda s, d: profile.union([profile.key_profile(role(s, d, "raw_items"), "raw_items", ["order_id", "order_item_id"]), profile.key_profile(role(s, d, "conversations"), "conversations", ["conv_id", "turn"])]), union([key_sql("raw_items", "raw_items", ("order_id", "order_item_id")), key_sql("conversations", "conversations", ("conv_id", "turn"), "conversations")]))


def rows_sql(t: str) -> str:
    u = f"(SELECT count(*) FROM (SELECT DISTINCT * FROM r_{t}) AS u)"
    return f"SELECT '{t}' AS dataset, count(*) AS total_rows, {u} AS distinct_rows, count(*) - {u} AS duplicate_rows, {pct(f'(count(*) - {u})', 'count(*)', 4)} AS duplicate_pct FROM r_{t}"




def sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each month of the orders, merged, beside exact counts: the estimate must lie within five errors."""
    o = role(spark, sf_dir, "orders").withColumn("month", F.date_format("order_purchase_timestamp", "yyyy-MM"))
    columns = ["order_id", "customer_id", "order_status", "order_purchase_timestamp"]
    merged = sketches.estimates(sketches.merge_sketches(sketches.distinct_sketches(o, columns, by=["month"]))).withColumnRenamed("distinct_values", "estimate")
    both = merged.join(sketches.distinct_counts(o, columns), "column")
    return both.select("column", "rows", "distinct_values", (F.abs(F.col("estimate") - F.col("distinct_values")) <= F.col("distinct_values") * 5 * 1.04 / 64 + 1).alias("within_bound"))


add("distinct_sketches", sketched, union(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS distinct_values, true AS within_bound FROM r_orders" for c in ("order_id", "customer_id", "order_status", "order_purchase_timestamp")))
_a, _b = "order_id % 997 <> 0", "order_id % 1009 <> 0"
add("set_difference", lambda s, d: digests.set_difference(role(s, d, "orders").filter(_a), role(s, d, "orders").filter(_b), ["order_id", "customer_id"]), f"SELECT order_id, customer_id, 'a' AS only_in FROM r_orders WHERE {_a} AND NOT ({_b}) UNION ALL SELECT order_id, customer_id, 'b' FROM r_orders WHERE {_b} AND NOT ({_a})")
add("full_row_dups", lambda s, d: profile.union([profile.row_duplicates(role(s, d, t), t) for t in ("geolocation", "raw_items", "reviews")]), union(map(rows_sql, ("geolocation", "raw_items", "reviews"))))


def relation_sql(e, label: str) -> str:
    inner = f"SELECT count(*) AS child_rows_checked, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r_{e.parent} AS p WHERE p.{e.parent_column} = c.{e.column})) AS match_count FROM r_{e.child} AS c WHERE {e.column} IS NOT NULL"
    return f"SELECT '{label}' AS relationship, child_rows_checked, match_count, child_rows_checked - match_count AS non_match_count, {pct('match_count', 'child_rows_checked', 2)} AS match_pct, {pct('(child_rows_checked - match_count)', 'child_rows_checked', 2)} AS non_match_pct FROM ({inner}) AS r"


label_of = lambda e: f"{e.child}.{e.column} -> {e.parent}"
add("relationship_single", lambda s, d: profile.union([profile.relationship(role(s, d, e.child), [e.column], role(s, d, e.parent), [e.parent_column], label_of(e)) for e in (*EDGES, *LOOKUPS)]), union(relation_sql(e, label_of(e)) for e in (*EDGES, *LOOKUPS)))
add("relationship_composite", lambda s, d: profile.relationship(role(s, d, "raw_items"), ["order_id", "order_item_id"], role(s, d, "order_items").filter("order_item_id < 5"), ["order_id", "order_item_id"], "lines"), f"SELECT 'lines' AS relationship, n AS child_rows_checked, m AS match_count, n - m AS non_match_count, {pct('m', 'n', 2)} AS match_pct, {pct('(n - m)', 'n', 2)} AS non_match_pct FROM (SELECT count(*) AS n, count(*) FILTER (WHERE order_item_id < 5) AS m FROM (SELECT DISTINCT order_id, order_item_id FROM r_raw_items) AS k) AS x")
for _e in (EDGES[0], EDGES[5], LOOKUPS[0], LOOKUPS[1]):
    add(f"unmatched_{_e.child}_{_e.column}", lambda s, d, e=_e: profile.unmatched_keys(role(s, d, e.child), e.column, role(s, d, e.parent), e.parent_column), f"SELECT DISTINCT {_e.column} FROM r_{_e.child} WHERE {_e.column} IS NOT NULL AND {_e.column} NOT IN (SELECT {_e.parent_column} FROM r_{_e.parent} WHERE {_e.parent_column} IS NOT NULL)")
_life = ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"]
add("missing_lifecycle", lambda s, d: profile.missing_lifecycle(role(s, d, "orders"), "order_status = 'delivered'", _life), f"SELECT count(*) AS affected_rows FROM r_orders WHERE order_status = 'delivered' AND ({' OR '.join(f'{c} IS NULL' for c in _life)})")
add("dup_ids", lambda s, d: profile.duplicate_ids(role(s, d, "reviews"), "review_id"), "SELECT review_id, count(*) AS occurrences FROM r_reviews GROUP BY review_id HAVING count(*) > 1")
add("dup_rows", lambda s, d: profile.duplicate_rows(role(s, d, "geolocation")), "SELECT *, count(*) AS occurrences FROM r_geolocation GROUP BY ALL HAVING count(*) > 1")
ZEROS = {"order_items": ["freight_value"], "payments": ["payment_value", "payment_installments"], "products": ["product_weight_g", "product_photos_qty"]}
add("zero_report", lambda s, d: profile.zero_report(roles(s, d, *ZEROS), ZEROS), union(f"SELECT '{t}' AS dataset, '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 0) AS zero_count FROM r_{t}" for t, cs in ZEROS.items() for c in cs))
BOUNDS = {"order_items": {"negative price": "price < 0", "negative freight": "freight_value < 0"}, "payments": {"negative value": "payment_value < 0", "negative installments": "payment_installments < 0"}, "reviews": {"score outside 1 to 5": "review_score NOT BETWEEN 1 AND 5"}, "products": {"negative width": "product_width_cm < 0", "negative photos": "product_photos_qty < 0"}}
add("bounds_report", lambda s, d: profile.bounds_report(roles(s, d, *BOUNDS), BOUNDS), union(f"SELECT '{t}' AS dataset, '{n}' AS bound, count(*) FILTER (WHERE {c}) AS violations FROM r_{t}" for t, named in BOUNDS.items() for n, c in named.items()))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.anomaly_register(tables.stage(roles(spark, sf_dir, *TABLES)), SPECS, (*EDGES, *LOOKUPS), NUMERIC, CATEGORIES, SEQUENCES)


def anomaly(source: str, where: str, dataset: str, what: str, kind: str, label: str, count: str, percentage: str, description: str) -> str:
    return f"SELECT {dataset} AS dataset, {what} AS column_or_relationship, '{kind}' AS anomaly_type, {label} AS classification, CAST({count} AS BIGINT) AS count, round(CAST({percentage} AS DOUBLE), 4) AS percentage, {description} AS description FROM ({source}) AS s WHERE {where}"


def register_sql() -> str:
    parts = []
    for t in TABLES:
        keys = ", ".join(f"'{k}'" for k in SPECS[t].key)
        label = f"CASE WHEN \"column\" IN ({keys}) THEN 'Confirmed anomaly' ELSE 'Observation' END" if keys else "'Observation'"
        parts.append(anomaly(null_sql(t), "null_count > 0", f"'{t}'", '"column"', "Missing Values", label, "null_count", "null_pct", "'values are missing'"))
        if keys:
            parts.append(anomaly(key_sql(t, t, SPECS[t].key), "duplicate_key_rows > 0", f"'{t}'", "key_name", "Duplicate Keys", "'Confirmed anomaly'", "duplicate_key_rows", "duplicate_pct", "'rows share a key'"))
        else:
            parts.append(anomaly(rows_sql(t), "duplicate_rows > 0", f"'{t}'", "'__FULL_ROW__'", "Duplicate Rows", "'Potential anomaly'", "duplicate_rows", "duplicate_pct", "'rows repeat others'"))
    c = '"column"'
    parts.append(anomaly(NUMBERS, "potential_outliers > 0", "dataset", c, "Extreme Values", "'Observation'", "potential_outliers", "outlier_pct", "'values lie outside the fences'"))
    parts.append(anomaly(NUMBERS, "negative_count > 0", "dataset", c, "Invalid Negative Values", "'Confirmed anomaly'", "negative_count", pct("negative_count", '"count"', 4), "'values below zero'"))
    parts.append(anomaly(NUMBERS, "zero_count > 0", "dataset", c, "Zero Values", "'Observation'", "zero_count", pct("zero_count", '"count"', 4), "'values are zero'"))
    parts.append(anomaly(NUMBERS, "shape = 'Highly skewed'", "dataset", c, "Highly Skewed", "'Observation'", '"count"', "100.0E0", "lower(direction)"))
    parts.append(anomaly(SEQ, "violations > 0", "'orders'", "sequence", "Suspicious Dates", "'Confirmed anomaly'", "violations", "violation_pct", "'a later event comes first'"))
    for e in (*EDGES, *LOOKUPS):
        label = "'Potential anomaly'" if e.lookup else "'Confirmed anomaly'"
        parts.append(anomaly(relation_sql(e, label_of(e)), "non_match_count > 0", f"'{e.child}'", "relationship", "Unmatched Keys", label, "non_match_count", "non_match_pct", "'keys have no counterpart'"))
    for t, cs in CATEGORIES.items():
        for col in cs:
            parts.append(anomaly(category_sql(t, col), "rare_categories > 0", f"'{t}'", c, "Rare Categories", "'Observation'", "rare_categories", "rare_category_pct", "'categories hold under one per cent'"))
    return union(parts)


REGISTER = register_sql()
add("anomaly_register", register, REGISTER)
add("anomaly_by_class", lambda s, d: profile.anomalies_by_class(register(s, d)), f"SELECT classification, count(*) AS anomalies, count(DISTINCT dataset) AS datasets FROM ({REGISTER}) AS r GROUP BY classification")
add("top_missing_columns", lambda s, d: profile.top_missing(roles(s, d)), f"SELECT dataset, \"column\", null_count, null_pct FROM ({NULLS}) AS n WHERE null_count > 0 ORDER BY null_pct DESC, dataset, \"column\" LIMIT 5")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.stage(roles(spark, sf_dir, *TABLES))
    numbers = profile.union([profile.numeric_profile(t[n], n, cs) for n, cs in NUMERIC.items()])
    categories = profile.union([profile.category_summary(t[n], n, c) for n, cs in CATEGORIES.items() for c in cs])
    dates = profile.date_stats(t["orders"], DATES).select(F.lit("orders").alias("dataset"), "*")
    anomalies = profile.anomaly_register(t, SPECS, (*EDGES, *LOOKUPS), NUMERIC, CATEGORIES, SEQUENCES)
    return profile.observations(tables.overview(t), profile.top_missing(t), numbers, categories, dates, profile.anomalies_by_class(anomalies))


_no = "CAST(NULL AS DOUBLE) AS percentage"
add("observations", observed, union([
    *(f"SELECT 'Dataset coverage' AS section, '{t}' AS dataset, 'rows' AS subject, count(*) AS amount, {_no} FROM r_{t}" for t in TABLES),
    f"SELECT 'Missing values', dataset, \"column\", null_count, null_pct FROM (SELECT * FROM ({NULLS}) AS n WHERE null_count > 0 ORDER BY null_pct DESC, dataset, \"column\" LIMIT 5) AS m",
    f"SELECT shape, dataset, \"column\", \"count\", {_no} FROM ({NUMBERS}) AS s WHERE shape IN ('Highly skewed', 'Moderately skewed')",
    f"SELECT 'Potential outliers', dataset, \"column\", potential_outliers, outlier_pct FROM ({NUMBERS}) AS o WHERE potential_outliers > 0",
    f"SELECT 'Dominant category', dataset, \"column\" || ': ' || top_category, top_frequency, top_pct FROM ({union(category_sql(t, c) for t, cs in CATEGORIES.items() for c in cs)}) AS c",
    f"SELECT 'Missing dates', 'orders', \"column\", missing_count, missing_pct FROM ({union(map(date_sql, DATES))}) AS d",
    f"SELECT 'Anomalies', 'all', classification, count(*), {_no} FROM ({REGISTER}) AS r GROUP BY classification",
]))
