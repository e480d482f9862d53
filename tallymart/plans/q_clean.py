"""Queries of preprocessing, audited cleaning and validation after cleaning."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import columns as C
from tallymart.operators import clean, key_index, observed, preprocess, reconcile
from tallymart.plans.registry import add, text, with_rows
from tallymart.plans.roles import SPECS, role, roles
from tallymart.sources import files, tables
from tallymart.specs import EDGES, LOOKUPS, NULL_TOKENS, DatasetSpec

# ---------------------------------------------------------------- raw text, made from the given tables

#: Values with blanks, null tokens and numbers that do not parse, in SQL that both engines read.
RAW = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NA' WHEN 1 THEN ' ' WHEN 2 THEN '   ' WHEN 3 THEN '' ELSE '  ' || event_type || '  X ' END AS label,
    CASE event_id % 5 WHEN 0 THEN '3.0' WHEN 1 THEN '3.7' WHEN 2 THEN 'abc' WHEN 3 THEN NULL ELSE CAST(user_id AS VARCHAR(20)) END AS amount,
    CASE event_id % 4 WHEN 0 THEN '2017-10-02 10:56:33' WHEN 1 THEN '2017-13-01' WHEN 2 THEN 'none' ELSE '2018-01-05 00:00:00' END AS seen_at FROM {events}"""
RAW_SPEC = DatasetSpec("raw", {"event_id": "integer", "label": "string", "amount": "integer", "seen_at": "datetime"}, categorical=("label",))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW.replace("VARCHAR(20)", "STRING"), events=role(spark, sf_dir, "events"))


def raw_sql(body: str) -> str:
    return f"WITH raw AS ({RAW.format(events='events')}) {body}"


TOKENS = ", ".join(text(t) for t in NULL_TOKENS)
NULLED = f"CASE WHEN {{0}} IN ({TOKENS}) THEN NULL ELSE {{0}} END"
COLLAPSED = r"regexp_replace(regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g'), '[\s]+', ' ', 'g')"
INTEGER = "CASE WHEN TRY_CAST({0} AS DOUBLE) = floor(TRY_CAST({0} AS DOUBLE)) THEN CAST(TRY_CAST({0} AS DOUBLE) AS BIGINT) END"

add("nulls_normalized", lambda s, d: preprocess.normalize_nulls(raw(s, d), ["label", "seen_at"]), raw_sql(f"SELECT event_id, {NULLED.format('label')} AS label, amount, {NULLED.format('seen_at')} AS seen_at FROM raw"))
add("text_normalized", lambda s, d: preprocess.normalize_text(role(s, d, "conversations").select("conv_id", "turn", "text"), ["text"]), f"SELECT conv_id, turn, {COLLAPSED.format('text')} AS text FROM conversations")
add("categories_normalized", lambda s, d: preprocess.normalize_categories(raw(s, d).select("event_id", "label"), ["label"]), raw_sql(f"SELECT event_id, lower({COLLAPSED.format('label')}) AS label FROM raw"))
add("timestamps_parsed", lambda s, d: preprocess.parse_timestamps(raw(s, d).select("event_id", "seen_at"), ["seen_at"]).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz")), raw_sql("SELECT event_id, TRY_CAST(seen_at AS TIMESTAMP) AS seen_at FROM raw"))
add("numeric_converted", lambda s, d: preprocess.convert_numeric(raw(s, d).select("event_id", "amount"), ["amount"]), raw_sql("SELECT event_id, TRY_CAST(amount AS DOUBLE) AS amount FROM raw"))
add("integer_converted", lambda s, d: preprocess.convert_integer(raw(s, d).select("event_id", "amount"), ["amount"]), raw_sql(f"SELECT event_id, {INTEGER.format('amount')} AS amount FROM raw"))
add("integer_rejects", lambda s, d: raw(s, d).agg(F.count_if(C.is_fraction(F.col("amount"))).alias("fractions"), F.count_if(F.col("amount").isNotNull() & C.to_number(F.col("amount")).isNull()).alias("not_numbers")), raw_sql("SELECT count(*) FILTER (WHERE TRY_CAST(amount AS DOUBLE) <> floor(TRY_CAST(amount AS DOUBLE))) AS fractions, count(*) FILTER (WHERE amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS not_numbers FROM raw"))
add("dtypes_normalized", lambda s, d: preprocess.normalize_dtypes(raw(s, d), ["seen_at"], [], ["amount"], ["event_id"]).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz")), raw_sql(f"SELECT CAST(event_id AS VARCHAR) AS event_id, label, {INTEGER.format('amount')} AS amount, TRY_CAST(seen_at AS TIMESTAMP) AS seen_at FROM raw"))


def preprocessed(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return preprocess.preprocess_dataset(raw(spark, sf_dir), "raw", {"raw": RAW_SPEC}, strict_nulls=strict).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


_label = f"lower({COLLAPSED.format('(' + NULLED.format('label') + ')')})"
add("preprocessed_dataset", preprocessed, raw_sql(f"SELECT event_id, {_label} AS label, {INTEGER.format('amount')} AS amount, TRY_CAST(seen_at AS TIMESTAMP) AS seen_at FROM raw"))
add("preprocessed_strict", partial(preprocessed, strict=True), raw_sql(f"SELECT event_id, nullif({_label}, '') AS label, {INTEGER.format('amount')} AS amount, TRY_CAST(seen_at AS TIMESTAMP) AS seen_at FROM raw"))
add("code_upper_trim", lambda s, d: preprocess.standardise_codes(raw(s, d).select("event_id", "label"), ["label"]), raw_sql("SELECT event_id, trim(upper(label)) AS label FROM raw"))
add("blank_to_null", lambda s, d: preprocess.blanks_to_null(raw(s, d).select("event_id", "label"), ["label"]), raw_sql("SELECT event_id, lower(nullif(trim(label), '')) AS label FROM raw"))

_cols = SPECS["customers"].columns
_kinds = {c: "string" if c in ("customer_city", "customer_state") else "bigint" for c in ("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state")}
add("dtype_summary", lambda s, d: preprocess.dtype_summary(role(s, d, "customers")), "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM r_customers" for c, k in _kinds.items()))
add("missing_summary", lambda s, d: preprocess.missing_summary(role(s, d, "customers")), "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_count, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS missing_rate FROM r_customers" for c in _kinds))
_geo = "SELECT count(*) AS n FROM r_geolocation GROUP BY ALL_COLUMNS".replace("ALL_COLUMNS", ", ".join(("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state")))
add("duplicate_summary", lambda s, d: preprocess.duplicate_summary(role(s, d, "geolocation")), f"SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS participating_rows, CAST(sum(n - 1) AS BIGINT) AS excess_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups FROM ({_geo}) AS g")

# ---------------------------------------------------------------- audited cleaning

add("dedup_full_row", lambda s, d: clean.drop_duplicate_rows(role(s, d, "geolocation")), "SELECT DISTINCT * FROM r_geolocation")
_carrier = "CASE WHEN order_delivered_carrier_date < order_purchase_timestamp THEN NULL ELSE order_delivered_carrier_date END"
_some = "order_id", "order_purchase_timestamp", "order_delivered_carrier_date", "order_delivered_customer_date"
add("nullify_carrier", lambda s, d: clean.nullify_before(role(s, d, "orders").select(*_some), *clean.ORDER_CHAIN[0]), f"SELECT order_id, order_purchase_timestamp, {_carrier} AS order_delivered_carrier_date, order_delivered_customer_date FROM r_orders")
add("nullify_customer_chained", lambda s, d: clean.nullify_chain(role(s, d, "orders").select(*_some), clean.ORDER_CHAIN, "chained"), f"SELECT order_id, order_purchase_timestamp, carrier AS order_delivered_carrier_date, CASE WHEN order_delivered_customer_date < carrier THEN NULL ELSE order_delivered_customer_date END AS order_delivered_customer_date FROM (SELECT *, {_carrier} AS carrier FROM r_orders) AS o")
add("nullify_customer_independent", lambda s, d: clean.nullify_chain(role(s, d, "orders").select(*_some), clean.ORDER_CHAIN, "independent"), f"SELECT order_id, order_purchase_timestamp, {_carrier} AS order_delivered_carrier_date, CASE WHEN order_delivered_customer_date < order_delivered_carrier_date THEN NULL ELSE order_delivered_customer_date END AS order_delivered_customer_date FROM r_orders")
add("nullify_zero", lambda s, d: clean.nullify_value(role(s, d, "payments").select("order_id", "payment_sequential", "payment_installments"), "payment_installments", 0), "SELECT order_id, payment_sequential, nullif(payment_installments, 0) AS payment_installments FROM r_payments")


def cleaned(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame]:
    return clean.clean_all(roles(spark, sf_dir), LOOKUPS)


def audited(spark: SparkSession, sf_dir: str, use) -> DataFrame:
    """What ``use`` makes of the given tables and of an audited write of all cleaned ones; nothing of the write stays."""
    given, base = roles(spark, sf_dir), f"{tables.shared_folder(spark)}/audited-{uuid.uuid4().hex}"
    try:
        written, done = observed.write_clean(given, base)
        return tables.settle(use(given, written, done))
    finally:
        files.delete(spark, base)


def whole_log(given: dict, written: dict, done: list) -> DataFrame:
    """Rules of rows come from the write; repeated ids and lookups need their key column alone."""
    spark = next(iter(given.values())).sparkSession
    grouped = [clean.audit_repeated_id(given["reviews"], "reviews", "review_id"), *(clean.audit_unmatched(given, e, "DOCUMENTED" if e.child == "products" else "APPLIED") for e in LOOKUPS)]
    return reduce(DataFrame.unionByName, grouped, observed.audit_log(spark, done)).select("dataset", "column", "issue", "action", "rows_affected", "rows_before", "rows_after", "status")


def log_of(*datasets: str):
    return lambda s, d: cleaned(s, d)[1].filter(F.col("dataset").isin(*datasets)).select("dataset", "column", "issue", "action", "rows_affected", "rows_before", "rows_after", "status")


def entry(dataset: str, column: str, issue: str, action: str, affected: str, source: str | None = None, after: str = "count(*)", status: str = "APPLIED") -> str:
    return f"SELECT '{dataset}' AS dataset, '{column}' AS \"column\", '{issue}' AS issue, '{action}' AS action, {affected} AS rows_affected, count(*) AS rows_before, {after} AS rows_after, '{status}' AS status FROM {source or 'r_' + dataset} AS src"


_flt = "count(*) FILTER (WHERE {})"
_first = f"(SELECT order_id, order_status, order_purchase_timestamp, {_carrier} AS order_delivered_carrier_date, order_delivered_customer_date FROM r_orders)"
_done = f"(SELECT order_id, order_status, order_delivered_carrier_date, CASE WHEN order_delivered_customer_date < order_delivered_carrier_date THEN NULL ELSE order_delivered_customer_date END AS order_delivered_customer_date FROM {_first} AS f)"
LOG_SQL = {
    "audit_nullified": [
        entry("orders", "order_delivered_carrier_date", "earlier than order_purchase_timestamp", "SET_INVALID_TIMESTAMP_TO_NULL", _flt.format("order_delivered_carrier_date < order_purchase_timestamp")),
        entry("orders", "order_delivered_customer_date", "earlier than order_delivered_carrier_date", "SET_INVALID_TIMESTAMP_TO_NULL", _flt.format("order_delivered_customer_date < order_delivered_carrier_date"), _first),
        *(entry("orders", c, "delivered without a date", "RETAIN_NULL", _flt.format(f"order_status = 'delivered' AND {c} IS NULL"), _done) for c in ("order_delivered_carrier_date", "order_delivered_customer_date")),
    ],
    "audit_retain_zero": [
        entry("order_items", "freight_value", "zero value", "RETAIN", _flt.format("freight_value = 0")),
        entry("payments", "payment_installments", "value 0", "SET_INVALID_VALUE_TO_NULL", _flt.format("payment_installments = 0")),
        entry("payments", "payment_value", "zero value", "RETAIN", _flt.format("payment_value = 0")),
    ],
    "audit_retain_null": [
        entry("products", "product_category_name", "missing value", "RETAIN_NULL", _flt.format("product_category_name IS NULL")),
        entry("products", "product_weight_g", "zero value", "RETAIN", _flt.format("product_weight_g = 0")),
    ],
    "audit_nonunique_id": [
        entry("reviews", "review_id", "repeated id", "RETAIN", "(SELECT count(*) FROM (SELECT 1 FROM r_reviews GROUP BY review_id HAVING count(*) > 1) AS g)"),
        entry("reviews", "__FULL_ROW__", "repeated rows", "DEDUPLICATE", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r_reviews) AS u)", None, "(SELECT count(*) FROM (SELECT DISTINCT * FROM r_reviews) AS u)"),
        *(entry("reviews", c, "missing value", "RETAIN_NULL", _flt.format(f"{c} IS NULL"), "(SELECT DISTINCT * FROM r_reviews)") for c in ("review_comment_title", "review_comment_message")),
    ],
    "audit_duplicates": [entry("geolocation", "__FULL_ROW__", "repeated rows", "DEDUPLICATE", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r_geolocation) AS u)", None, "(SELECT count(*) FROM (SELECT DISTINCT * FROM r_geolocation) AS u)")],
    "audit_unmatched_lookup": [
        entry(e.child, e.column, f"not in {e.parent}", "RETAIN_SOURCE_LIMITATION" if e.child == "products" else "RETAIN", f"count(*) FILTER (WHERE {e.column} IS NOT NULL AND {e.column} NOT IN (SELECT {e.parent_column} FROM r_{e.parent}))", status="DOCUMENTED" if e.child == "products" else "APPLIED")
        for e in LOOKUPS
    ],
}
_of = {"audit_nullified": ("orders",), "audit_retain_zero": ("order_items", "payments"), "audit_nonunique_id": ("reviews",), "audit_duplicates": ("geolocation",)}
for _name, _datasets in _of.items():
    add(_name, log_of(*_datasets), "\nUNION ALL ".join(LOG_SQL[_name]))
add("audit_retain_null", lambda s, d: log_of("products")(s, d).filter("issue NOT LIKE 'not in %'"), "\nUNION ALL ".join(LOG_SQL["audit_retain_null"]))
add("audit_unmatched_lookup", lambda s, d: log_of("customers", "sellers", "products")(s, d).filter("issue LIKE 'not in %'"), "\nUNION ALL ".join(LOG_SQL["audit_unmatched_lookup"]))
LOG = "\nUNION ALL ".join(x for part in LOG_SQL.values() for x in part)
add("audit_log", lambda s, d: audited(s, d, whole_log), LOG)
#: What cleaning leaves, in SQL.
CLEANED = {
    "customers": "SELECT customer_id, customer_unique_id, customer_zip_code_prefix, trim(upper(customer_city)) AS customer_city, trim(upper(customer_state)) AS customer_state FROM r_customers",
    "geolocation": "SELECT DISTINCT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, trim(upper(geolocation_city)) AS geolocation_city, trim(upper(geolocation_state)) AS geolocation_state FROM r_geolocation",
    "orders": f"SELECT f.order_id, f.customer_id, f.order_status, f.order_purchase_timestamp, f.order_approved_at, f.carrier AS order_delivered_carrier_date, CASE WHEN order_delivered_customer_date < carrier THEN NULL ELSE order_delivered_customer_date END AS order_delivered_customer_date, order_estimated_delivery_date FROM (SELECT *, {_carrier} AS carrier FROM r_orders) AS f",
    "order_items": "SELECT * FROM r_order_items",
    "payments": "SELECT order_id, payment_sequential, payment_type, nullif(payment_installments, 0) AS payment_installments, payment_value FROM r_payments",
    "reviews": "SELECT DISTINCT * FROM r_reviews",
    "products": "SELECT * REPLACE (lower(nullif(trim(product_category_name), '')) AS product_category_name) FROM r_products",
    "sellers": "SELECT seller_id, seller_zip_code_prefix, trim(upper(seller_city)) AS seller_city, trim(upper(seller_state)) AS seller_state FROM r_sellers",
    "category_translation": "SELECT DISTINCT lower(nullif(trim(product_category_name), '')) AS product_category_name, lower(nullif(trim(product_category_name_english), '')) AS product_category_name_english FROM r_category_translation",
}


add("row_invariant", lambda s, d: audited(s, d, lambda given, written, done: observed.row_invariants(s, done)), "\nUNION ALL ".join(f"SELECT '{n}' AS dataset, (SELECT count(*) FROM r_{n}) AS rows_before, (SELECT count(*) FROM ({q}) AS t) AS rows_after, (SELECT count(*) FROM r_{n}) = (SELECT count(*) FROM ({q}) AS t) AS unchanged" for n, q in CLEANED.items()))


def figures_sql(name: str) -> str:
    cols = list(SPECS[name].columns)
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    of = lambda src, what: f"(SELECT {what} FROM ({src}) AS t)"
    before, after = f"SELECT * FROM r_{name}", CLEANED[name]
    rows = {k: of(src, "count(*)") for k, src in (("b", before), ("a", after))}
    repeats = {k: f"{rows[k]} - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({src}) AS t) AS u)" for k, src in (("b", before), ("a", after))}
    return f"""SELECT '{name}' AS dataset, {rows['b']} AS rows_before, {rows['a']} AS rows_after, {rows['b']} - {rows['a']} AS rows_removed, CAST({len(cols)} AS BIGINT) AS columns_before, CAST({len(cols)} AS BIGINT) AS columns_after,
        {of(before, nulls)} AS null_cells_before, {of(after, nulls)} AS null_cells_after, {repeats['b']} AS exact_duplicates_before, {repeats['a']} AS exact_duplicates_after"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_summary(roles(spark, sf_dir), cleaned(spark, sf_dir)[0])


SUMMARY = "\nUNION ALL ".join(figures_sql(n) for n in SPECS)
add("clean_summary", summary, SUMMARY)
add("clean_totals", lambda s, d: clean.clean_totals(summary(s, d), cleaned(s, d)[1]), f"SELECT count(*) AS datasets, CAST(sum(rows_before) AS BIGINT) AS rows_before, CAST(sum(rows_after) AS BIGINT) AS rows_after, CAST(sum(rows_removed) AS BIGINT) AS rows_removed, (SELECT count(*) FROM ({LOG}) AS l) AS actions, (SELECT count(*) FROM ({LOG}) AS l WHERE status = 'APPLIED') AS actions_applied FROM ({SUMMARY}) AS s")
for _name in CLEANED:
    add(f"cleaned_{_name}", lambda s, d, n=_name: cleaned(s, d)[0][n], CLEANED[_name])
for _nulls in (False, True):
    add("gate_fk" + "_null_counted" * _nulls, lambda s, d, n=_nulls: clean.edge_report(roles(s, d), EDGES, n), "\nUNION ALL ".join(f"SELECT '{e.child}' AS child, '{e.column}' AS \"column\", '{e.parent}' AS parent, count(*) AS orphans FROM r_{e.child} AS c WHERE {'' if _nulls else f'c.{e.column} IS NOT NULL AND '}NOT EXISTS (SELECT 1 FROM r_{e.parent} AS p WHERE p.{e.parent_column} = c.{e.column})" for e in EDGES))
def indexed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges by an index of the parent's keys, null child keys counted and not."""
    t = roles(spark, sf_dir)
    parts = [clean.rows_of(key_index.orphan_counts(t[e.child], e.column, t[e.parent], e.parent_column, nulls), "orphans").select(F.lit(e.child).alias("child"), F.lit(e.column).alias("column"), F.lit(nulls).alias("nulls_counted"), "orphans") for e in EDGES for nulls in (False, True)]
    return reduce(DataFrame.unionByName, parts)


add("gate_fk_by_index", indexed_edges, "\nUNION ALL ".join(f"SELECT '{e.child}' AS child, '{e.column}' AS \"column\", {str(nulls).lower()} AS nulls_counted, count(*) AS orphans FROM r_{e.child} AS c WHERE {'' if nulls else f'c.{e.column} IS NOT NULL AND '}NOT EXISTS (SELECT 1 FROM r_{e.parent} AS p WHERE p.{e.parent_column} = c.{e.column})" for e in EDGES for nulls in (False, True)))
add("gate_pk", lambda s, d: clean.key_report(roles(s, d), SPECS), "\nUNION ALL ".join(f"SELECT '{n}' AS dataset, '{', '.join(sp.key)}' AS key_name, '' AS missing_columns, (SELECT count(*) FROM r_{n} WHERE {' OR '.join(f'{k} IS NULL' for k in sp.key)}) AS null_keys, (SELECT count(*) FROM (SELECT 1 FROM r_{n} GROUP BY {', '.join(sp.key)} HAVING count(*) > 1) AS g) AS duplicate_groups" for n, sp in SPECS.items() if sp.key))

# ---------------------------------------------------------------- after cleaning


def check_sql(category: str, dataset: str, rule: str, expected: str, actual: str, severity: str = "HIGH") -> str:
    return f"SELECT '{category}' AS category, '{dataset}' AS dataset, '{rule}' AS rule, CAST(e AS VARCHAR) AS expected, CAST(a AS VARCHAR) AS actual, CAST(abs(a - e) AS BIGINT) AS failed_count, CASE WHEN a = e THEN 'NONE' ELSE '{severity}' END AS severity, CASE WHEN a = e THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT {expected} AS e, {actual} AS a) AS x"


def clean_cte(body: str) -> str:
    """``c_name`` stands for a cleaned table."""
    named = [n for n in CLEANED if f"c_{n}" in body]
    return f"WITH {', '.join(f'c_{n} AS ({CLEANED[n]})' for n in named)} {body}" if named else body


n_of = lambda t, where="true": f"(SELECT count(*) FROM {t} WHERE {where})"
repeats_of = lambda t, keys: f"(SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(keys)} HAVING count(*) > 1) AS g)"
KEYS, COMPOSITE = {n: SPECS[n].key for n in ("customers", "orders", "products", "sellers")}, {n: SPECS[n].key for n in ("order_items", "payments")}
CHRONOLOGY = {"orders": {"carrier not before purchase": "order_delivered_carrier_date < order_purchase_timestamp", "customer not before carrier": "order_delivered_customer_date < order_delivered_carrier_date", "customer not before purchase": "order_delivered_customer_date < order_purchase_timestamp"}}
ZERO, NEGATIVE = {"payments": {"no zero installments": "payment_installments = 0"}}, {"order_items": {"price not negative": "price < 0", "freight not negative": "freight_value < 0"}, "payments": {"value not negative": "payment_value < 0"}}
KEPT, KEPT_NULL = {"order_items": {"zero freight": "freight_value = 0"}, "payments": {"zero value": "payment_value = 0"}, "products": {"zero weight": "product_weight_g = 0"}}, {"products": {"missing category": "product_category_name IS NULL"}}
#: Declarations that wrongly make the review id a key; the policy must say so.
DECLARED, _policy = {**SPECS, "reviews": replace(SPECS["reviews"], key=("review_id",))}, "review_id is no declared key, or never repeats"


def written_tables_exist(spark: SparkSession, c: dict) -> DataFrame:
    """Cleaned tables are written, if they are not yet, then looked for in their folders, and so is one that nobody wrote."""
    written = all(hasattr(df, "staged_at") for df in c.values())
    staged = c if written else tables.stage(c)
    base = next(iter(staged.values())).staged_at
    try:
        found = reconcile.tables_exist(spark, {n: f"{base}/{n}" for n in (*SPECS, "returns")})
        return tables.settle(tables.beside_rows(found, staged))  # the check says nothing about rows, so rows stand beside it
    finally:
        if not written:
            tables.discard(spark, staged)


POST: dict[str, tuple] = {
    "post_existence": (lambda s, raw_, c: written_tables_exist(s, c), "\nUNION ALL ".join(check_sql("Existence", n, "the cleaned table exists", "1", "0" if n == "returns" else "1", "CRITICAL") for n in (*SPECS, "returns"))),
    "post_row_count": (lambda s, raw_, c: reconcile.expected_rows(c, {"sellers": 100}, raw_), "\nUNION ALL ".join(check_sql("Row Count", n, "rows as expected", "100" if n == "sellers" else n_of(f"r_{n}"), n_of(f"c_{n}")) for n in SPECS)),
    "post_primary_keys": (lambda s, raw_, c: reconcile.repeated_keys(c, KEYS, "Primary Key"), "\nUNION ALL ".join(check_sql("Primary Key", n, f"unique {', '.join(k)}", "0", repeats_of(f"c_{n}", k), "CRITICAL") for n, k in KEYS.items())),
    "post_composite_keys": (lambda s, raw_, c: reconcile.repeated_keys(c, COMPOSITE, "Composite Key"), "\nUNION ALL ".join(check_sql("Composite Key", n, f"unique {', '.join(k)}", "0", repeats_of(f"c_{n}", k), "CRITICAL") for n, k in COMPOSITE.items())),
    "post_orphans": (lambda s, raw_, c: reconcile.orphans(c, EDGES), "\nUNION ALL ".join(check_sql("Referential Integrity", e.child, f"{e.column} found in {e.parent}", "0", f"(SELECT count(*) FROM c_{e.child} AS c WHERE NOT EXISTS (SELECT 1 FROM c_{e.parent} AS p WHERE p.{e.parent_column} = c.{e.column}))", e.severity) for e in EDGES)),
    "post_lookup_gap": (lambda s, raw_, c: reconcile.lookup_gap(c, LOOKUPS[0], 13), check_sql("Lookup Coverage", "products", "rows without category_translation as expected", "13", n_of("c_products", "product_category_name NOT IN (SELECT product_category_name FROM c_category_translation)"), "LOW")),
    "post_duplicates": (lambda s, raw_, c: reconcile.no_repeated_rows(c, ["geolocation", "reviews"]), "\nUNION ALL ".join(check_sql("Duplicate Removal", n, "no repeated rows", "0", f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c_{n}) AS u) FROM c_{n})") for n in ("geolocation", "reviews"))),
    "post_key_policy": (lambda s, raw_, c: reconcile.union([reconcile.not_a_key(c, specs, "reviews", "review_id") for specs in (SPECS, DECLARED)]), check_sql("Key Policy", "reviews", _policy, "0", "0", "CRITICAL") + " UNION ALL " + check_sql("Key Policy", "reviews", _policy, "0", "(SELECT count(*) FROM (SELECT 1 FROM c_reviews WHERE review_id IS NOT NULL GROUP BY review_id HAVING count(*) > 1) AS g)", "CRITICAL")),
}
for _name, _category, _conditions in (("post_chronology", "Chronology", CHRONOLOGY), ("post_zero", "Zero Values", ZERO), ("post_negative", "Negative Values", NEGATIVE)):
    POST[_name] = (lambda s, raw_, c, g=_category, k=_conditions: reconcile.none_where(c, k, g), "\nUNION ALL ".join(check_sql(_category, n, rule, "0", n_of(f"c_{n}", where)) for n, named in _conditions.items() for rule, where in named.items()))
for _name, _category, _conditions in (("post_zero_kept", "Preservation", KEPT), ("post_null_kept", "Null Preservation", KEPT_NULL)):
    POST[_name] = (lambda s, raw_, c, g=_category, k=_conditions: reconcile.preserved(raw_, c, k, g), "\nUNION ALL ".join(check_sql(_category, n, rule, n_of(f"r_{n}", where), n_of(f"c_{n}", where), "MEDIUM") for n, named in _conditions.items() for rule, where in named.items()))
def post(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(spark, roles(spark, sf_dir), cleaned(spark, sf_dir)[0])


for _name, (_f, _sql) in POST.items():
    add(_name, partial(post, _f), clean_cte(with_rows(_sql, SPECS, "c_") if _name == "post_existence" else _sql))


def post_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks read every table several times, so roles and cleaned tables are written first, each from what is
    written already, and deleted afterwards."""
    before = tables.stage(roles(spark, sf_dir))
    after = {}
    try:
        after = tables.stage(clean.clean_all(before, LOOKUPS)[0])
        checked = [f(spark, before, after) for f, _ in POST.values()]
        return tables.settle(reconcile.union([c.drop("total_rows") for c in checked]))
    finally:
        tables.discard(spark, {**before, **{f"cleaned {n}": df for n, df in after.items()}})


_every = " UNION ALL ".join(sql for _, sql in POST.values())
add("post_verdict", lambda s, d: reconcile.verdict(post_all(s, d)), clean_cte(f"SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'FAIL') AS failed_checks, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status FROM ({_every}) AS p"))
add("post_summary", lambda s, d: reconcile.summary(post_all(s, d), "category"), clean_cte(f"SELECT category, count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed FROM ({_every}) AS p GROUP BY category"))


def summary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an expectation that knows nothing of removed rows, and one dataset more."""
    got = summary(spark, sf_dir).select("dataset", "rows_before", "rows_removed")
    expected = got.select("dataset", "rows_before", F.lit(0).cast("long").alias("rows_removed")).unionByName(spark.range(1).select(F.lit("returns").alias("dataset"), F.lit(1).cast("long").alias("rows_before"), F.lit(0).cast("long").alias("rows_removed")))
    return reconcile.summary_matches(got, expected)


add("post_summary_match", summary_check, f"SELECT 'Cleaning Summary' AS category, dataset, CASE WHEN rows_removed <> 0 THEN 'rows_removed' ELSE '' END AS differences, CASE WHEN rows_removed <> 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({SUMMARY}) AS s UNION ALL SELECT 'Cleaning Summary', 'returns', 'rows_before, rows_removed', 'FAIL'")
add("run_summary", lambda s, d: clean.table_figures(role(s, d, "order_items"), "now"), "SELECT count(*) AS rows_now, CAST(7 AS BIGINT) AS columns_now, CAST(0 AS BIGINT) AS null_cells_now, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r_order_items) AS u) AS exact_duplicates_now FROM r_order_items")

# ---------------------------------------------------------------- written and read again


def overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaned table written twice to one place: the second write replaces the first."""
    path = f"{tables.shared_folder(spark)}/cleaned-{uuid.uuid4().hex}"
    done = cleaned(spark, sf_dir)[0]["payments"]
    try:
        tables.save(done.limit(0), path)
        tables.save(done, path)
        return tables.settle(tables.load(spark, path))
    finally:
        files.delete(spark, path)


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaned tables created as tables, replaced by a second run; rows by table. The tables go afterwards."""
    run, names = uuid.uuid4().hex, {n: f"cleaned_{n}_" for n in CLEANED}
    base = f"{tables.shared_folder(spark)}/tables-{run}"
    try:
        for name, df in cleaned(spark, sf_dir)[0].items():
            for _ in range(2):
                tables.save_table(df, names[name] + run, f"{base}/{name}")
        return tables.settle(tables.overview({n: spark.table(t + run) for n, t in names.items()}))
    finally:
        for t in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {t}{run}")
        files.delete(spark, base)


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log written by dataset and read again."""
    path = f"{tables.shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log = cleaned(spark, sf_dir)[1]
    try:
        tables.save(log, path, partition_by=("dataset",))
        return tables.settle(tables.load(spark, path).select(*log.columns).drop("rule", "rationale"))
    finally:
        files.delete(spark, path)


add("write_cleaned", overwritten, CLEANED["payments"])
add("write_tables", created, clean_cte("\nUNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS total_rows, CAST({len(SPECS[n].columns)} AS BIGINT) AS total_columns FROM c_{n}" for n in CLEANED)))
add("write_log", logged, LOG)
