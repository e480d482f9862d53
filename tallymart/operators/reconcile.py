"""Reconciliation of a star schema with its sources, and validation after cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators.checks import rows_of, unmatched_counts
from tallymart.operators.digests import repeat_figures, same_set
from tallymart.sources.tables import probe

Tables = dict[str, DataFrame]

#: (name, source table, target table); geography is compared at the grain of distinct ZIP prefixes.
ROW_COUNTS = (
    ("Customers -> dim_customer", "customers", "dim_customer"), ("Sellers -> dim_seller", "sellers", "dim_seller"), ("Products -> dim_product", "products", "dim_product"), ("Orders -> fact_orders", "orders", "fact_orders"),
    ("Order Items -> fact_order_items", "order_items", "fact_order_items"), ("Payments -> fact_payments", "payments", "fact_payments"), ("Reviews -> fact_reviews", "reviews", "fact_reviews"),
)
GRAINS = {"fact_orders": ("order_id",), "fact_order_items": ("order_id", "order_item_id"), "fact_payments": ("order_id", "payment_sequential"), "fact_reviews": ("review_key",)}
SURROGATES = {"dim_customer": "customer_key", "dim_seller": "seller_key", "dim_product": "product_key", "fact_orders": "order_key"}
#: (fact, key, dimension, dimension key, null keys count as orphans)
FOREIGN_KEYS = (
    ("fact_orders", "customer_key", "dim_customer", "customer_key", True), ("fact_orders", "order_status_key", "dim_order_status", "order_status_key", True), ("fact_order_items", "product_key", "dim_product", "product_key", True),
    ("fact_order_items", "seller_key", "dim_seller", "seller_key", True), ("fact_order_items", "order_date_key", "dim_date", "date_key", False), ("fact_payments", "customer_key", "dim_customer", "customer_key", True),
    ("fact_reviews", "customer_key", "dim_customer", "customer_key", True), ("fact_reviews", "review_date_key", "dim_date", "date_key", False),
)
BUSINESS_KEYS = (
    ("Customer business-key reconciliation", "customers", "dim_customer", ("customer_id",)), ("Product business-key reconciliation", "products", "dim_product", ("product_id",)), ("Seller business-key reconciliation", "sellers", "dim_seller", ("seller_id",)), ("Order business-key reconciliation", "orders", "fact_orders", ("order_id",)),
    ("Order-item business-key reconciliation", "order_items", "fact_order_items", ("order_id", "order_item_id")), ("Payment business-key reconciliation", "payments", "fact_payments", ("order_id", "payment_sequential")), ("Review row-count reconciliation", "reviews", "fact_reviews", ()),
)
TOTALS = (("Payment value reconciliation", "payments", "fact_payments", "payment_value"), ("Order-item price reconciliation", "order_items", "fact_order_items", "price"), ("Freight value reconciliation", "order_items", "fact_order_items", "freight_value"))
MANDATORY = (("fact_orders", "customer_key"), ("fact_orders", "order_status_key"), ("fact_order_items", "product_key"), ("fact_order_items", "seller_key"))
DATE_KEYS = ("date_key", "full_date")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def result(one: DataFrame, area: str, check: str, notes: str, source: Column, target: Column, status: Column | None = None) -> DataFrame:
    """A typed row; it passes if source and target agree."""
    s, t = source.cast("double"), target.cast("double")
    return one.select(F.lit(area).alias("validation_area"), F.lit(check).alias("check_name"), s.alias("source_count"), t.alias("target_count"), F.round(s - t, 2).alias("difference"), F.when(status if status is not None else F.round(s - t, 2) == 0, "PASS").otherwise("FAIL").alias("status"), F.lit(notes).alias("notes"))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row frames as one."""
    return a.crossJoin(F.broadcast(b))


def row_counts(src: Tables, star: Tables) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [result(_beside(n(src[s], "a"), n(star[t], "b")), "ROW_COUNT", name, f"one row of {t} for each of {s}", F.col("a"), F.col("b")) for name, s, t in ROW_COUNTS]
    zips = src["geolocation"].agg(F.count_distinct("geolocation_zip_code_prefix").alias("a"))
    return union([*parts, result(_beside(zips, n(star["dim_geography"], "b")), "ROW_COUNT", "Geolocation -> dim_geography", "at the grain of ZIP prefixes", F.col("a"), F.col("b"))])


def _repeats(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    if set(keys) == set(df.columns):
        return repeat_figures(df).select(F.col("duplicate_groups").alias("b"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("b"))


def fact_grain(star: Tables) -> DataFrame:
    return union([result(_repeats(star[t], keys), "FACT_GRAIN", f"{t} duplicate {' + '.join(keys)}", "one row for each", F.lit(0), F.col("b")) for t, keys in GRAINS.items()])


def surrogate_keys(star: Tables) -> DataFrame:
    return union([result(_repeats(star[t], (k,)), "PRIMARY_KEY", f"{t} duplicate {k}", "a key is unique", F.lit(0), F.col("b")) for t, k in SURROGATES.items()])


def foreign_keys(star: Tables) -> DataFrame:
    parts = []
    for fact, key, dim, dim_key, nulls in FOREIGN_KEYS:
        orphans = rows_of(unmatched_counts(star[fact], key, star[dim], dim_key, nulls), "b")  # a hot or missing key is one row
        parts.append(result(orphans, "FOREIGN_KEY", f"{fact}.{key} -> {dim}", "every key is found", F.lit(0), F.col("b")))
    return union(parts)


def business_keys(src: Tables, star: Tables, prove_sets: bool = False) -> DataFrame:
    """Counts of distinct keys on both sides; ``prove_sets`` compares the sets themselves."""
    parts = []
    for name, s, t, keys in BUSINESS_KEYS:
        amount = F.count_distinct(*keys) if keys else F.count(F.lit(1))
        both = _beside(src[s].agg(amount.alias("a")), star[t].agg(amount.alias("b")))
        status = None
        if prove_sets and keys:
            proof = same_set(src[s].dropna(subset=list(keys)), star[t].dropna(subset=list(keys)), list(keys))
            both, status = proof.select(F.col("a_rows").alias("a"), F.col("b_rows").alias("b"), "same"), F.col("same")
        parts.append(result(both, "RECONCILIATION", name, "the source's keys are all there", F.col("a"), F.col("b"), status))
    return union(parts)


def business_totals(src: Tables, star: Tables) -> DataFrame:
    total = lambda df, c, name: df.agg(F.round(F.coalesce(F.sum(F.col(c).cast("decimal(12,2)")), F.lit(0)), 2).alias(name))
    return union([result(_beside(total(src[s], c, "a"), total(star[t], c, "b")), "BUSINESS_TOTAL", name, f"{c} adds up to the source", F.col("a"), F.col("b")) for name, s, t, c in TOTALS])


def mandatory_keys(star: Tables) -> DataFrame:
    return union([result(star[t].agg(F.count_if(F.col(k).isNull()).alias("b")), "KEY_COMPLETENESS", f"{t} {k} NULL", "the key is mandatory", F.lit(0), F.col("b")) for t, k in MANDATORY])


def date_dimension(star: Tables) -> DataFrame:
    return union([result(_repeats(star["dim_date"], (k,)), "DATE_DIMENSION", f"dim_date duplicate {k}", "one row for each", F.lit(0), F.col("b")) for k in DATE_KEYS])


def validate_model(src: Tables, star: Tables) -> DataFrame:
    """All checks of the model."""
    return union([row_counts(src, star), fact_grain(star), surrogate_keys(star), foreign_keys(star), business_keys(src, star), business_totals(src, star), mandatory_keys(star), date_dimension(star)])


def summary(results: DataFrame, by: str = "validation_area") -> DataFrame:
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("total_checks"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"))


def in_order(results: DataFrame) -> DataFrame:
    return results.orderBy("validation_area", "check_name")


def verdict(results: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("status") == "FAIL")
    return results.agg(F.count(F.lit(1)).alias("total_checks"), bad.alias("failed_checks"), F.when(bad == 0, "PASS").otherwise("FAIL").alias("overall_status"))


def require_pass(results: DataFrame) -> None:
    r = verdict(results).first()
    if r.failed_checks:
        raise ValueError(f"{r.failed_checks} of {r.total_checks} checks failed")


# ---------------------------------------------------------------- after cleaning


def check(one: DataFrame, category: str, dataset: str, rule: str, expected: Column, actual: Column, severity: str = "HIGH") -> DataFrame:
    """(category, dataset, rule, expected, actual, failed_count, severity, status): passes if both are equal, nulls
    included."""
    same = expected.eqNullSafe(actual)
    return one.select(
        F.lit(category).alias("category"), F.lit(dataset).alias("dataset"), F.lit(rule).alias("rule"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"),
        F.when(same, 0).otherwise(F.coalesce(F.abs(actual.cast("long") - expected.cast("long")), F.lit(1))).cast("long").alias("failed_count"), F.when(same, "NONE").otherwise(severity).alias("severity"), F.when(same, "PASS").otherwise("FAIL").alias("status"),
    )


def tables_exist(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Looks for each cleaned table where it should lie: a folder that holds a readable schema and its rows."""
    seen = probe(spark, paths)
    return union([check(seen.filter(F.col("dataset") == n), "Existence", n, "the cleaned table exists", F.lit(1), F.col("is_present").cast("int"), "CRITICAL") for n in paths])


def expected_rows(clean: Tables, expected: dict[str, Column | int], raw: Tables | None = None) -> DataFrame:
    """Row counts against given numbers, or (by default) those of the raw tables."""
    parts = []
    for n, df in clean.items():
        one = df.agg(F.count(F.lit(1)).alias("b"))
        if n in expected:
            parts.append(check(one, "Row Count", n, "rows as expected", F.lit(expected[n]).cast("long"), F.col("b")))
        elif raw is not None:
            parts.append(check(_beside(one, raw[n].agg(F.count(F.lit(1)).alias("a"))), "Row Count", n, "rows as expected", F.col("a"), F.col("b")))
    return union(parts)


def summary_matches(actual: DataFrame, expected: DataFrame, key: str = "dataset") -> DataFrame:
    """Outer join of two summaries: columns that differ, nulls compared as values."""
    values = [c for c in expected.columns if c != key]
    both = actual.select(key, *(F.col(c).alias(f"a_{c}") for c in values)).join(expected.select(key, *(F.col(c).alias(f"e_{c}") for c in values)), key, "full_outer")
    differs = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"e_{c}")), F.lit(c)) for c in values]
    listed = F.concat_ws(", ", *differs)
    return both.select(F.lit("Cleaning Summary").alias("category"), key, listed.alias("differences"), F.when(listed == "", "PASS").otherwise("FAIL").alias("status"))


def repeated_keys(clean: Tables, keys: dict[str, tuple[str, ...]], category: str) -> DataFrame:
    return union([check(_repeats(clean[n], k), category, n, f"unique {', '.join(k)}", F.lit(0).cast("long"), F.col("b"), "CRITICAL") for n, k in keys.items()])


def none_where(clean: Tables, conditions: dict[str, dict[str, str]], category: str) -> DataFrame:
    """No row of a table meets a condition; all conditions of a table in one aggregate."""
    parts = []
    for n, named in conditions.items():
        one = clean[n].agg(*(F.count_if(F.expr(c)).alias(f"c{k}") for k, c in enumerate(named.values())))
        parts += [check(one, category, n, name, F.lit(0).cast("long"), F.col(f"c{k}")) for k, name in enumerate(named)]
    return union(parts)


def orphans(clean: Tables, edges: tuple) -> DataFrame:
    """Rows without a parent; null keys count."""
    parts = []
    for e in edges:
        one = rows_of(unmatched_counts(clean[e.child], e.column, clean[e.parent], e.parent_column, True), "b")
        parts.append(check(one, "Referential Integrity", e.child, f"{e.column} found in {e.parent}", F.lit(0).cast("long"), F.col("b"), e.severity))
    return union(parts)


def preserved(raw: Tables, clean: Tables, conditions: dict[str, dict[str, str]], category: str) -> DataFrame:
    """As many rows meet a condition after cleaning as before."""
    parts = []
    for n, named in conditions.items():
        a = raw[n].agg(*(F.count_if(F.expr(c)).alias(f"a{k}") for k, c in enumerate(named.values())))
        b = clean[n].agg(*(F.count_if(F.expr(c)).alias(f"b{k}") for k, c in enumerate(named.values())))
        parts += [check(_beside(a, b), category, n, name, F.col(f"a{k}"), F.col(f"b{k}"), "MEDIUM") for k, name in enumerate(named)]
    return union(parts)


def lookup_gap(clean: Tables, edge, expected: int) -> DataFrame:
    one = rows_of(unmatched_counts(clean[edge.child], edge.column, clean[edge.parent], edge.parent_column), "b")
    return check(one, "Lookup Coverage", edge.child, f"rows without {edge.parent} as expected", F.lit(expected).cast("long"), F.col("b"), "LOW")


def no_repeated_rows(clean: Tables, names: list[str]) -> DataFrame:
    return union([check(_repeats(clean[n], tuple(clean[n].columns)), "Duplicate Removal", n, "no repeated rows", F.lit(0).cast("long"), F.col("b")) for n in names])


def not_a_key(clean: Tables, specs: dict, dataset: str, column: str) -> DataFrame:
    """A policy on declarations, held against the table: an id that repeats must not be declared a key. ``actual`` is how
    many of its values repeat if it is declared one, and 0 otherwise."""
    declared = int(specs[dataset].key == (column,))
    repeats = _repeats(clean[dataset].select(column).filter(F.col(column).isNotNull()).withColumn("__row", F.lit(0)), (column,))
    return check(repeats, "Key Policy", dataset, f"{column} is no declared key, or never repeats", F.lit(0).cast("long"), F.col("b") * declared, "CRITICAL")
