"""Audited cleaning: nothing is invented, rows go only where they repeat another one wholly, and every rule leaves an
audit row. Cleaners are lazy; the counts of a dataset's audit come from one aggregate, duplicates and lookups apart."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import columns as C
from tallymart.operators.checks import rows_of, unmatched_counts
from tallymart.operators.digests import repeat_figures
from tallymart.operators.preprocess import missing
from tallymart.specs import DatasetSpec, Edge

# Action codes of the audit log.
SET_NULL_TIME, SET_NULL_VALUE = "SET_INVALID_TIMESTAMP_TO_NULL", "SET_INVALID_VALUE_TO_NULL"
DEDUPLICATE, RETAIN, RETAIN_NULL, RETAIN_GAP = "DEDUPLICATE", "RETAIN", "RETAIN_NULL", "RETAIN_SOURCE_LIMITATION"

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Action:
    """An audit rule; ``counts`` is the SQL of the rows it concerns, on the table before the action."""

    dataset: str
    column: str
    issue: str
    rule: str
    action: str
    counts: str
    rationale: str = ""
    status: str = "APPLIED"
    only_if_found: bool = False


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def nullify_before(df: DataFrame, column: str, anchor: str) -> DataFrame:
    """Null where a timestamp lies before its anchor; comparisons with null change nothing."""
    return df.withColumn(column, F.when(F.col(column) < F.col(anchor), F.lit(None)).otherwise(F.col(column)))


def nullify_chain(df: DataFrame, chain: list[tuple[str, str]], mode: str = "chained") -> DataFrame:
    """Pairs (column, anchor) in order. ``chained``: anchors as already cleaned; ``independent``: as they came."""
    if mode == "chained":
        return reduce(lambda d, p: nullify_before(d, *p), chain, df)
    return df.withColumns({c: F.when(F.col(c) < F.col(a), F.lit(None)).otherwise(F.col(c)) for c, a in chain})


def nullify_value(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(value)))


def retain_zero(dataset: str, column: str) -> Action:
    return Action(dataset, column, "zero value", "zero is kept", RETAIN, f"{column} = 0", "zero may be meant")


def retain_null(dataset: str, column: str, only_if_found: bool = False) -> Action:
    return Action(dataset, column, "missing value", "missing stays missing", RETAIN_NULL, f"{column} IS NULL", "no value is invented", only_if_found=only_if_found)


def retain_null_where(dataset: str, column: str, condition: str, issue: str) -> Action:
    return Action(dataset, column, issue, "missing stays missing", RETAIN_NULL, f"({condition}) AND {column} IS NULL", "no value is invented")


def nullified_before(dataset: str, column: str, anchor: str) -> Action:
    return Action(dataset, column, f"earlier than {anchor}", f"{column} not before {anchor}", SET_NULL_TIME, f"{column} < {anchor}", "an impossible time is no time")


def nullified_value(dataset: str, column: str, value: object) -> Action:
    return Action(dataset, column, f"value {value}", f"{column} is not {value}", SET_NULL_VALUE, f"{column} = {value!r}", "not a valid value")


def audit(df: DataFrame, actions: list[Action], after: DataFrame | None = None) -> DataFrame:
    """Audit rows (dataset, column, issue, rule, action, rows_affected, rows_before, rows_after, rationale, status).

    All actions are counted by one aggregate over the table; ``after`` tells the rows that are left.
    """
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(a.counts)).alias(f"a{k}") for k, a in enumerate(actions)))
    left = F.col("n")
    if after is not None:
        one = one.crossJoin(F.broadcast(after.agg(F.count(F.lit(1)).alias("left_over"))))
        left = F.col("left_over")
    rows = [
        F.struct(F.lit(a.dataset).alias("dataset"), F.lit(a.column).alias("column"), F.lit(a.issue).alias("issue"), F.lit(a.rule).alias("rule"), F.lit(a.action).alias("action"), F.col(f"a{k}").alias("rows_affected"), F.col("n").alias("rows_before"), left.alias("rows_after"), F.lit(a.rationale).alias("rationale"), F.lit(a.status).alias("status"), F.lit(a.only_if_found).alias("only"))
        for k, a in enumerate(actions)
    ]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.filter(~F.col("only") | (F.col("rows_affected") > 0)).drop("only")


def _entry(counted: DataFrame, dataset: str, column: str, issue: str, rule: str, action: str, rationale: str, status: str = "APPLIED") -> DataFrame:
    """An audit row from a one-row frame (affected, before, after)."""
    return counted.select(
        F.lit(dataset).alias("dataset"), F.lit(column).alias("column"), F.lit(issue).alias("issue"), F.lit(rule).alias("rule"), F.lit(action).alias("action"), F.col("affected").cast("long").alias("rows_affected"),
        F.col("before").cast("long").alias("rows_before"), F.col("after").cast("long").alias("rows_after"), F.lit(rationale).alias("rationale"), F.lit(status).alias("status"),
    )


def audit_duplicates(df: DataFrame, dataset: str) -> DataFrame:
    counted = repeat_figures(df).select(F.col("excess_rows").alias("affected"), F.col("total_rows").alias("before"), F.col("distinct_rows").alias("after"))
    return _entry(counted, dataset, "__FULL_ROW__", "repeated rows", "one of equal rows is kept", DEDUPLICATE, "equal rows say nothing new")


def audit_repeated_id(df: DataFrame, dataset: str, column: str) -> DataFrame:
    """How many values of an id that is no key occur more than once; they are kept."""
    n = F.col("n")
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if((n > 1) & F.col(column).isNotNull()).alias("affected"), F.coalesce(F.sum(n), F.lit(0)).alias("before")).withColumn("after", F.col("before"))
    return _entry(counted, dataset, column, "repeated id", "the id is no key", RETAIN, "rows of one id differ")


def audit_unmatched(tables: Tables, e: Edge, status: str = "APPLIED") -> DataFrame:
    child = tables[e.child]
    counted = rows_of(unmatched_counts(child, e.column, tables[e.parent], e.parent_column), "affected")
    counted = counted.crossJoin(F.broadcast(child.agg(F.count(F.lit(1)).alias("before")))).withColumn("after", F.col("before"))
    return _entry(counted, e.child, e.column, f"not in {e.parent}", "the row is kept", RETAIN_GAP if status == "DOCUMENTED" else RETAIN, "the lookup has gaps", status)


class RowCountChanged(ValueError):
    pass


def same_row_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rows_before, rows_after, unchanged)."""
    counts = before.agg(F.count(F.lit(1)).alias("rows_before")).crossJoin(F.broadcast(after.agg(F.count(F.lit(1)).alias("rows_after"))))
    return counts.withColumn("unchanged", F.col("rows_before") == F.col("rows_after"))


def require_same_row_count(before: DataFrame, after: DataFrame) -> None:
    r = same_row_count(before, after).first()
    if not r.unchanged:
        raise RowCountChanged(f"{r.rows_before} rows became {r.rows_after}")


# ---------------------------------------------------------------- the retail cleaners


def clean_customers(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    df = t["customers"]
    done = df.withColumns({c: C.code(F.col(c)) for c in ("customer_city", "customer_state")})
    return done, [audit_unmatched(t, e) for e in t["__lookups"] if e.child == "customers"]


def clean_geolocation(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    df = t["geolocation"]
    done = df.withColumns({c: C.code(F.col(c)) for c in ("geolocation_city", "geolocation_state")})
    return drop_duplicate_rows(done), [audit_duplicates(done, "geolocation")]


ORDER_CHAIN = [("order_delivered_carrier_date", "order_purchase_timestamp"), ("order_delivered_customer_date", "order_delivered_carrier_date")]


def clean_orders(t: Tables, mode: str = "chained") -> tuple[DataFrame, list[DataFrame]]:
    df = t["orders"]
    first = nullify_chain(df, ORDER_CHAIN[:1])
    done = nullify_chain(df, ORDER_CHAIN, mode)
    late = first if mode == "chained" else df
    delivered = "order_status = 'delivered'"
    return done, [
        audit(df, [nullified_before("orders", *ORDER_CHAIN[0])]),
        audit(late, [nullified_before("orders", *ORDER_CHAIN[1])]),
        audit(done, [retain_null_where("orders", c, delivered, "delivered without a date") for c in ("order_delivered_carrier_date", "order_delivered_customer_date")]),
    ]


def clean_items(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    df = t["order_items"]
    return df, [audit(df, [retain_zero("order_items", "freight_value")])]


def clean_payments(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    df = t["payments"]
    done = nullify_value(df, "payment_installments", 0)
    return done, [audit(df, [nullified_value("payments", "payment_installments", 0), retain_zero("payments", "payment_value")])]


def clean_reviews(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    df = t["reviews"]
    done = drop_duplicate_rows(df)
    return done, [audit_repeated_id(df, "reviews", "review_id"), audit_duplicates(df, "reviews"), audit(done, [retain_null("reviews", c) for c in ("review_comment_title", "review_comment_message")])]


def clean_products(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    df = t["products"]
    done = df.withColumn("product_category_name", C.blank_to_null(F.col("product_category_name")))
    numbers = [c for c in df.columns if c not in ("product_id", "product_category_name")]
    return done, [audit(done, [retain_null("products", "product_category_name"), *(retain_null("products", c, True) for c in numbers), retain_zero("products", "product_weight_g")])]


def clean_sellers(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    df = t["sellers"]
    done = df.withColumns({c: C.code(F.col(c)) for c in ("seller_city", "seller_state")})
    return done, [audit_unmatched(t, e) for e in t["__lookups"] if e.child == "sellers"]


def clean_translation(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    df = t["category_translation"]
    done = drop_duplicate_rows(df.withColumns({c: C.blank_to_null(F.col(c)) for c in df.columns}))
    return done, [audit_unmatched(t, e, "DOCUMENTED") for e in t["__lookups"] if e.child == "products"]


CLEANERS = {
    "customers": clean_customers, "geolocation": clean_geolocation, "orders": clean_orders, "order_items": clean_items, "payments": clean_payments,
    "reviews": clean_reviews, "products": clean_products, "sellers": clean_sellers, "category_translation": clean_translation,
}


def clean_all(tables: Tables, lookups: tuple[Edge, ...], cleaners: dict = CLEANERS) -> tuple[Tables, DataFrame]:
    """Cleaned tables and the audit of all of them; nothing runs before an action."""
    given = {**tables, "__lookups": lookups}
    cleaned, log = {}, []
    for name, cleaner in cleaners.items():
        if name in tables:
            cleaned[name], entries = cleaner(given)
            log += entries
    return cleaned, reduce(DataFrame.unionByName, log)


# ---------------------------------------------------------------- summaries and gates


def null_cells(df: DataFrame) -> Column:
    """Sum over columns, as one aggregate."""
    return sum((F.count_if(missing(df, c)) for c in df.columns), F.lit(0))


def table_figures(df: DataFrame, suffix: str) -> DataFrame:
    cells = df.agg(null_cells(df).cast("long").alias(f"null_cells_{suffix}"), F.count(F.lit(1)).alias(f"rows_{suffix}"))
    repeats = repeat_figures(df).select(F.col("excess_rows").alias(f"exact_duplicates_{suffix}"))
    return cells.crossJoin(F.broadcast(repeats)).withColumn(f"columns_{suffix}", F.lit(len(df.columns)).cast("long"))


def clean_summary(before: Tables, after: Tables) -> DataFrame:
    """Rows, columns, null cells and repeated rows of each dataset before and after."""
    parts = []
    for name in after:
        both = table_figures(before[name], "before").crossJoin(F.broadcast(table_figures(after[name], "after")))
        parts.append(both.select(F.lit(name).alias("dataset"), "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"), "columns_before", "columns_after", "null_cells_before", "null_cells_after", "exact_duplicates_before", "exact_duplicates_after"))
    return reduce(DataFrame.unionByName, parts).orderBy("dataset")


def clean_totals(summary: DataFrame, log: DataFrame) -> DataFrame:
    """One row over all datasets and actions."""
    sums = summary.agg(F.count(F.lit(1)).alias("datasets"), F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after"), F.sum("rows_removed").alias("rows_removed"))
    return sums.crossJoin(F.broadcast(log.agg(F.count(F.lit(1)).alias("actions"), F.count_if(F.col("status") == "APPLIED").alias("actions_applied"))))


def edge_report(tables: Tables, edges: tuple[Edge, ...], count_null_keys: bool = False) -> DataFrame:
    """(child, column, parent, orphans) for each edge."""
    parts = [rows_of(unmatched_counts(tables[e.child], e.column, tables[e.parent], e.parent_column, count_null_keys), "orphans").select(F.lit(e.child).alias("child"), F.lit(e.column).alias("column"), F.lit(e.parent).alias("parent"), "orphans") for e in edges]
    return reduce(DataFrame.unionByName, parts)


def key_report(tables: Tables, specs: dict[str, DatasetSpec]) -> DataFrame:
    """(dataset, key, missing_columns, null_keys, duplicate_groups) for each declared key."""
    parts = []
    for name, s in specs.items():
        if not s.key or name not in tables:
            continue
        df, absent = tables[name], [k for k in s.key if k not in tables[name].columns]
        label = (F.lit(name).alias("dataset"), F.lit(", ".join(s.key)).alias("key_name"), F.lit(", ".join(absent)).alias("missing_columns"))
        if absent:
            parts.append(df.sparkSession.range(1).select(*label, F.lit(0).cast("long").alias("null_keys"), F.lit(0).cast("long").alias("duplicate_groups")))
            continue
        any_null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in s.key))
        sums = df.groupBy(*s.key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).alias("null_keys"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
        parts.append(sums.select(*label, "null_keys", "duplicate_groups"))
    return reduce(DataFrame.unionByName, parts)


def require_edges(tables: Tables, edges: tuple[Edge, ...]) -> None:
    """Raises on orphans; all edges are counted by one query."""
    bad = edge_report(tables, edges).filter("orphans > 0").collect()
    if bad:
        raise ValueError("orphans: " + ", ".join(f"{r.child}.{r.column} -> {r.parent}: {r.orphans}" for r in bad))


def require_keys(tables: Tables, specs: dict[str, DatasetSpec]) -> None:
    bad = key_report(tables, specs).filter("missing_columns <> '' OR null_keys > 0 OR duplicate_groups > 0").collect()
    if bad:
        raise ValueError("keys: " + ", ".join(f"{r.dataset} ({r.key_name})" for r in bad))
