"""Queries of the checks: families, the rulebook, summaries; sources and loads."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators import checks
from tallymart.plans.registry import add, measured_sql, results_sql, text, with_rows
from tallymart.plans.roles import BASE, SPECS, role, roles
from tallymart.plans import rulebook_sql
from tallymart.plans.rulebook import rulebook
from tallymart.sources import files, tables
from tallymart.sources.keyed import KeyedTable
from tallymart.sources.quarantine import Ingested, ingest_csv
from tallymart.specs import EDGES, LOOKUPS, DatasetSpec

FAMILIES = {
    "dq_schema": partial(checks.schema_conformity, SPECS), "dq_missing": partial(checks.missing_values, SPECS), "dq_key_nulls": partial(checks.key_nulls, SPECS), "dq_key_unique": partial(checks.key_uniqueness, SPECS), "dq_duplicate_rows": partial(checks.row_duplicates, SPECS),
    "dq_types": partial(checks.type_conformity, SPECS), "dq_domains": partial(checks.domains, SPECS), "dq_zero": partial(checks.zero_values, SPECS), "dq_negative": partial(checks.negative_values, SPECS), "dq_dates": partial(checks.date_parseability, SPECS), "dq_chronology": partial(checks.chronology, SPECS),
    "dq_references": partial(checks.referential_integrity, EDGES), "dq_lookups": partial(checks.lookup_coverage, LOOKUPS), "dq_plausibility": partial(checks.plausibility, SPECS),
}


class _Shape:
    """The columns and types of a role, for SQL that is written without a session."""

    def __init__(self, columns: dict[str, str]):
        from pyspark.sql import types as T

        kinds = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "decimal": T.DecimalType(12, 2), "timestamp": T.TimestampNTZType()}
        self.columns = list(columns)
        self.schema = {c: T.StructField(c, kinds[k]) for c, k in columns.items()}


def _shapes() -> dict[str, _Shape]:
    """Roles as roles.SQL makes them: identifiers are numbers there, and money is decimal."""
    out = {}
    for name, spec in SPECS.items():
        kinds = {}
        for c, kind in spec.columns.items():
            kinds[c] = {"integer": "bigint", "datetime": "timestamp", "numeric": "decimal" if name in ("order_items", "payments") else "double"}.get(kind, "bigint" if c.endswith("_id") else "string")
        out[name] = _Shape(kinds)
    return out


SHAPES = _shapes()


def run(rules_of, spark: SparkSession, sf_dir: str, keep_severity: bool = False) -> DataFrame:
    found = roles(spark, sf_dir)
    return checks.run_rules(spark, found, rules_of(found), keep_severity)


def staged_run(rules_of, spark: SparkSession, sf_dir: str, keep_severity: bool = False) -> DataFrame:
    """Results over roles that are written first, as many rules read each of them, and deleted afterwards."""
    staged = tables.stage(roles(spark, sf_dir))
    try:
        return tables.settle(checks.run_rules(spark, staged, rules_of(staged), keep_severity))
    finally:
        tables.discard(spark, staged)


for _name, _rules in FAMILIES.items():
    if _name == "dq_schema":
        add(_name, lambda s, d, r=_rules: tables.beside_rows(run(r, s, d), roles(s, d)), with_rows(results_sql(_rules(SHAPES)), SPECS))
    else:
        add(_name, partial(run, _rules), results_sql(_rules(SHAPES)))


def everything(found: dict) -> list[checks.Rule]:
    return [r for family in FAMILIES.values() for r in family(found)]


#: The results of the last assessment of this session, by what it has read.
_ASSESSED: dict[tuple, DataFrame] = {}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results. They are worked out once for the same files (name, size and time of change), and the roles that were
    staged for it are deleted."""
    seen = (spark.sparkContext.applicationId, *(tuple(files.stamps(spark, f"{sf_dir}/{t}.parquet")) for t in BASE))
    if seen not in _ASSESSED:
        _ASSESSED.clear()
        _ASSESSED[seen] = staged_run(everything, spark, sf_dir)
    return _ASSESSED[seen]


ALL = results_sql(everything(SHAPES))
add("dq_results", results, ALL)


#: The given table that each dataset is made from, and one that is not there.
SOURCE = {"customers": "customer", "geolocation": "region", "orders": "orders", "order_items": "lineitem", "payments": "orders", "reviews": "events", "products": "part", "sellers": "supplier", "category_translation": "part", "returns": "returns"}


def existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_rules(spark, {}, checks.existence(spark, {n: f"{sf_dir}/{t}.parquet" for n, t in SOURCE.items()}))


_absent = "(SELECT count(*) FROM information_schema.tables WHERE table_name = '{}') = 0"
add("dq_existence", existence, "\nUNION ALL ".join(f"SELECT 'DQ-EXIST-{n}' AS test_id, '{n}' AS dataset, '{checks.WHOLE}' AS \"column\", 'Completeness' AS quality_dimension, 'dataset is available' AS rule, '0 failing rows' AS expected, CASE WHEN {_absent.format(t)} THEN 'missing' ELSE 'found' END AS actual, CAST({_absent.format(t)} AS BIGINT) AS failed_count, CASE WHEN {_absent.format(t)} THEN 100.0E0 ELSE 0.0E0 END AS failure_rate, CASE WHEN {_absent.format(t)} THEN 'CRITICAL' ELSE 'NONE' END AS severity, CASE WHEN {_absent.format(t)} THEN 'FAIL' ELSE 'PASS' END AS status" for n, t in SOURCE.items()))
add("dq_sql_rules", lambda s, d: staged_run(lambda _: rulebook(SPECS), s, d, True), rulebook_sql.SQL)
add("dq_categorical_examples", lambda s, d: checks.categorical_examples(roles(s, d), SPECS), "\nUNION ALL ".join(
    f"SELECT '{n}' AS dataset, '{c}' AS \"column\", count(*) AS failed_count, (SELECT coalesce(string_agg(v, ', ' ORDER BY v), '') FROM (SELECT DISTINCT {c} AS v FROM r_{n} WHERE {c} IS NOT NULL AND {c} NOT IN ({checks.sql_list(dom)}) ORDER BY v LIMIT 10) AS x) AS examples FROM r_{n} WHERE {c} IS NOT NULL AND {c} NOT IN ({checks.sql_list(dom)})"
    for n, sp in SPECS.items() for c, dom in sp.domains.items()))

TALLY = "count(*) AS total_tests, count(*) FILTER (WHERE status <> 'FAIL') AS passed_tests, count(*) FILTER (WHERE status = 'FAIL') AS failed_tests, " + ", ".join(f"count(*) FILTER (WHERE status = 'FAIL' AND severity = '{s}') AS {s.lower()}_issues" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
OVERALL = "CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status"
RANK = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END AS severity_rank"
#: Rules with severities that no catalogue knows; whoever fails them must be found by the sanity check, whoever passes not.
ODD = [
    checks.RowRule("ODD-1", "orders", "customer_id", "Completeness", "not null", "URGENT", "customer_id IS NULL"),
    checks.RowRule("ODD-2", "orders", "order_id", "Completeness", "not null", "URGENT", "order_id IS NULL"),
    checks.RowRule("ODD-3", "payments", "payment_value", "Validity", "not zero", "minor", "payment_value = 0"),
]
add("dq_sanity", lambda s, d: checks.check_classification(run(lambda _: ODD, s, d).unionByName(results(s, d))), f"SELECT * FROM ({results_sql(ODD)} UNION ALL SELECT * FROM ({ALL}) AS every_) AS r WHERE status NOT IN ('PASS', 'FAIL') OR severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NONE')")
add("dq_by_dataset", lambda s, d: checks.by_dataset(results(s, d)), f"SELECT dataset, {TALLY}, {OVERALL} FROM ({ALL}) AS r GROUP BY dataset")
add("dq_by_dimension", lambda s, d: checks.by_dimension(results(s, d)), f"SELECT quality_dimension, {TALLY} FROM ({ALL}) AS r GROUP BY quality_dimension")
add("dq_totals", lambda s, d: checks.totals(results(s, d)), f"SELECT {TALLY}, {OVERALL} FROM ({ALL}) AS r")
add("dq_ranked", lambda s, d: checks.ranked(results(s, d)), f"SELECT *, {RANK} FROM ({ALL}) AS r")
add("dq_failed", lambda s, d: checks.failed(results(s, d)), f"SELECT *, {RANK} FROM ({ALL}) AS r WHERE status = 'FAIL'")
add("dq_priority", lambda s, d: checks.priority(results(s, d)), f"SELECT * FROM ({ALL}) AS r WHERE status = 'FAIL' AND severity IN ('CRITICAL', 'HIGH')")

# ---------------------------------------------------------------- sources, inventories, loads


def _counts(named: dict[str, int], present: bool) -> str:
    flag = ", true AS is_present" if present else ""
    return "\nUNION ALL ".join(f"SELECT '{n}' AS dataset{flag}, count(*) AS total_rows, CAST({k} AS BIGINT) AS total_columns FROM r_{n}" for n, k in named.items())


WIDTHS = {n: len(s.columns) for n, s in SPECS.items()}
add("overview_inventory", lambda s, d: tables.inventory(s, [*SPECS, "returns"], roles(s, d)), _counts(WIDTHS, True) + "\nUNION ALL SELECT 'returns', false, 0, 0")
add("overview", lambda s, d: tables.overview(roles(s, d)), _counts(WIDTHS, False))
add("column_counts", lambda s, d: tables.column_counts(roles(s, d)), "\nUNION ALL ".join(f"SELECT '{n}' AS dataset, CAST({k} AS BIGINT) AS total_columns, {' + '.join(f'CAST(count({c}) > 0 AS BIGINT)' for c in SHAPES[n].columns)} AS filled_columns FROM r_{n}" for n, k in WIDTHS.items()))


def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files that are there and one that is not; the row counts of those that are stand beside the checks."""
    paths = {n: f"{sf_dir}/{n}.parquet" for n in ("customer", "supplier", "no_such_table")}
    found, reasons = tables.load_all(spark, paths)
    rules = [checks.FixedRule(f"DQ-LOAD-{n}", n, checks.WHOLE, "Completeness", "dataset can be read", "CRITICAL", int(n in reasons), reasons.get(n, "read")) for n in paths]
    shown = checks.run_rules(spark, {}, rules).select("test_id", "dataset", "status", "severity", "actual")
    return shown.join(tables.overview(found).select("dataset", "total_rows"), "dataset", "left")


add("missing_source_results", missing_sources, "SELECT 'DQ-LOAD-customer' AS test_id, 'customer' AS dataset, 'PASS' AS status, 'NONE' AS severity, 'read' AS actual, count(*) AS total_rows FROM customer UNION ALL SELECT 'DQ-LOAD-supplier', 'supplier', 'PASS', 'NONE', 'read', count(*) FROM supplier UNION ALL SELECT 'DQ-LOAD-no_such_table', 'no_such_table', 'FAIL', 'CRITICAL', 'PATH_NOT_FOUND', NULL")


#: CSV records of the events, made by SQL that both engines read: quoted line breaks, fields that are missing or too many,
#: fields that do not parse, and null tokens.
CSV_SPEC = DatasetSpec("event_files", {"event_id": "integer", "label": "string", "amount": "integer", "seen_at": "datetime"})
CSV = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN concat(event_id, ',"too short"') WHEN event_id % 13 = 0 THEN concat(event_id, ',"a', chr(10), 'b",3,2018-01-05 00:00:00,more')
    ELSE concat(event_id, ',"say ""', event_type, '""', chr(10), 'twice",', CASE event_id % 5 WHEN 0 THEN '3.0' WHEN 1 THEN '3.7' WHEN 2 THEN 'abc' WHEN 3 THEN 'NA' ELSE CAST(user_id AS {text}) END, ',', CASE event_id % 4 WHEN 0 THEN '2017-10-02 10:56:33' WHEN 1 THEN '2017-13-01' WHEN 2 THEN 'none' ELSE '2018-01-05 00:00:00' END) END AS line FROM {events}"""


def ingested(spark: SparkSession, sf_dir: str, use) -> DataFrame:
    """What ``use`` makes of the events, written as CSV files and read again with a quarantine."""
    base = f"{tables.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    try:
        spark.sql(CSV.format(text="STRING", events="{events}"), events=role(spark, sf_dir, "events")).select("line").write.text(f"{base}/files")
        return tables.settle(use(ingest_csv(spark, f"{base}/files", CSV_SPEC, f"{base}/tables", header=False)))
    finally:
        files.delete(spark, base)


def every_record(got: Ingested) -> DataFrame:
    kept = got.kept.select("event_id", F.lit("kept").alias("outcome"), F.lit("").alias("reasons"), F.length("label").cast("bigint").alias("label_length"), "amount", F.col("seen_at").isNotNull().alias("has_time"))
    first = F.regexp_extract("record", "^(\\d+)", 1).cast("bigint")
    out = got.rejected.select(first.alias("event_id"), F.lit("rejected").alias("outcome"), F.array_join("reasons", "; ").alias("reasons"), F.lit(None).cast("bigint").alias("label_length"), F.lit(None).cast("bigint").alias("amount"), F.lit(False).alias("has_time"))
    return kept.unionByName(out)


_fields = "event_id % 11 = 0 OR event_id % 13 = 0"
_why = f"CASE WHEN {_fields} THEN 'wrong number of fields' ELSE concat_ws('; ', CASE WHEN event_id % 5 IN (1, 2) THEN 'amount: not a whole number' END, CASE WHEN event_id % 4 = 1 THEN 'seen_at: not a timestamp' END) END"
_records = f"(SELECT *, {_why} AS why FROM events) AS e"
add("csv_quarantine", lambda s, d: ingested(s, d, every_record), f"SELECT event_id, CASE WHEN why = '' THEN 'kept' ELSE 'rejected' END AS outcome, why AS reasons, CASE WHEN why = '' THEN length(event_type) + 12 END AS label_length, CASE WHEN why = '' THEN CASE event_id % 5 WHEN 0 THEN 3 WHEN 3 THEN NULL ELSE user_id END END AS amount, why = '' AND event_id % 4 <> 2 AS has_time FROM {_records}")
add("csv_load_check", lambda s, d: ingested(s, d, lambda got: checks.finish(got.check())), f"SELECT 'DQ-LOAD-event_files' AS test_id, 'event_files' AS dataset, '__DATASET__' AS \"column\", 'Validity' AS quality_dimension, 'every record can be read' AS rule, '0 failing rows' AS expected, count(*) FILTER (WHERE why <> '') || ' failing' AS actual, count(*) FILTER (WHERE why <> '') AS failed_count, round(count(*) FILTER (WHERE why <> '') * 100.0E0 / count(*), 4) AS failure_rate, CASE WHEN count(*) FILTER (WHERE why <> '') = 0 THEN 'NONE' ELSE 'HIGH' END AS severity, CASE WHEN count(*) FILTER (WHERE why <> '') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {_records}")


def merged_customers(spark: SparkSession, sf_dir: str, insert_only: bool) -> DataFrame:
    """All customers in a stored keyed table. Even ids are there first; odd ids and multiples of three come in, each
    twice, with an old and a new city; then the same comes in again. Keys of what was there stay."""
    path = f"{tables.shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    c = role(spark, sf_dir, "customers").select("customer_id", "customer_city")
    stored = KeyedTable.create(spark, path, ["customer_id"], "customer_key", buckets=16)
    stored.merge(c.filter("customer_id % 2 = 0"))
    before, last = stored.read().select("customer_id", F.col("customer_key").alias("old_key")), stored.state["largest"]
    some = c.filter("customer_id % 2 <> 0 OR customer_id % 3 = 0")
    versions = [some.withColumns({"customer_city": F.concat(F.coalesce("customer_city", F.lit("?")), F.lit(f" {v}")), "seen": F.lit(k)}) for k, v in enumerate(("old", "new"))]
    incoming = versions[1].unionByName(versions[0])
    first = stored.merge(incoming, newest=["seen"], insert_only=insert_only)
    again = stored.merge(incoming, newest=["seen"], insert_only=insert_only)
    both = stored.read().join(before, "customer_id", "left")
    out = both.select("customer_id", "customer_city", (F.col("customer_key") == F.col("old_key")).alias("key_kept"), (F.col("customer_key") > last).alias("key_is_new"), F.lit(first.inserted).cast("long").alias("inserted"), F.lit(first.updated).cast("long").alias("updated"), F.lit(again.version - first.version).cast("long").alias("versions_of_rerun"))
    out = tables.settle(out)
    files.delete(spark, path)
    return out


_came = "customer_id % 2 <> 0 OR customer_id % 3 = 0"
_kept = "CASE WHEN customer_id % 2 = 0 THEN true END AS key_kept, customer_id % 2 <> 0 AS key_is_new, (SELECT count(*) FROM r_customers WHERE customer_id % 2 <> 0) AS inserted"
add("upsert_update", partial(merged_customers, insert_only=False), f"SELECT customer_id, CASE WHEN {_came} THEN coalesce(customer_city, '?') || ' new' ELSE customer_city END AS customer_city, {_kept}, (SELECT count(*) FROM r_customers WHERE customer_id % 6 = 0) AS updated, CAST(0 AS BIGINT) AS versions_of_rerun FROM r_customers")
add("insert_if_absent", partial(merged_customers, insert_only=True), f"SELECT customer_id, CASE WHEN customer_id % 2 <> 0 THEN coalesce(customer_city, '?') || ' new' ELSE customer_city END AS customer_city, {_kept}, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS versions_of_rerun FROM r_customers")


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load without a key, twice: the keys of both runs agree row by row."""
    r = role(spark, sf_dir, "reviews").select("review_id", "order_id", "review_score")
    one, two = tables.reload(r, "review_key"), tables.reload(r.repartition(3), "review_key")
    same = one.join(two, ["review_key", "review_id", "order_id", "review_score"])
    return same.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("review_key").alias("keys"), F.min("review_key").alias("first_key"), F.max("review_key").alias("last_key"))


add("idempotent_append", reloaded, "SELECT count(*) AS rows, count(*) AS keys, CAST(1 AS BIGINT) AS first_key, count(*) AS last_key FROM r_reviews")
def numbered(items: DataFrame) -> DataFrame:
    return tables.number_rows(items, ["order_id", "order_item_id"], "k", rows=items.count())


add("surrogate_keys", lambda s, d: numbered(role(s, d, "order_items")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("k").alias("keys"), F.min("k").alias("first_key"), F.max("k").alias("last_key")), "SELECT count(*) AS rows, count(*) AS keys, CAST(1 AS BIGINT) AS first_key, count(*) AS last_key FROM r_order_items")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks over orders and lines, summed up per dataset."""
    found = {"lines": role(spark, sf_dir, "lineitem").join(role(spark, sf_dir, "orders_base").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left"), "orders": role(spark, sf_dir, "orders_base")}
    return checks.by_dataset(checks.run_rules(spark, found, FLAGSHIP))


FLAGSHIP = [
    checks.KeyRule("KEY", "lines", "l_orderkey, l_linenumber", "Uniqueness", "unique line", "CRITICAL", ("l_orderkey", "l_linenumber")),
    checks.RowRule("ORPHAN", "lines", "l_orderkey", "Referential Integrity", "the order exists", "HIGH", "o_orderkey IS NULL"),
    checks.RowRule("TIME", "lines", "l_shipdate", "Consistency", "not shipped before the order", "MEDIUM", "l_shipdate < o_orderdate"),
    checks.EmptyRule("ROWS", "orders", checks.WHOLE, "Completeness", "the table has rows", "CRITICAL"),
]
add("flagship", flagship, f"WITH r_lines AS (SELECT * FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey), r_orders AS (SELECT * FROM orders) SELECT dataset, {TALLY}, {OVERALL} FROM ({results_sql(FLAGSHIP)}) AS r GROUP BY dataset".replace("r_orders", "q_orders"))
__all__ = ["flagship", "measured_sql"]
