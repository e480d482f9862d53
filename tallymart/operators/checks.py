"""Data-quality checks as data: rules are compiled into few Spark jobs.

All row rules of a table become one aggregate over one scan; every key set costs one grouping, every edge one anti
join. Results are typed frames that summaries read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.operators.digests import repeats
from tallymart.sources.tables import probe
from tallymart.specs import SEVERITIES, STATUSES, DatasetSpec, Edge

WHOLE = "__DATASET__"
Tables = dict[str, DataFrame]

RESULT = "test_id string, dataset string, `column` string, quality_dimension string, rule string, expected string, actual string, failed_count bigint, failure_rate double, severity string, status string"


@dataclass(frozen=True)
class Rule:
    test_id: str
    dataset: str
    column: str
    dimension: str
    rule: str
    severity: str

    expected = "0 failing rows"


@dataclass(frozen=True)
class RowRule(Rule):
    """``fails``: SQL that is true for a failing row; ``among``: SQL that picks the rows that count."""

    fails: str = "false"
    among: str = "true"


@dataclass(frozen=True)
class EmptyRule(Rule):
    """Fails if the table has no rows."""

    expected = "at least one row"


@dataclass(frozen=True)
class KeyRule(Rule):
    """Duplicates of a key: ``groups``, rows ``participating`` in them, or ``excess`` rows beyond the first."""

    keys: tuple[str, ...] = ()
    measure: str = "participating"

    expected = "unique"


@dataclass(frozen=True)
class EdgeRule(Rule):
    """Child rows without a parent. Null child keys are left out, or counted. ``distinct`` counts keys, not rows."""

    edge: Edge | None = None
    count_null_keys: bool = False
    distinct: bool = False

    expected = "every key found"


@dataclass(frozen=True)
class FixedRule(Rule):
    """A result known without reading rows: existence, columns, types."""

    failed: int = 0
    actual: str = ""


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _measured(rules: list[Rule], values: list[tuple[Column, Column]], totals: DataFrame, actual: str = "") -> DataFrame:
    """One row of aggregates unpivoted to (test_id … failed, total)."""
    rows = [
        F.struct(F.lit(r.test_id).alias("test_id"), F.lit(r.dataset).alias("dataset"), F.lit(r.column).alias("column"), F.lit(r.dimension).alias("quality_dimension"), F.lit(r.rule).alias("rule"), F.lit(r.expected).alias("expected"), F.lit(r.severity).alias("declared"), failed.cast("long").alias("failed"), total.cast("long").alias("total"))
        for r, (failed, total) in zip(rules, values)
    ]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _row_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All row rules of a table: one scan, one aggregate."""
    amounts = {"n": F.count(F.lit(1))}
    values = []
    for k, r in enumerate(rules):
        if isinstance(r, EmptyRule):
            values.append((F.when(F.col("n") == 0, 1).otherwise(0), F.lit(1)))
            continue
        among = F.expr(r.among)
        amounts[f"f{k}"] = F.count_if(among & F.coalesce(F.expr(r.fails), F.lit(False)))
        total = F.col("n")
        if r.among != "true":
            amounts[f"t{k}"] = F.count_if(among)
            total = F.col(f"t{k}")
        values.append((F.col(f"f{k}"), total))
    return _measured(rules, values, df.agg(*(c.alias(n) for n, c in amounts.items())))


def _key_rules(df: DataFrame, keys: tuple[str, ...], rules: list[KeyRule]) -> DataFrame:
    """All measures of a key set: one grouping; of whole rows by their digests."""
    n = F.col("n")
    counted = repeats(df) if set(keys) == set(df.columns) else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(n > 1).alias("groups"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("participating"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("excess"))
    return _measured(rules, [(F.col(r.measure), F.col("total")) for r in rules], sums)


def unmatched(child: DataFrame, column: str, parent: DataFrame, parent_column: str, count_null_keys: bool = False) -> DataFrame:
    """Child rows whose key has no parent."""
    rows = child if count_null_keys else child.filter(F.col(column).isNotNull())
    keys = parent.select(F.col(parent_column).alias("__parent_key"))
    return rows.join(keys, F.col(column) == F.col("__parent_key"), "left_anti")


def unmatched_counts(child: DataFrame, column: str, parent: DataFrame, parent_column: str, count_null_keys: bool = False) -> DataFrame:
    """(__key, n) of child keys without a parent. Rows are counted by key first, so a key of many rows, or none, is one
    row when it meets the parents."""
    keys = child.groupBy(F.col(column).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    return unmatched(keys, "__key", parent, parent_column, count_null_keys)


def rows_of(counted: DataFrame, name: str) -> DataFrame:
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))


def _edge_rule(tables: Tables, r: EdgeRule) -> DataFrame:
    e = r.edge
    keys = tables[e.child].groupBy(F.col(e.column).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    parent = tables[e.parent].select(F.col(e.parent_column).alias("__parent_key")).distinct()
    key, n = F.col("__key"), F.col("n")
    failing = F.col("__parent_key").isNull() & (F.lit(True) if r.count_null_keys else key.isNotNull())
    # Both sides are one row a key, so one left join gives orphans and all rows at once, whatever the heaviest key.
    joined = keys.join(parent, key == F.col("__parent_key"), "left")
    amount = F.count_if(failing & key.isNotNull()) if r.distinct else F.coalesce(F.sum(F.when(failing, n)), F.lit(0))
    return _measured([r], [(F.col("failed"), F.col("total"))], joined.agg(amount.alias("failed"), F.coalesce(F.sum(n), F.lit(0)).alias("total")))


def _fixed_rules(spark: SparkSession, rules: list[FixedRule]) -> DataFrame:
    rows = [(r.test_id, r.dataset, r.column, r.dimension, r.rule, r.expected, r.severity, r.failed, max(r.failed, 1), r.actual) for r in rules]
    return spark.createDataFrame(rows, "test_id string, dataset string, `column` string, quality_dimension string, rule string, expected string, declared string, failed bigint, total bigint, actual string")


def finish(measured: DataFrame, keep_severity: bool = False) -> DataFrame:
    """Status, rate (per cent, four digits, 0 of nothing) and severity, which a pass resets unless it is kept."""
    failed, total = F.col("failed"), F.col("total")
    passed = failed == 0
    actual = F.coalesce(F.col("actual"), F.concat(failed.cast("string"), F.lit(" failing"))) if "actual" in measured.columns else F.concat(failed.cast("string"), F.lit(" failing"))
    return measured.select(
        "test_id", "dataset", "column", "quality_dimension", "rule", "expected",
        actual.alias("actual"),
        failed.alias("failed_count"),
        F.coalesce(F.round(F.try_divide(failed * 100.0, total.cast("double")), 4), F.lit(0.0)).alias("failure_rate"),
        (F.col("declared") if keep_severity else F.when(passed, F.lit("NONE")).otherwise(F.col("declared"))).alias("severity"),
        F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
    )


def run_rules(spark: SparkSession, tables: Tables, rules: list[Rule], keep_severity: bool = False) -> DataFrame:
    """Results of all rules. Jobs: one for each table with row rules, each key set and each edge."""
    by_table, by_key, parts = defaultdict(list), defaultdict(list), []
    fixed = [r for r in rules if isinstance(r, FixedRule)]
    for r in rules:
        if isinstance(r, RowRule | EmptyRule):
            by_table[r.dataset].append(r)
        elif isinstance(r, KeyRule):
            by_key[r.dataset, r.keys].append(r)
        elif isinstance(r, EdgeRule):
            parts.append(_edge_rule(tables, r))
    parts += [_row_rules(tables[t], own) for t, own in by_table.items()]
    parts += [_key_rules(tables[t], keys, own) for (t, keys), own in by_key.items()]
    plain = [finish(p, keep_severity) for p in parts]
    if fixed:
        plain.append(finish(_fixed_rules(spark, fixed), keep_severity))
    return union(plain) if plain else spark.createDataFrame([], RESULT)


# ---------------------------------------------------------------- rule families


def existence(spark: SparkSession, paths: dict[str, str]) -> list[Rule]:
    """Every expected dataset is where it should lie and can be read; a missing one is a failed check, not an exception."""
    return [FixedRule(f"DQ-EXIST-{r.dataset}", r.dataset, WHOLE, "Completeness", "dataset is available", "CRITICAL", int(not r.is_present), r.reason) for r in probe(spark, paths).collect()]


def schema_conformity(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    out = []
    for n, s in specs.items():
        if n in tables:
            missing, more = sorted(set(s.columns) - set(tables[n].columns)), sorted(set(tables[n].columns) - set(s.columns))
            out.append(FixedRule(f"DQ-SCHEMA-{n}", n, WHOLE, "Validity", "columns as declared", "CRITICAL" if missing else "LOW", len(missing) + len(more), f"missing={missing} unexpected={more}"))
    return out


def missing_values(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    return [RowRule(f"DQ-MISSING-{n}-{c}", n, c, "Completeness", "no missing values", "HIGH" if c in s.key else "MEDIUM", f"{c} IS NULL") for n, s in specs.items() if n in tables for c in s.columns]


def key_nulls(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    return [RowRule(f"DQ-PKNULL-{n}-{c}", n, c, "Completeness", "no null in a key", "CRITICAL", f"{c} IS NULL") for n, s in specs.items() if n in tables for c in s.key]


def key_uniqueness(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    return [KeyRule(f"DQ-PKUNIQUE-{n}", n, ", ".join(s.key), "Uniqueness", "unique key", "CRITICAL", s.key) for n, s in specs.items() if n in tables and s.key]


def row_duplicates(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    return [KeyRule(f"DQ-DUPROW-{n}", n, "__FULL_ROW__", "Uniqueness", "no repeated rows", "MEDIUM", tuple(tables[n].columns)) for n in specs if n in tables]


def _matches(kind: str, t: T.DataType) -> bool:
    if kind == "integer":
        return isinstance(t, T.IntegralType)
    if kind == "numeric":
        return isinstance(t, T.NumericType)
    if kind == "string":
        return isinstance(t, T.StringType)
    return isinstance(t, T.DatetimeType | T.StringType)


def type_conformity(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    """All rows fail where the type differs; text for a datetime fails row by row, where it does not parse."""
    out = []
    for n, s in specs.items():
        for c, kind in s.columns.items() if n in tables else ():
            if c not in tables[n].columns:
                continue
            t = tables[n].schema[c].dataType
            fails = "true"
            if _matches(kind, t):
                fails = f"{c} IS NOT NULL AND try_to_timestamp({c}) IS NULL" if kind == "datetime" and isinstance(t, T.StringType) else "false"
            out.append(RowRule(f"DQ-TYPE-{n}-{c}", n, c, "Validity", f"type {kind}", "HIGH", fails))
    return out


def sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def domains(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    rules: list[Rule] = [RowRule(f"DQ-DOMAIN-{n}-{c}", n, c, "Validity", "value of the domain", "MEDIUM" if c.endswith("state") else "HIGH", f"{c} IS NOT NULL AND {c} NOT IN ({sql_list(d)})") for n, s in specs.items() if n in tables for c, d in s.domains.items()]
    return rules + [RowRule(f"DQ-DOMAIN-{n}-{c}", n, c, "Validity", f"between {lo} and {hi}", "HIGH", f"{c} NOT BETWEEN {lo} AND {hi}") for n, s in specs.items() if n in tables for c, (lo, hi) in s.ranges.items() if c.endswith("score")]


def zero_values(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    return [RowRule(f"DQ-ZERO-{n}-{c}", n, c, "Validity", "not zero", "LOW", f"{c} = 0") for n, s in specs.items() if n in tables for c in s.zero_checked]


def negative_values(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    return [RowRule(f"DQ-NEG-{n}-{c}", n, c, "Validity", "not negative", "HIGH", f"{c} < 0") for n, s in specs.items() if n in tables for c in s.negative_checked]


def date_parseability(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    text = lambda n, c: isinstance(tables[n].schema[c].dataType, T.StringType)
    return [RowRule(f"DQ-DATE-{n}-{c}", n, c, "Validity", "parses as a timestamp", "HIGH", f"{c} IS NOT NULL AND try_to_timestamp({c}) IS NULL" if text(n, c) else "false") for n, s in specs.items() if n in tables for c in s.of_type("datetime")]


def chronology(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    return [RowRule(f"DQ-CHRONO-{n}-{k}", n, late, "Consistency", f"{late} not before {early}", "HIGH", f"{late} < {early}") for n, s in specs.items() if n in tables for k, (early, late) in enumerate(s.chronology, 1)]


def referential_integrity(edges: tuple[Edge, ...], tables: Tables, count_null_keys: bool = False) -> list[Rule]:
    return [EdgeRule(f"DQ-FK-{e.child}-{e.column}", e.child, e.column, "Referential Integrity", f"found in {e.parent}.{e.parent_column}", e.severity, e, count_null_keys) for e in edges if {e.child, e.parent} <= set(tables)]


def lookup_coverage(lookups: tuple[Edge, ...], tables: Tables) -> list[Rule]:
    out: list[Rule] = []
    for e in lookups:
        if {e.child, e.parent} <= set(tables):
            out.append(EdgeRule(f"DQ-LOOKUP-{e.child}-{e.column}", e.child, e.column, "Consistency", f"rows found in {e.parent}", e.severity, e))
            out.append(EdgeRule(f"DQ-LOOKUP-{e.child}-{e.column}-DISTINCT", e.child, e.column, "Consistency", f"values found in {e.parent}", e.severity, e, distinct=True))
    return out


def plausibility(specs: dict[str, DatasetSpec], tables: Tables) -> list[Rule]:
    return [RowRule(f"DQ-RANGE-{n}-{c}", n, c, "Validity", f"between {lo} and {hi}", "MEDIUM", f"{c} NOT BETWEEN {lo} AND {hi}") for n, s in specs.items() if n in tables for c, (lo, hi) in s.ranges.items() if not c.endswith("score")]


def categorical_examples(tables: Tables, specs: dict[str, DatasetSpec], most: int = 10) -> DataFrame:
    """For each column with a domain: how many rows lie outside, and up to ``most`` such values in order.

    Only distinct outside values are grouped (by column and value first), so no list grows with the rows.
    """
    parts = []
    for n, s in specs.items():
        for c, d in s.domains.items() if n in tables else ():
            outside = F.col(c).isNotNull() & ~F.col(c).isin(*d)
            counted = tables[n].filter(outside).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed_count"))
            first = counted.orderBy("value").limit(most).agg(F.concat_ws(", ", F.array_sort(F.collect_list("value"))).alias("examples"))
            parts.append(total.crossJoin(F.broadcast(first)).select(F.lit(n).alias("dataset"), F.lit(c).alias("column"), "failed_count", "examples"))
    return union(parts)


# ---------------------------------------------------------------- summaries


def check_classification(results: DataFrame) -> DataFrame:
    """Rows whose status or severity is none of the known ones; a sane result has none."""
    return results.filter(~F.col("status").isin(*STATUSES) | ~F.col("severity").isin(*SEVERITIES))


def _tally() -> list[Column]:
    failed = F.col("status") == "FAIL"
    return [F.count(F.lit(1)).alias("total_tests"), F.count_if(~failed).alias("passed_tests"), F.count_if(failed).alias("failed_tests"), *(F.count_if(failed & (F.col("severity") == s)).alias(f"{s.lower()}_issues") for s in SEVERITIES[:4])]


def by_dataset(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset").agg(*_tally()).withColumn("overall_status", F.when(F.col("failed_tests") == 0, "PASS").otherwise("FAIL"))


def by_dimension(results: DataFrame) -> DataFrame:
    return results.groupBy("quality_dimension").agg(*_tally())


def totals(results: DataFrame) -> DataFrame:
    return results.agg(*_tally()).withColumn("overall_status", F.when(F.col("failed_tests") == 0, "PASS").otherwise("FAIL"))


def rank() -> Column:
    out = F.lit(len(SEVERITIES))
    for k, s in reversed(list(enumerate(SEVERITIES, 1))):
        out = F.when(F.col("severity") == s, k).otherwise(out)
    return out


def ranked(results: DataFrame) -> DataFrame:
    return results.withColumn("severity_rank", rank()).orderBy("severity_rank", "dataset", "test_id")


def failed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "FAIL").withColumn("severity_rank", rank()).orderBy("severity_rank", F.desc("failed_count"), "test_id")


def priority(results: DataFrame) -> DataFrame:
    return results.filter((F.col("status") == "FAIL") & F.col("severity").isin("CRITICAL", "HIGH")).orderBy("severity", "dataset", "test_id")


def with_severity(rules: list[Rule], severity: str) -> list[Rule]:
    return [replace(r, severity=severity) for r in rules]
