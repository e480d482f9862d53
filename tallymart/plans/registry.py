"""Queries by name, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymart.operators.checks import EdgeRule, EmptyRule, FixedRule, KeyRule, RowRule, Rule
from tallymart.plans.roles import with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = with_sql(sql)


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def measured_sql(rules: list[Rule]) -> str:
    """(test_id … declared, failed, total), rule by rule: each one reads its table anew."""
    parts = []
    for r in rules:
        t = f"r_{r.dataset}"
        if isinstance(r, EmptyRule):
            amounts = f"(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM {t}) AS failed, 1 AS total"
        elif isinstance(r, RowRule):
            amounts = f"(SELECT count(*) FROM {t} WHERE ({r.among}) AND ({r.fails})) AS failed, (SELECT count(*) FROM {t} WHERE {r.among}) AS total"
        elif isinstance(r, KeyRule):
            amount = {"participating": "coalesce(sum(CASE WHEN n > 1 THEN n END), 0)", "excess": "coalesce(sum(n - 1), 0)", "groups": "count(CASE WHEN n > 1 THEN 1 END)"}[r.measure]
            amounts = f"(SELECT {amount} FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(r.keys)}) AS g) AS failed, (SELECT count(*) FROM {t}) AS total"
        elif isinstance(r, EdgeRule):
            e = r.edge
            amount = f"count(DISTINCT c.{e.column})" if r.distinct else "count(*)"
            null = "" if r.count_null_keys else f"c.{e.column} IS NOT NULL AND "
            amounts = f"(SELECT {amount} FROM r_{e.child} AS c WHERE {null}NOT EXISTS (SELECT 1 FROM r_{e.parent} AS p WHERE p.{e.parent_column} = c.{e.column})) AS failed, (SELECT count(*) FROM r_{e.child}) AS total"
        elif isinstance(r, FixedRule):
            amounts = f"{r.failed} AS failed, {max(r.failed, 1)} AS total"
        actual = text(r.actual) if isinstance(r, FixedRule) else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT {text(r.test_id)} AS test_id, {text(r.dataset)} AS dataset, {text(r.column)} AS \"column\", {text(r.dimension)} AS quality_dimension, {text(r.rule)} AS rule, {text(r.expected)} AS expected, {actual} AS actual, {text(r.severity)} AS declared, {amounts}")
    return "\nUNION ALL ".join(parts)


def results_sql(rules: list[Rule], keep_severity: bool = False) -> str:
    """The full result contract."""
    severity = "declared" if keep_severity else "CASE WHEN failed = 0 THEN 'NONE' ELSE declared END"
    return f"""SELECT test_id, dataset, "column", quality_dimension, rule, expected, coalesce(actual, CAST(failed AS VARCHAR) || ' failing') AS actual, CAST(failed AS BIGINT) AS failed_count,
        coalesce(round(failed * 100.0E0 / nullif(total, 0), 4), 0) AS failure_rate, {severity} AS severity, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({measured_sql(rules)}) AS measured"""


def with_rows(sql: str, named, prefix: str = "r_") -> str:
    """SQL of results by dataset, with the rows of the tables that are there."""
    return f"SELECT res.*, CASE dataset {' '.join(f"WHEN '{n}' THEN (SELECT count(*) FROM {prefix}{n})" for n in named)} END AS total_rows FROM ({sql}) AS res"
