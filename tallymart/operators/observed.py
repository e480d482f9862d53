"""Cleaning that is audited by the write itself.

A dataset's cleaning is a list of steps. Counts of rules, and of rows before and after, are observed metrics of the one
query that writes the cleaned table, so its source is read once. Spark adds the metrics of a task when the task ends; a
task of an earlier stage may run again if an executor is lost, and would be counted twice, so everything is observed
after the last shuffle: equal rows are grouped first and carry how many they are.

Defined results: an empty table has zero counts; a step that keeps rows but changes their number raises RowCountChanged
before anything reads the table; a count before a deduplication is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import columns as C
from tallymart.operators import clean
from tallymart.operators.clean import Action, RowCountChanged
from tallymart.sources import tables

AUDIT = "dataset string, `column` string, issue string, rule string, action string, rows_affected bigint, rows_before bigint, rows_after bigint, rationale string, status string"


@dataclass(frozen=True)
class Change:
    """A change of values; rows stay."""

    work: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Deduplicate:
    """Of equal rows one is kept; with ``audited`` that has an audit row."""

    audited: bool = True


Step = Action | Change | Deduplicate
COPIES = "__copies"


def retail_steps(mode: str = "chained") -> dict[str, list[Step]]:
    """The cleaning of the retail datasets, in the order of its steps."""
    codes = lambda *names: Change(lambda df: df.withColumns({c: C.code(F.col(c)) for c in names}))
    blanks = lambda names: Change(lambda df: df.withColumns({c: C.blank_to_null(F.col(c)) for c in names or df.columns}))
    first, second = clean.ORDER_CHAIN
    late = [clean.nullified_before("orders", *second)]
    nullify = Change(lambda df: clean.nullify_chain(df, [first])), Change(lambda df: clean.nullify_chain(df, [second]))
    whole = Change(lambda df: clean.nullify_chain(df, clean.ORDER_CHAIN, "independent"))
    chain = [nullify[0], *late, nullify[1]] if mode == "chained" else [*late, whole]
    delivered = [clean.retain_null_where("orders", c, "order_status = 'delivered'", "delivered without a date") for c, _ in clean.ORDER_CHAIN]
    numbers = ["product_name_lenght", "product_description_lenght", "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]
    return {
        "customers": [codes("customer_city", "customer_state")],
        "geolocation": [codes("geolocation_city", "geolocation_state"), Deduplicate()],
        "orders": [clean.nullified_before("orders", *first), *chain, *delivered],
        "order_items": [clean.retain_zero("order_items", "freight_value")],
        "payments": [clean.nullified_value("payments", "payment_installments", 0), clean.retain_zero("payments", "payment_value"), Change(lambda df: clean.nullify_value(df, "payment_installments", 0))],
        "reviews": [Deduplicate(), *(clean.retain_null("reviews", c) for c in ("review_comment_title", "review_comment_message"))],
        "products": [blanks(["product_category_name"]), clean.retain_null("products", "product_category_name"), *(clean.retain_null("products", c, True) for c in numbers), clean.retain_zero("products", "product_weight_g")],
        "sellers": [codes("seller_city", "seller_state")],
        "category_translation": [blanks(None), Deduplicate(audited=False)],
    }


class Observed:
    """A dataset with its steps applied and its counts attached; ``df`` is lazy, and the counts are there once it has been
    written."""

    def __init__(self, dataset: str, df: DataFrame, steps: list[Step]):
        self.dataset, self.steps, self.columns = dataset, steps, df.columns
        self.seen: list[tuple[Observation, list[Action]]] = []
        self.grouped = any(isinstance(s, Deduplicate) for s in steps)
        last = max((k for k, s in enumerate(steps) if isinstance(s, Deduplicate)), default=-1)
        if any(isinstance(s, Action) for s in steps[: max(last, 0)]):
            raise ValueError(f"{dataset}: counts before a deduplication would be observed before a shuffle")
        waiting: list[Action] = []
        if last < 0:
            df, self.start = self._observe(df, F.count(F.lit(1)).alias("rows"))
        for k, step in enumerate([*steps, None]):
            if isinstance(step, Action):
                waiting.append(step)
                continue
            if waiting:
                df, o = self._observe(df, *(F.count_if(F.expr(a.counts)).alias(f"a{i}") for i, a in enumerate(waiting)))
                self.seen.append((o, waiting))
                waiting = []
            if isinstance(step, Change):
                df = step.work(df)
            elif isinstance(step, Deduplicate):
                df = df.groupBy(*self.columns).agg(F.count(F.lit(1)).alias(COPIES))
                if k == last:
                    df, self.start = self._observe(df, F.sum(COPIES).alias("rows"))
                    df = df.drop(COPIES)
        self.df, self.end = self._observe(df.select(*self.columns), F.count(F.lit(1)).alias("rows"))

    def _observe(self, df: DataFrame, *counts) -> tuple[DataFrame, Observation]:
        o = Observation()
        return df.observe(o, *counts), o

    @property
    def rows(self) -> tuple[int, int]:
        """Rows before and after."""
        return tuple(o.get.get("rows") or 0 for o in (self.start, self.end))

    def entries(self) -> list[tuple]:
        """Audit rows; a rule that is only told if it is found is left out otherwise."""
        before, after = self.rows
        if before != after and not self.grouped:
            raise RowCountChanged(f"{self.dataset}: {before} rows became {after}")
        out = [self._row(Action(self.dataset, "__FULL_ROW__", "repeated rows", "one of equal rows is kept", clean.DEDUPLICATE, "", "equal rows say nothing new"), before - after, before)] if any(isinstance(s, Deduplicate) and s.audited for s in self.steps) else []
        for o, actions in self.seen:
            counts = o.get
            out += [self._row(a, n, after) for k, a in enumerate(actions) if (n := counts.get(f"a{k}") or 0) or not a.only_if_found]
        return out

    def _row(self, a: Action, affected: int, before: int) -> tuple:
        return a.dataset, a.column, a.issue, a.rule, a.action, affected, before, self.rows[1], a.rationale, a.status


def write_clean(given: dict[str, DataFrame], base: str, steps: dict[str, list[Step]] | None = None) -> tuple[dict[str, DataFrame], list[Observed]]:
    """Writes every cleaned dataset to a folder of its own under ``base``, each by one query, a few of them at a time."""
    done = [Observed(name, given[name], own) for name, own in (steps or retail_steps()).items() if name in given]
    tables.at_once([lambda o=o: o.df.write.mode("overwrite").parquet(f"{base}/{o.dataset}") for o in done])
    spark = next(iter(given.values())).sparkSession
    return {o.dataset: spark.read.schema(o.df.schema).parquet(f"{base}/{o.dataset}") for o in done}, done


def audit_log(spark: SparkSession, done: list[Observed]) -> DataFrame:
    """The audit rows of what has been written: a row for each rule."""
    return spark.createDataFrame([row for o in done for row in o.entries()], AUDIT)


def row_invariants(spark: SparkSession, done: list[Observed]) -> DataFrame:
    """(dataset, rows_before, rows_after, unchanged) of each dataset written."""
    return spark.createDataFrame([(o.dataset, *o.rows, o.rows[0] == o.rows[1]) for o in done], "dataset string, rows_before bigint, rows_after bigint, unchanged boolean")
