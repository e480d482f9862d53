"""Operator 1: quality rules as a bitmask ledger.

One pass measures every text and one column expression for each rule turns the measurements into failure bits. The
ledger (measurements and bits) is what is stored; a policy is a named, versioned set of rules, so applying one is a
bitwise AND, and ablations (what a policy would keep without one rule) are sums over the few distinct bit patterns.

Defined results: a null text has no words and fails the length rule; an empty table gives an empty ledger; repeated
rows are judged each; very long texts are measured whole; other columns of the documents pass through the ledger
unchanged, and if one is called like the new column, that one comes under the first free name of name_, name__ ...
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_column, table

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
NO_LETTERS = b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES.

    Words are runs of anything but ASCII white space (as bytes.split() cuts them). A line counts if it has a word;
    it is a duplicate if it equals an earlier line. A word is repeated if a window of three words around it occurs
    twice or more.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        marked = bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                marked[i : i + 3] = b"\1\1\1"
        repeated = sum(marked)
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        n - sum(not w.strip(NO_LETTERS) for w in words),
    )


@dataclass(frozen=True)
class Rule:
    """A rule has a fixed bit for all time; ``fails`` takes integers only, so every engine agrees on it."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 15 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "duplicate_lines", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "few_letter_words", "10 * n_letter_words < 6 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Policies by version; a policy never changes, a new one gets a new name.
POLICIES = {"base-1": BASE, "prose-1": tuple(r.name for r in RULES)}


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


def ledger(docs: DataFrame, text: str = "text", target: str = "quality") -> DataFrame:
    """Adds ``target``: a struct of the measurements and ``fail_bits``, each rule being evaluated once."""
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])
    sql = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

    def make() -> Callable[[list], list]:
        return lambda texts: [dict(zip(MEASURES, measure(t))) for t in texts]

    target = free_name(docs, target)
    measured = map_column(docs, text, target, kind, sql, make)
    q = {m: F.col(target)[m] for m in MEASURES}
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(_over(r.fails, target)), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn(target, F.struct(*(c.alias(m) for m, c in q.items()), bits.alias("fail_bits")))


def _over(condition: str, target: str) -> str:
    for m in sorted(MEASURES, key=len, reverse=True):
        condition = condition.replace(m, f"`{target}`.{m}")
    return condition


def passes(policy: str, bits: Column | str = "quality.fail_bits") -> Column:
    """Whether a row of the ledger is kept under a policy."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str, bits: str = "quality.fail_bits") -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and would be kept without it.

    The ledger is reduced to one row for each distinct bit pattern first (at most two to the number of rules).
    """
    whole = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy])))
    each = patterns.select("n", F.col("bits").bitwiseAND(F.lit(whole).cast("long")).alias("hit"), rules.alias("r")).select("n", "hit", "r.*")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        count(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("hit") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("hit").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def failures_by(rows: DataFrame, key: str, bits: str = "quality.fail_bits") -> DataFrame:
    """For each key: the rules that some document fails and those that every document fails, as bits."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.col(bits)).alias("any_bits"), F.bit_and(F.col(bits)).alias("all_bits"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")
    return rows.select(
        "doc_id",
        *MEASURES[:5],
        (~passes("base-1", "fail_bits")).alias("base_failed"),
        passes("prose-1", "fail_bits").alias("kept"),
        "fail_bits",
    )


#: Measurements and rules again, over positions of words.
ORACLE_SQL = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM g CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[^0-9!-/:-@\[-`{-~]'))) AS n_letter_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END)
       + (CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END) + (CASE WHEN n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)
       + (CASE WHEN 10 * n_letter_words < 6 * n_words THEN 64 ELSE 0 END) AS fail_bits
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM b"""
}
