"""Operator 9: URL filters by host rules and a weighted vocabulary.

A rule (host and path prefix) fits its host and all subdomains; the longest fitting rule decides. Where none fits, the
vocabulary does: an Aho-Corasick automaton finds strict and soft terms in the lower-cased URL after ``://``; a hit
counts where neither neighbour is an ASCII letter or digit. One strict term, or ``SOFT_LIMIT`` distinct soft terms,
reject the URL.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule, has no terms and is
allowed; of rules of one length that fit, the one that is later in the alphabet decides; repeated rows are judged
each; URLs are read whole; an empty table gives no rows. The input's columns stay as they are, and a new column whose
name is taken comes under the first free one of name_, name__ and so on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, beside, map_column, table


@dataclass(frozen=True)
class HostRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (
    HostRule("allow", "org/"),
    HostRule("block", "example.org/es/"),
    HostRule("block", "example.org/en/1"),
    HostRule("allow", "com/fr/"),
    HostRule("block", "com/de/"),
)

STRICT = ("porn", "porno", "xxx", "hentai", "milf", "camgirls", "casino", "casinos", "viagra", "cialis", "escorts", "blackjack", "roulette", "malware", "warez", "phishing")
SOFT = ("ads", "adult", "bet", "bets", "betting", "bonus", "cheap", "clicks", "coupon", "crack", "dating", "deal", "deals", "discount", "free", "gambling", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "pharma", "pharmacy", "pills", "poker", "popup", "prize", "promo", "replica", "sexy", "slots", "sponsored", "torrent", "track", "tracker", "win", "winner")
SOFT_LIMIT = 2

TERM_SQL = "array<struct<term:string,n:int>>"


class Vocabulary:
    """Counts terms of a text at word boundaries, overlapping matches included."""

    def __init__(self, terms: tuple[str, ...]):
        self.trie = ahocorasick.Automaton()
        for t in terms:
            self.trie.add_word(t, t)
        self.trie.make_automaton()

    def count(self, text: str) -> dict[str, int]:
        found: dict[str, int] = {}
        for end, term in self.trie.iter(text) if self.trie else ():
            start, after = end - len(term), end + 1
            if (start < 0 or not _joins(text[start])) and (after == len(text) or not _joins(text[after])):
                found[term] = found.get(term, 0) + 1
        return found


def _joins(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    rest = after_scheme(F.col(url))
    return pages.withColumns({"host": ascii_lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)), "path": F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)})


def apply_rules(pages: DataFrame, rules: tuple[HostRule, ...] = RULES) -> DataFrame:
    """Adds rule and rule_verdict (null where none fits). Rules are a short list of the caller (hundreds, not
    millions), tried from the longest to the shortest."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):  # the last one set stands outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def count_terms(pages: DataFrame, url: str = "url", strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> DataFrame:
    """Adds the terms found, each with its count."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))

    def make() -> Callable[[list], list]:
        words = Vocabulary(strict + soft)
        return lambda texts: [[{"term": k, "n": n} for k, n in sorted(words.count(t or "").items())] for t in texts]

    scanned = pages.withColumn("__scan", ascii_lower(after_scheme(F.col(url))))
    return map_column(scanned, "__scan", "terms", kind, TERM_SQL, make, rows=2048).drop("__scan")


def judge(pages: DataFrame, url: str = "url", rules: tuple[HostRule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Adds host, path, rule, rule_verdict, terms, n_strict, n_soft (distinct) and verdict."""
    return beside(pages, {"url": url}, lambda p: _judge(p, rules, strict, soft, soft_limit))


def _judge(pages: DataFrame, rules: tuple[HostRule, ...], strict: tuple[str, ...], soft: tuple[str, ...], soft_limit: int) -> DataFrame:
    seen = count_terms(apply_rules(split_url(pages), rules), "url", strict, soft)
    among = lambda words: F.size(F.filter("terms", lambda t: t["term"].isin(*words))) if words else F.lit(0)
    seen = seen.withColumns({"n_strict": among(strict), "n_soft": among(soft)})
    rejects = (F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit)
    return seen.withColumn("verdict", F.coalesce("rule_verdict", F.when(rejects, "block").otherwise("allow")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return pages.select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    low = f"translate(rest, '{UPPER}', '{UPPER.lower()}')"
    hit = lambda words: f"regexp_matches({low}, '(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])')"
    soft = " + ".join(f"CASE WHEN {hit([w])} THEN 1 ELSE 0 END" for w in SOFT)
    by_length = sorted(RULES, key=lambda r: -len(r.rule))
    fits = lambda r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in by_length) + " END"
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (
  SELECT *, {case(lambda r: r.rule)} AS rule, {case(lambda r: r.verdict)} AS by_rule,
         {hit(STRICT)} AS strict, {soft} AS n_soft FROM p)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN strict OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM j"""


ORACLE_SQL = {"op9_url_filters": _sql()}
