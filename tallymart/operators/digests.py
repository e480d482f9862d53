"""Rows and sets of rows compared by digests.

A row's digest is 128 bits: two XXH64 chains over its columns and over which of them are null, with different starts. Of
10^11 different rows two share a digest with a chance below 10^-16; results that hand on rows compare the rows themselves.

A set's digest is commutative (a count, an exclusive or and a sum of row digests), so it needs no order and no join, and
digests of ranges of rows add up to that of all. Two sets that differ are compared range by range, and only ranges that
differ are divided further.

Defined results: nulls are values, NaN equals NaN and -0.0 equals 0.0; whole numbers of different types are equal if their
values are; an empty table has no repeats and the digest of an empty set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the two chains start.
STARTS = (0x5EED, 0xD1CE)
#: Bits by which a range of rows is divided at each step; ranges that are looked into one by one. If more differ, their
#: rows are compared at once.
STEP_BITS, OPEN_RANGES, LAST_BITS = 8, 64, 40


def _plain(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c.cast("double") + F.lit(0.0))
    return c.cast("bigint") if isinstance(kind, T.IntegralType) else c


def row_digest(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two columns of 64 bits over the given columns (all of them)."""
    names = columns or df.columns
    plain = [_plain(df, c) for c in names]
    masks = [reduce(lambda a, b: a.bitwiseOR(b), (F.when(c.isNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, c in enumerate(plain[at : at + 60]))) for at in range(0, len(plain), 60)]
    return [F.xxhash64(F.lit(start), *masks, *plain) for start in STARTS]


def digested(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    a, b = row_digest(df, columns)
    return df.withColumns({"__d0": a, "__d1": b})


def repeats(df: DataFrame) -> DataFrame:
    """(__d0, __d1, n): how often each row occurs; 16 bytes of a row and a count are shuffled."""
    a, b = row_digest(df)
    return df.select(a.alias("__d0"), b.alias("__d1")).groupBy("__d0", "__d1").agg(F.count(F.lit(1)).alias("n"))


def repeat_figures(df: DataFrame) -> DataFrame:
    """(total_rows, distinct_rows, participating_rows, excess_rows, duplicate_groups) of whole rows."""
    n = F.col("n")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return repeats(df).agg(
        none(F.sum(n)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"), none(F.sum(F.when(n > 1, n))).alias("participating_rows"),
        none(F.sum(n - 1)).alias("excess_rows"), F.count_if(n > 1).alias("duplicate_groups"),
    )


def repeated_rows(df: DataFrame, name: str = "occurrences") -> DataFrame:
    """Rows that occur more than once, with their number. Only rows whose digest repeats carry their columns on, and these
    are compared by value."""
    columns = df.columns
    again = repeats(df).filter("n > 1").select("__d0", "__d1")
    some = digested(df).join(again, ["__d0", "__d1"], "left_semi").select(*columns)
    return some.groupBy(*columns).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


# ---------------------------------------------------------------- sets


def set_digest(df: DataFrame, columns: list[str], distinct: bool = True, by: list[Column] | None = None) -> DataFrame:
    """(rows, parity, total) of the rows over ``columns``, for each value of ``by`` if given. ``distinct``: of the set of
    different rows, else of all with their repetitions."""
    a, b = row_digest(df, columns)
    each = df.select(*(by or []), a.alias("__d0"), b.alias("__d1"))
    each = each.distinct() if distinct else each
    low = F.col("__d1").bitwiseAND((1 << 40) - 1)  # sums of up to 2 ** 23 * 2 ** 40 stay below 2 ** 63, wider ones go on in decimals
    return each.groupBy(*(c for c in each.columns if c not in ("__d0", "__d1"))).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("__d0").alias("parity"), F.sum(low.cast("decimal(38,0)")).alias("total"))


def same_set(a: DataFrame, b: DataFrame, columns: list[str], distinct: bool = True) -> DataFrame:
    """(a_rows, b_rows, same): one aggregate on either side, whatever the tables' size, and no join of rows."""
    x, y = (set_digest(d, columns, distinct).select(*(F.col(c).alias(f"{p}_{c}") for c in ("rows", "parity", "total"))) for p, d in (("a", a), ("b", b)))
    one = x.crossJoin(F.broadcast(y))
    return one.select("a_rows", "b_rows", reduce(lambda p, q: p & q, (F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in ("rows", "parity", "total"))).alias("same"))


def _range(df: DataFrame, columns: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(row_digest(df, columns)[0], 64 - bits)


def set_difference(a: DataFrame, b: DataFrame, columns: list[str], distinct: bool = True) -> DataFrame:
    """(columns, only_in): rows of one table that the other lacks, 'a' or 'b'; with repetitions if not ``distinct``.

    Digests of ranges are compared step by step. What reaches the driver are ranges that differ, at most OPEN_RANGES of
    them in a step; what is joined are the rows of the last ones.
    """
    bits, open_ = 0, None
    while bits < LAST_BITS:
        wider = bits + STEP_BITS
        sides = []
        for name, d in (("a", a), ("b", b)):
            rows = d if open_ is None else d.filter(_range(d, columns, bits).isin(*open_))
            sides.append(set_digest(rows, columns, distinct, [_range(rows, columns, wider).alias("__range")]).select("__range", F.struct("rows", "parity", "total").alias(name)))
        apart = sides[0].join(sides[1], "__range", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        found = apart.select("__range", F.greatest(F.col("a.rows"), F.col("b.rows")).alias("rows")).limit(OPEN_RANGES + 1).collect()
        if not found:
            return a.select(*columns, F.lit("a").alias("only_in")).limit(0)
        if len(found) > OPEN_RANGES:
            break  # too many to look into one by one: the ranges open so far are compared at once
        bits, open_ = wider, [r["__range"] for r in found]
        if max(r["rows"] for r in found) <= 1024:
            break
    parts = []
    for d in (a, b):
        rows = d if open_ is None else d.filter(_range(d, columns, bits).isin(*open_))
        parts.append(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))
    x, y = digested(parts[0], columns), digested(parts[1], columns)
    met = x.alias("x").join(y.alias("y"), (F.col("x.__d0") == F.col("y.__d0")) & (F.col("x.__d1") == F.col("y.__d1")), "full_outer")
    n = lambda side: F.coalesce(F.col(f"{side}.n"), F.lit(0))
    more = (F.when(n("x") > 0, 1).otherwise(0) - F.when(n("y") > 0, 1).otherwise(0)) if distinct else n("x") - n("y")
    kept = [F.coalesce(F.col(f"x.`{c}`"), F.col(f"y.`{c}`")).alias(c) for c in columns]
    found = met.select(*kept, more.cast("bigint").alias("__more")).filter("__more <> 0")
    out = found.select(*columns, F.when(F.col("__more") > 0, "a").otherwise("b").alias("only_in"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("__more"))).alias("__nth"))
    return out.drop("__nth")
