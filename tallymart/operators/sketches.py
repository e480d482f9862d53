"""Distinct counts, approximate by stored sketches and exact without multiplying rows by columns.

Approximate: one HyperLogLog sketch for each column, all in one aggregate over one scan. Sketches are rows (column, sketch)
that can be stored by day or by part, merged later and estimated at any time. The relative standard error is about
1.04 / sqrt(2 ** lg_k): 1.6 % for the usual 12, 0.4 % for 16.

Exact: whole-number columns whose values lie close enough together set bits in bitmaps of 32,768 values, so a value is
one bit when it is shuffled. All other columns become pairs (column, value), which Spark groups before the shuffle.

Defined results: nulls are no values; NaN is one value; an empty table has zero counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_K = 12
#: Bitmaps are used if a column's span is at most this many times its values.
SPARSE = 64


def _sketchable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("bigint")
    return F.col(name) if isinstance(kind, T.StringType | T.BinaryType) else _text(df, name)


def _text(df: DataFrame, name: str) -> Column:
    """A value as text; -0.0 is 0.0."""
    c = F.col(name)
    return (c + F.lit(0.0) if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType) else c).cast("string")


def distinct_sketches(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, lg_k: int = LG_K) -> DataFrame:
    """(by, column, rows, sketch): one scan and one aggregate for all columns."""
    names = columns or df.columns
    one = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *(F.hll_sketch_agg(_sketchable(df, c), F.lit(lg_k)).alias(f"s{k}") for k, c in enumerate(names)))
    rows = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"s{k}").alias("sketch")) for k, c in enumerate(names)]
    return one.select(*(by or []), F.explode(F.array(*rows)).alias("r")).select(*(by or []), "r.*")


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, column, rows, sketch) of sketches of parts, such as days or files, whatever columns told the parts apart."""
    return sketches.groupBy(*(by or []), "column").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """The sketches' estimates in place of the sketches."""
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), F.hll_sketch_estimate("sketch").alias("distinct_values"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, distinct_values), exact. A first aggregate finds out which columns suit bitmaps; every column is then
    read once, by bitmaps or by pairs."""
    names = columns or df.columns
    whole = [c for c in names if isinstance(df.schema[c].dataType, T.IntegralType)]
    dense: list[str] = []
    if whole:
        spans = df.agg(*(x for c in whole for x in (F.count(c).alias(f"n_{c}"), F.min(F.col(c).cast("bigint")).alias(f"lo_{c}"), F.max(F.col(c).cast("bigint")).alias(f"hi_{c}")))).first()
        dense = [c for c in whole if spans[f"n_{c}"] and spans[f"hi_{c}"] - spans[f"lo_{c}"] <= SPARSE * spans[f"n_{c}"]]
    others = [c for c in names if c not in dense]
    parts = [df.sparkSession.createDataFrame([(c, 0) for c in names], "column string, n bigint")]
    if dense:
        bits = [F.struct(F.lit(c).alias("column"), F.bitmap_bucket_number(F.col(c).cast("bigint")).alias("bucket"), F.bitmap_bit_position(F.col(c).cast("bigint")).alias("bit")) for c in dense]
        each = df.select(F.explode(F.array(*bits)).alias("p")).select("p.*").filter("bit IS NOT NULL")
        maps = each.groupBy("column", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        parts.append(maps.groupBy("column").agg(F.sum(F.bitmap_count("bitmap")).alias("n")))
    if others:
        pairs = [F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in others]
        each = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("value IS NOT NULL")
        parts.append(each.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("column").agg(F.sum("n").cast("bigint").alias("distinct_values"))
