"""Reference checks by an index of the parent's keys.

Whole-number keys set bits: a bitmap of 32,768 keys is 4 KB, and the bitmaps of a parent are a table (bucket, bitmap). If
they are small enough to be broadcast (``MOST_BYTES``, counted before), each child row looks its key up where it lies, and
only orphans are shuffled. The index is exact, so what it lets through needs no second look. Keys of other types, sparse
keys and very large parents have no such index; they are counted by key and joined.

Defined results: null child keys are left out or counted, as asked; null parent keys match nothing; an empty parent has an
empty index, and all children are orphans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.operators.checks import unmatched_counts

MOST_BYTES, BITMAP_BYTES = 64 << 20, 4096


def build(parent: DataFrame, column: str, most_bytes: int = MOST_BYTES) -> DataFrame | None:
    """(bucket, bitmap) of the keys, or None if they are no whole numbers or need more than ``most_bytes``."""
    if not isinstance(parent.schema[column].dataType, T.IntegralType):
        return None
    key = F.col(column).cast("bigint")
    keys = parent.filter(key.isNotNull()).select(F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit"))
    buckets = keys.agg(F.approx_count_distinct("bucket", 0.05)).first()[0]
    if buckets * 1.2 * BITMAP_BYTES > most_bytes:
        return None
    return keys.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def has(bitmap: Column, bit: Column) -> Column:
    """Whether a bitmap has a bit; false if there is no bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def orphans(child: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """Child rows with a key that the index does not hold; no row of the child is shuffled."""
    key = F.col(column).cast("bigint")
    keyed = child.filter(key.isNotNull()).withColumns({"__bucket": F.bitmap_bucket_number(key), "__bit": F.bitmap_bit_position(key)})
    met = keyed.join(F.broadcast(index.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))), "__bucket", "left")
    return met.filter(~has(F.col("__bitmap"), F.col("__bit"))).select(*child.columns)


def orphan_counts(child: DataFrame, column: str, parent: DataFrame, parent_column: str, count_null_keys: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(__key, n) of child keys without a parent, by the index if there can be one."""
    index = build(parent, parent_column, most_bytes) if isinstance(child.schema[column].dataType, T.IntegralType) else None
    if index is None:
        return unmatched_counts(child, column, parent, parent_column, count_null_keys)
    found = orphans(child.select(column), column, index)
    if count_null_keys:
        found = found.unionByName(child.select(column).filter(F.col(column).isNull()))
    return found.groupBy(F.col(column).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
