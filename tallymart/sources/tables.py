"""Reading and writing tables: registered datasets, cleaned layers, result logs, inventories and upserts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.sources import files
from tallymart.specs import DatasetSpec

TYPES = {"string": T.StringType(), "integer": T.LongType(), "numeric": T.DoubleType(), "datetime": T.TimestampType()}


def as_text(spec: DatasetSpec) -> T.StructType:
    """All columns as text: files are read whole, and typed by the preprocessing, which counts what does not parse."""
    return T.StructType([T.StructField(c, T.StringType()) for c in spec.columns])


def typed(spec: DatasetSpec) -> T.StructType:
    return T.StructType([T.StructField(c, TYPES[k]) for c, k in spec.columns.items()])


def load(spark: SparkSession, path: str, spec: DatasetSpec | None = None, fmt: str = "parquet") -> DataFrame:
    """One dataset. CSV files have a header and may have quoted line breaks."""
    if fmt == "csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(as_text(spec)) if spec else reader).csv(path)
    return spark.read.format(fmt).load(path)


def load_all(spark: SparkSession, paths: dict[str, str], specs: dict[str, DatasetSpec] | None = None, fmt: str = "parquet") -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All datasets that can be read, and for each of the others the reason."""
    found, missing = {}, {}
    for name, path in paths.items():
        try:
            df = load(spark, path, (specs or {}).get(name), fmt)
            df.schema  # noqa: B018  resolves the path
            found[name] = df
        except AnalysisException as e:
            missing[name] = e.getCondition() or "unreadable"
    return found, missing


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create table as select, replacing what was there; in the warehouse, or under ``path``."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set a temporary one stands in,
    on a single machine only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def stage(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables written once to the shared folder and read again, for many checks over the same rows."""
    spark = next(iter(found.values())).sparkSession
    base, out = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}", {}
    at_once([lambda n=name, d=df: d.write.parquet(f"{base}/{n}") for name, df in found.items()])
    for name, df in found.items():
        out[name] = spark.read.schema(df.schema).parquet(f"{base}/{name}")
        out[name].staged_at = base
    return out


#: Queries that run side by side where one does not need the other.
SIDE_BY_SIDE = 3


def at_once(work: list[Callable[[], None]]) -> None:
    """Runs independent queries a few at a time; the first error ends it."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        for done in [pool.submit(inheritable_thread_target(w)) for w in work]:
            done.result()


def discard(spark: SparkSession, staged: dict[str, DataFrame]) -> None:
    """Deletes the folders of staged tables that nothing reads any more."""
    for base in {getattr(df, "staged_at", None) for df in staged.values()} - {None}:
        files.delete(spark, base)


def settle(df: DataFrame) -> DataFrame:
    """A result that no longer reads what it was made from, as Spark's own checkpoint in the shared folder."""
    spark, shared = df.sparkSession, shared_folder(df.sparkSession)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def existing_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """(dataset, table_exists) by the catalogue."""
    return spark.createDataFrame([(n, spark.catalog.tableExists(n)) for n in names], "dataset string, table_exists boolean")


def probe(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(dataset, is_present, columns, reason) of tables by path: each path is looked up and its schema read. A missing or
    unreadable one has a reason and no columns."""
    rows = []
    for name, path in paths.items():
        if not files.exists(spark, path):
            rows.append((name, False, 0, "missing"))
            continue
        found, reasons = load_all(spark, {name: path})
        rows.append((name, name in found, len(found[name].columns) if name in found else 0, reasons.get(name, "found")))
    return spark.createDataFrame(rows, "dataset string, is_present boolean, columns bigint, reason string")


def inventory(spark: SparkSession, expected: list[str], found: dict[str, DataFrame]) -> DataFrame:
    """(dataset, is_present, total_rows, total_columns) of each expected dataset; missing ones have none."""
    parts = [found[n].agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(n).alias("dataset"), F.lit(True).alias("is_present"), "total_rows", F.lit(len(found[n].columns)).cast("long").alias("total_columns")) for n in expected if n in found]
    absent = [(n, False, 0, 0) for n in expected if n not in found]
    out = spark.createDataFrame(absent, "dataset string, is_present boolean, total_rows bigint, total_columns bigint")
    for p in parts:
        out = out.unionByName(p)
    return out


def overview(found: dict[str, DataFrame]) -> DataFrame:
    """(dataset, total_rows, total_columns) across tables."""
    spark = next(iter(found.values())).sparkSession
    return inventory(spark, list(found), found).drop("is_present")


def column_counts(found: dict[str, DataFrame]) -> DataFrame:
    """(dataset, total_columns, filled_columns): columns of each table, and how many of them hold any value."""
    parts = [df.agg(*(F.count(c).alias(c) for c in df.columns)).select(F.lit(n).alias("dataset"), F.lit(len(df.columns)).cast("long").alias("total_columns"), sum(((F.col(c) > 0).cast("long") for c in df.columns), F.lit(0).cast("long")).alias("filled_columns")) for n, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def beside_rows(results: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Results by dataset with the rows of the tables that are there (null for others)."""
    return results.join(F.broadcast(overview(found).select("dataset", "total_rows")), "dataset", "left")


# ---------------------------------------------------------------- keys and upserts


def latest(rows: DataFrame, keys: Iterable[str], newest: Iterable[str] = (), keep_newest: bool = True) -> DataFrame:
    """One row for each key (no null in it): the largest by ``newest``, then by a hash of the row, then by its values.

    A maximum of structs, which Spark combines before the shuffle: a key may have any share of the rows.
    """
    keys, newest = list(keys), list(newest)
    values = [c for c in rows.columns if c not in keys and (keep_newest or c not in newest)]
    whole = rows.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    order = [*(F.col(c).alias(f"o{k}") for k, c in enumerate(newest)), F.xxhash64(*rows.columns).alias("h"), *(F.col(c).alias(f"v{k}") for k, c in enumerate(values))]
    best = whole.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__best"))
    picked = {c: F.col(f"__best.v{k}").alias(c) for k, c in enumerate(values)}
    return best.select(*(picked.get(c, F.col(c)) for c in rows.columns if c in keys or c in picked))


def version_conflicts(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(keys, rows, versions): keys whose rows differ. Equal rows are one version; nulls in keys are left out."""
    keys = list(keys)
    whole = rows.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    each = whole.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    return each.groupBy(*keys).agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("versions")).filter("versions > 1")


#: Rows of a range that are numbered together, as planned; bits of the hash that deal rows into ranges; ranges up to which
#: their offsets are broadcast.
RANGE_ROWS, USUAL_BITS, MOST_BITS, COARSE_BITS, BROADCAST_BITS = 1 << 17, 16, 30, 10, 16


def range_bits(rows: int | None) -> int:
    """Bits for ranges of about RANGE_ROWS rows at most, whatever the number of rows. If it is not known there are 65,536
    ranges, which is enough for 8 * 10^9 rows."""
    return USUAL_BITS if rows is None else min(MOST_BITS, (max(rows, 1) // RANGE_ROWS).bit_length() + 1)


def _offsets(counts: DataFrame, bits: int) -> DataFrame:
    """(__at, __before) from (__range, __n): the rows in ranges before each, by prefix sums in two levels."""
    counts = counts.withColumn("__coarse", F.shiftright("__range", max(bits - COARSE_BITS, 0)))
    above = Window.orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** COARSE_BITS rows
    coarse = counts.groupBy("__coarse").agg(F.sum("__n").alias("__all")).select("__coarse", F.coalesce(F.sum("__all").over(above), F.lit(0)).alias("__above"))
    earlier = Window.partitionBy("__coarse").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("__within", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(F.broadcast(coarse), "__coarse")
    found = within.select(F.col("__range").alias("__at"), (F.col("__above") + F.col("__within")).alias("__before"))
    return F.broadcast(found) if bits <= BROADCAST_BITS else found


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0, rows: int | None = None, bits: int | None = None) -> DataFrame:
    """Dense keys from start + 1, in an order that depends on the ``order`` columns only.

    Rows go in order of a hash of these: its top bits deal them into ranges, ranges are counted, and only the rows of
    a range are numbered together, so no task holds the table. The number of ranges follows the number of ``rows``, if
    the caller knows it (or is 2 ** ``bits``), and does not change the keys. Offsets are prefix sums in two levels: over at most 1,024 coarse
    ranges, and within each of them. Equal rows get neighbouring keys.
    """
    bits = range_bits(rows) if bits is None else bits
    h = F.xxhash64(*order)
    keyed = df.withColumns({"__h": h, "__range": F.shiftrightunsigned(h, 64 - bits)})
    counts = keyed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    within = Window.partitionBy("__range").orderBy("__h", *order)
    ranked = keyed.withColumn("__k", F.row_number().over(within))
    numbered = ranked.join(_offsets(counts, bits), F.col("__range") == F.col("__at"))
    return numbered.withColumn(name, (F.col("__before") + F.col("__k") + start).cast("long")).drop("__h", "__range", "__at", "__before", "__k")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], surrogate: str, newest: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``existing`` with the values of ``incoming`` where its key comes in, and new keys added.

    Of incoming rows that share a key one counts (see ``latest``). Surrogate keys stay; new ones follow the largest.
    Applied twice it gives the same rows and keys. ``keyed.KeyedTable`` does this to a stored table.
    """
    incoming = latest(incoming, keys, newest)
    values = [c for c in incoming.columns if c not in keys]
    new = incoming.select(*keys, F.struct(F.lit(1).alias("__x"), *(incoming[c] for c in values)).alias("__new"))
    both = existing.join(new, keys, "full_outer")
    merged = both.select(*keys, surrogate, *(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in values))
    kept, added = merged.filter(F.col(surrogate).isNotNull()), merged.filter(F.col(surrogate).isNull()).drop(surrogate)
    largest = existing.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("__largest"))
    fresh = number_rows(added, keys, surrogate).crossJoin(F.broadcast(largest)).withColumn(surrogate, F.col(surrogate) + F.col("__largest")).drop("__largest")
    return kept.unionByName(fresh.select(*kept.columns))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], surrogate: str, newest: tuple[str, ...] = ()) -> DataFrame:
    """``existing`` and, for each incoming key that it does not have, one row (see ``latest``)."""
    largest = existing.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("__largest"))
    absent = incoming.join(existing.select(*keys), keys, "left_anti")
    fresh = number_rows(latest(absent, keys, newest), keys, surrogate)
    fresh = fresh.crossJoin(F.broadcast(largest)).withColumn(surrogate, F.col(surrogate) + F.col("__largest"))
    return existing.unionByName(fresh.select(*existing.columns))


#: Keys that one row of a repeated row stands for at a time.
STRETCH = 100_000


def reload(incoming: DataFrame, surrogate: str) -> DataFrame:
    """A load without a key of its own, made repeatable: keys follow the content, so the same rows get the same keys.

    Equal rows are counted first and take neighbouring keys, a stretch at a time: a row may repeat any number of times.
    """
    columns = incoming.columns
    counted = incoming.groupBy(*columns).agg(F.count(F.lit(1)).alias("__times"))
    bits = range_bits(None)
    h = F.xxhash64(*columns)
    keyed = counted.withColumns({"__h": h, "__range": F.shiftrightunsigned(h, 64 - bits)})
    counts = keyed.groupBy("__range").agg(F.sum("__times").alias("__n"))
    within = Window.partitionBy("__range").orderBy("__h", *columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("__k", F.coalesce(F.sum("__times").over(within), F.lit(0)))
    first = ranked.join(_offsets(counts, bits), F.col("__range") == F.col("__at"))
    stretches = first.select(*columns, "__times", (F.col("__before") + F.col("__k") + 1).alias("__first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1, F.lit(STRETCH).cast("long"))).alias("__from"))
    steps = F.sequence(F.col("__from"), F.least(F.col("__from") + (STRETCH - 1), F.col("__times") - 1))
    return stretches.select(*columns, "__first", F.explode(steps).alias("__step")).select(*columns, (F.col("__first") + F.col("__step")).cast("long").alias(surrogate))
