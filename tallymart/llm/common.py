"""What the operators of this subpackage share: reading, cutting lineage, Arrow helpers."""

from __future__ import annotations

import ctypes
import glob
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A word of the contracts: a run of anything but space and U+0009 to U+000D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: str.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = {ord(c): ord(c.lower()) for c in UPPER}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


class Cut:
    """Cuts lineage with Parquet tables in the shared folder, and deletes those that a later round has replaced.

    ``cut(df)`` writes and rereads; ``cut.drop(df)`` removes the files of a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.cut_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "cut_path", "")
        if path.startswith(self.base):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def hashed_sample(df: DataFrame, key: str, salt: str, most: int) -> DataFrame:
    """About ``most`` rows, those of small hashes of the key (rows that share a key hash alike, so the caller bounds what
    it takes to the driver). A filter: rows that are left out move nowhere, and no task sees them all."""
    share = most / max(df.count(), 1)
    h = F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 31) - 1))
    return df if share >= 1 else df.filter(h < int(share * (1 << 31)))


def one_blas_thread() -> None:
    """Keeps numpy's products in this worker to one thread. A worker has one task, tasks fill the cores already, and
    small products on many threads only burn time. Where numpy brings no OpenBLAS of its own, nothing is done."""
    for path in glob.glob(f"{os.path.dirname(np.__file__)}.libs/*openblas*"):
        found = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(found, name):
                getattr(found, name)(1)
                break


def give_back() -> None:
    """Hands memory that a task no longer uses back to the system. Workers live on from stage to stage, and what one stage
    has needed at its peak would otherwise stay with them. Where the C library has no such call, nothing is done."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores after it as it takes to clash with no column of ``df``. Columns whose names
    differ in case only clash, too, as they do in Spark."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def position(df: DataFrame, name: str) -> int:
    """Where a column stands; its name is looked up as Spark does, in any case."""
    at = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not at:
        raise ValueError(f"no column {name}")
    return at[0]


def plain_names(df: DataFrame) -> DataFrame:
    """Columns called c0, c1 and so on: mapInArrow takes no dots in the names of its input."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def beside(df: DataFrame, needed: dict[str, str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``df`` unchanged, then those that ``work`` adds, each under a free name.

    ``work`` sees one column ``_row`` that holds the whole input, which it hands on, and ``needed`` columns under names
    of its own ({name: column of df}); so its working columns can have any names.
    """
    own = [F.struct(*(quoted(c).alias(f"c{k}") for k, c in enumerate(df.columns))).alias("_row")]
    out = work(df.select(*own, *(quoted(df.columns[position(df, c)]).alias(name) for name, c in needed.items())))
    new = [c for c in out.columns if c != "_row" and c not in needed]
    return out.select(*(F.col("_row")[f"c{k}"].alias(c) for k, c in enumerate(df.columns)), *(F.col(c).alias(free_name(df, c)) for c in new))


def map_column(df: DataFrame, source: str, target: str, kind: pa.DataType, sql_type: str, make: Callable[[], Callable[[list], list | pa.Array]], rows: int = 256, arrow: bool = False) -> DataFrame:
    """Adds ``target`` = f(``source``) by Arrow batches; every other column passes through untouched. If the name is
    taken, the new column has the one that ``free_name`` gives.

    make() is called once in each task and returns the function over a list of values (with ``arrow``: over the Arrow
    array). Batches go in slices of ``rows`` rows, so that long texts do not pile up.
    """
    target, at = free_name(df, target), position(df, source)
    schema = StructType([*(StructField(f.name, f.dataType) for f in df.schema.fields), StructField(target, DataType.fromDDL(sql_type))])
    names = [*df.columns, target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                out = f(batch.column(at) if arrow else batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, out if isinstance(out, pa.Array) else pa.array(out, kind)], names=names)
        give_back()

    return plain_names(df).mapInArrow(run, schema)
