"""Stored tables with one row a key, changed by merges.

Rows lie in buckets by a hash of their key. A merge reduces what comes in to one row a key, looks only at the buckets of
these keys, and writes only buckets in which a row is new or changed, as new files. A version file names the folder of
every bucket; it is created last, under the next number, and must not be there yet. So readers see a whole version, a
merge that dies leaves the table as it was, of two merges at once one fails, and a merge that changes nothing writes
nothing.

Defined results: rows with a null in their key are left out; of rows that share a key the one with the largest ``newest``
columns counts, nulls first, then the one of the largest row hash, so the order of rows does not matter; an empty merge
changes nothing; the columns of a table are those of its first merge, in any order afterwards.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.sources import files, tables


@dataclass(frozen=True)
class Merged:
    """What a merge did. Without a change the version and the number of buckets written stay."""

    version: int
    inserted: int
    updated: int
    buckets_read: int
    buckets_written: int


class MergeConflict(RuntimeError):
    """Another merge has made this version first; merging again works on what it left."""


class KeyedTable:
    """A keyed table in a folder. ``buckets`` decides how much a merge reads and rewrites at least; it is fixed when the
    table is created, and one task writes a bucket, so large tables want many."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = files.names(spark, f"{path}/_versions")
        if not found:
            raise FileNotFoundError(f"no keyed table in {path}")
        self.state = json.loads(files.read_text(spark, f"{path}/_versions/{found[-1]}"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, keys: Iterable[str], surrogate: str | None = None, buckets: int = 64) -> KeyedTable:
        state = {"version": 0, "keys": list(keys), "surrogate": surrogate, "buckets": buckets, "largest": 0, "columns": None, "at": {}}
        if not files.create_text(spark, _version_file(path, 0), json.dumps(state)):
            raise FileExistsError(f"{path} holds a keyed table")
        return cls(spark, path)

    @property
    def version(self) -> int:
        return self.state["version"]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the present one if none is named."""
        state = self.state if version is None else json.loads(files.read_text(self.spark, _version_file(self.path, version)))
        return self._rows(state, state["at"])

    def _rows(self, state: dict, buckets: Iterable[str]) -> DataFrame:
        if state["columns"] is None:
            raise ValueError(f"{self.path} has no rows yet, so no columns")
        schema = T.StructType.fromJson(state["columns"])
        folders = [f"{self.path}/{state['at'][b]}" for b in buckets if b in state["at"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @property
    def note(self) -> dict:
        """What the merge that made this version was told to remember."""
        return self.state.get("note") or {}

    def changed_since(self, version: int) -> tuple[DataFrame, DataFrame]:
        """The rows of those buckets that a later merge has written, as they were and as they are. The version must not
        have been vacuumed."""
        before = json.loads(files.read_text(self.spark, _version_file(self.path, version)))
        buckets = [b for b, folder in self.state["at"].items() if before["at"].get(b) != folder]
        return self._rows(before | {"columns": self.state["columns"]}, buckets), self._rows(self.state, buckets)

    def merge(self, incoming: DataFrame, newest: Iterable[str] = (), insert_only: bool = False, note: dict | None = None) -> Merged:
        """Takes rows over: new keys are added with new surrogate keys after the largest; of known keys values are
        replaced and surrogate keys stay, or nothing happens (``insert_only``). ``newest`` columns that the table does
        not have only order what comes in."""
        s, spark = self.state, self.spark
        keys, surrogate = s["keys"], s["surrogate"]
        known = T.StructType.fromJson(s["columns"]).fieldNames() if s["columns"] else incoming.columns
        values = [c for c in known if c not in keys and c != surrogate]
        order = [c for c in newest if c not in values]
        one = tables.latest(incoming.select(*keys, *values, *order), keys, newest, keep_newest=True).drop(*order)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(s["buckets"])).cast("int")
        staged = tables.stage({"new": one.withColumn("__bucket", bucket)})
        try:
            return self._merge(staged["new"], values, insert_only, note)
        finally:
            tables.discard(spark, staged)

    def _merge(self, new: DataFrame, values: list[str], insert_only: bool, note: dict | None) -> Merged:
        s, spark = self.state, self.spark
        keys, surrogate = s["keys"], s["surrogate"]
        touched = [str(r[0]) for r in new.select("__bucket").distinct().collect()]  # at most ``buckets`` rows
        schema = T.StructType.fromJson(s["columns"]) if s["columns"] else T.StructType([*([T.StructField(surrogate, T.LongType())] if surrogate else []), *(f for f in new.schema.fields if f.name != "__bucket")])
        old = self._rows(s | {"columns": json.loads(schema.json())}, touched)
        was = old.select(*keys, *([F.col(surrogate).alias("__key")] if surrogate else []), F.lit(True).alias("__there"), F.struct(F.lit(0), *(F.col(c) for c in values)).alias("__was"))
        met = new.join(was, keys, "left")
        change = F.col("__there").isNull() if insert_only else F.col("__there").isNull() | ~F.col("__was").eqNullSafe(F.struct(F.lit(0), *(F.col(c) for c in values)))
        staged = tables.stage({"changed": met.filter(change).drop("__was")})
        try:
            changed = staged["changed"]
            counted = {r["__bucket"]: (r.added, r.n) for r in changed.groupBy("__bucket").agg(F.count_if(F.col("__there").isNull()).alias("added"), F.count(F.lit(1)).alias("n")).collect()}
            if not counted:
                return Merged(self.version, 0, 0, len(touched), 0)
            added = sum(a for a, _ in counted.values())
            rows = changed.drop("__there")
            if surrogate:
                fresh = tables.number_rows(changed.filter("__there IS NULL").drop("__there", "__key"), keys, surrogate, s["largest"], added)
                rows = changed.filter("__there").drop("__there").withColumnRenamed("__key", surrogate).unionByName(fresh)
            kept = self._rows(s | {"columns": json.loads(schema.json())}, map(str, counted)).join(changed.select(*keys), keys, "left_anti")
            bucket = F.pmod(F.xxhash64(*keys), F.lit(s["buckets"])).cast("int")
            whole = kept.withColumn("__bucket", bucket).unionByName(rows.select(*kept.columns, "__bucket"))
            folder = f"v{self.version + 1}-{uuid.uuid4().hex}"  # of this merge alone
            whole.repartition(min(len(counted), 4096), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
            after = s | {"version": self.version + 1, "largest": s["largest"] + added, "columns": json.loads(schema.json()), "note": note or s.get("note"), "at": s["at"] | {str(b): f"{folder}/__bucket={b}" for b in counted}}
            if not files.create_text(spark, _version_file(self.path, after["version"]), json.dumps(after)):
                files.delete(spark, f"{self.path}/{folder}")
                raise MergeConflict(f"version {after['version']} of {self.path} is there already")
            self.state = after
            return Merged(self.version, added, sum(n for _, n in counted.values()) - added, len(touched), len(counted))
        finally:
            tables.discard(spark, staged)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes versions but the last ``keep``, and files that none of the kept ones names."""
        versions = files.names(self.spark, f"{self.path}/_versions")
        states = [json.loads(files.read_text(self.spark, f"{self.path}/_versions/{v}")) for v in versions[-keep:]]
        used = {folder for s in states for folder in s["at"].values()}
        for v in versions[:-keep]:
            files.delete(self.spark, f"{self.path}/_versions/{v}")
        for top in files.names(self.spark, self.path):
            if top.startswith("v"):
                for part in files.names(self.spark, f"{self.path}/{top}"):
                    if part.startswith("__bucket=") and f"{top}/{part}" not in used:
                        files.delete(self.spark, f"{self.path}/{top}/{part}")


def _version_file(path: str, version: int) -> str:
    return f"{path}/_versions/{version:012d}.json"
