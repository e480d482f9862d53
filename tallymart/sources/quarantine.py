"""Reading CSV files with a quarantine: every record ends up in exactly one of two tables.

Files are read as text with the declared columns. A record is kept if it has as many fields as there are columns and
every field parses as its declared type; null tokens are nulls, not errors. All others are rejected, with their file,
their text and the reasons. Kept and rejected records are written by one query, and their numbers are observed metrics of
it: what a record is does not depend on which columns a later query asks for.

Defined results: an empty file has no records; a field that is missing or too many rejects the record; quoted line breaks
and doubled quotes belong to their field; a record that lacks its closing quote takes what follows with it; a header, if
declared, is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions import columns as C
from tallymart.sources import tables
from tallymart.specs import NULL_TOKENS, DatasetSpec

CORRUPT = "__corrupt"
FIELDS = "wrong number of fields"


@dataclass(frozen=True)
class Ingested:
    """``kept``: typed rows; ``rejected``: (file, record, reasons); and how many there are of each."""

    dataset: str
    kept: DataFrame
    rejected: DataFrame
    n_kept: int
    n_rejected: int

    def check(self) -> DataFrame:
        """A check row: rejected records fail it."""
        spark = self.kept.sparkSession
        row = (f"DQ-LOAD-{self.dataset}", self.dataset, "__DATASET__", "Validity", "every record can be read", "0 failing rows", "HIGH", self.n_rejected, self.n_kept + self.n_rejected)
        return spark.createDataFrame([row], "test_id string, dataset string, `column` string, quality_dimension string, rule string, expected string, declared string, failed bigint, total bigint")


def _typed(name: str, kind: str) -> tuple[Column, str]:
    """A field as its type, and what is wrong if it does not parse."""
    c = F.col(name)
    c = F.when(~c.isin(*NULL_TOKENS), c)
    if kind == "integer":
        return C.to_integer(c), "not a whole number"
    if kind == "numeric":
        return C.to_number(c), "not a number"
    if kind == "datetime":
        return F.try_to_timestamp(c).cast("timestamp_ntz"), "not a timestamp"
    return c, ""


def ingest_csv(spark: SparkSession, paths: str | list[str], spec: DatasetSpec, base: str, header: bool = True) -> Ingested:
    """Reads CSV files and writes ``base``/kept and rejected records side by side."""
    schema = T.StructType([*tables.as_text(spec).fields, T.StructField(CORRUPT, T.StringType())])
    read = spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    raw = read.csv(paths).select("*", F.col("_metadata.file_name").alias("__file"))
    names = list(spec.columns)
    typed = {c: _typed(c, kind) for c, kind in spec.columns.items()}
    bad = [F.when(value.isNull() & F.col(c).isNotNull() & ~F.col(c).isin(*NULL_TOKENS), F.lit(f"{c}: {wrong}")) for c, (value, wrong) in typed.items() if wrong]
    reasons = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit(FIELDS))).otherwise(F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*names)))
    judged = raw.select(*(value.alias(c) for c, (value, _) in typed.items()), F.col("__file"), reasons.alias("__reasons"), record.alias("__record"))
    judged = judged.withColumn("__record", F.when(F.size("__reasons") > 0, F.col("__record"))).withColumn("__rejected", F.size("__reasons") > 0)
    counted = Observation()
    judged.observe(counted, F.count_if(~F.col("__rejected")).alias("kept"), F.count_if(F.col("__rejected")).alias("rejected")).write.partitionBy("__rejected").parquet(base)
    whole = T.StructType([f for f in judged.schema.fields if f.name != "__rejected"])
    part = lambda flag: spark.read.schema(T.StructType([*whole.fields, T.StructField("__rejected", T.BooleanType())])).parquet(base).filter(F.col("__rejected") == flag)
    got = counted.get
    return Ingested(spec.name, part(False).select(*names), part(True).select(F.col("__file").alias("file"), F.col("__record").alias("record"), F.col("__reasons").alias("reasons")), got.get("kept") or 0, got.get("rejected") or 0)
