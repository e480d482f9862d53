"""A training-data pipeline over ``documents``: STAGES in order, each stage's result written as Parquet and read again.

Every stage works on all rows that the one before kept. All but the last return the columns of documents:

1. quality: documents that fail a rule of the policy ``prose-1`` go.
2. near_dedup: one document of each SimHash group (shingles of five words) stays, the one of the smallest id.
3. pii: personal data gives way to marks such as <EMAIL>; n_chars follows the text.
4. mixing: rows come in the mixed order of their sources (every row once), which the written files keep.
5. encoding: token ids of the texts, checked by decoding them again. The order that mixing gave is read from where each
   row stands in the files (mix_file, mix_row) and stays in the result; both are null if the input is no files, mix_file
   also if a file's name is none that Spark gives.

Defined results: a null text has no words and goes at the first stage; null ids, sources and languages stay as they
are; of rows that repeat each other one stays; an empty table gives an empty result. Further columns pass through all stages
but the last unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import bpe, mixing, pii, quality, simhash
from tallymart.llm.common import Cut, free_name, quoted, table

#: No SQL: fingerprints, spans and token ids are beyond it. tests/llm/test_pipeline.py holds a plain version against it.
ORACLE_SQL = None


def file_number() -> Column:
    """The number of a file that Spark has written: its task's number, then its own among those of the task (it can be
    one of many); null for files of other names."""
    task, nth = (F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("bigint") for pattern in ("^part-(\\d+)-", "-c(\\d+)[.]"))
    return task * 1_000_000 + F.coalesce(nth, F.lit(0))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "quality")
    judged = quality.ledger(docs, target=name)
    return judged.filter(quality.passes("prose-1", F.col(name)["fail_bits"])).select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "pii")
    clean = pii.redact(pii.find(docs, spans=name), spans=name)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    narrow = ["doc_id", "lang", "source", "text"]
    try:
        placed = docs.select(*narrow, file_number().alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
        placed.schema
    except AnalysisException:  # no files: there is no order to keep
        placed = docs.select(*narrow, F.lit(None).cast("bigint").alias("mix_file"), F.lit(None).cast("long").alias("mix_row"))
    return bpe.round_trip(placed).select(
        "doc_id",
        "lang",
        "source",
        "mix_file",
        "mix_row",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
        "ids",
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Tables between stages lie in the shared folder; each goes when the next is there."""
    cut, docs = Cut(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        written = cut(stage(spark, docs, sf_dir))
        cut.drop(docs)
        docs = written
    return docs
