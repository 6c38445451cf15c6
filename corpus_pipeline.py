"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage gets all documents that the one before kept, as a table that was written and read
again, and returns their columns; the last returns the packed pieces. Documents that fail the
quality rules go, so do all but one of a group of near duplicates and those that hold a
benchmark passage; secrets are replaced in the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulmark.llm.common import keep, ship, table
from haulmark.llm.decontaminate import drop_contaminated
from haulmark.llm.near_dedup import keep_first
from haulmark.llm.packing import pack
from haulmark.llm.quality import keep_good
from haulmark.llm.queries import tokenizer_file
from haulmark.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs, tokenizer_file())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: The perplexity bands and the components of near duplicates have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
