"""From raw documents to packed sequences: the stages, and the run over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.llm.common import forget, stored
from logsluice.llm.exactdedup import drop_exact_duplicates
from logsluice.llm.langid import keep_identified
from logsluice.llm.mixing import mix_rows
from logsluice.llm.neardup import near_duplicates
from logsluice.llm.packing import pack_documents

# A document goes when its language is undecided, or when less than this share of its
# words is in one language.
LEAST_SCORE = 0.34


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a null ``lang`` is filled with the one found."""
    return keep_identified(docs, LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; all without words stay."""
    found = near_duplicates(docs)
    # All rows of an id are kept or dropped, and a null id is kept. The ids to drop are mostly the fewer ones,
    # and few enough are broadcast, so that the texts stay where they are.
    dropped = stored(found.where("NOT kept").select(F.col("doc_id").alias("__id")).distinct(), "near-dropped")
    forget(found)
    return docs.join(dropped, docs["doc_id"] == dropped["__id"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which the sources keep their target weights."""
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; neighbours in the mixed order are packed together."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# A language model and a tokenizer take part, which SQL cannot express; the tests
# compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written, read again, and removed after the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(last)
        last = docs
    return docs
