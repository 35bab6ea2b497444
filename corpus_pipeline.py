"""A training corpus from raw documents: quality rules, near duplicates, personal data, mixing, token ids.

Each stage reads what the one before it wrote.  All but the last return the columns of documents; columns besides
those are dropped, whatever their names.  An empty table goes through every stage as an empty one, rows with null ids or
texts are rows like others, and equal rows stay as many unless a stage says otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import personal_data, quality_rules, sentencepiece_codec, shingle_join, source_mixing
from weftline.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor a learned rule rejects; null and empty texts fail the base rules."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Rows of one id count as one document and stay together.  A row without an id can't be named, so it stays; null and
    empty texts are no copies of each other.
    """
    part = shingle_join.components(docs)
    others = part.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each personal identifier covered by its kind; n_chars follows the text (null texts keep theirs)."""
    covered = personal_data.redact(docs)
    return covered.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights, in a global shuffle; a null source is one of its own."""
    return source_mixing.replicate(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every repeated document; null and empty texts have no ids."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("personal_data", private), ("source_mixing", mixed), ("sentencepiece", tokens)]
#: SQL can't express the learned rules, the near copies and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the whole of documents; all but the last are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
