"""The pipeline that makes training sequences of the documents: five operators, each over all that the one before kept.

Columns of documents of any names come along to the last stage. A null doc_id, lang or source is a value like others. An
empty table stays empty in each stage. Documents without words, null texts too, fail the base rules of the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.mixing import mixed_documents
from quarry.llm.near_dedup import near_classes
from quarry.llm.packing import pack_documents
from quarry.llm.quality import verdicts
from quarry.llm.queries import tokenizer_path
from quarry.llm.shared import cut
from quarry.llm.suffix_dedup import dedup_suffixes


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that share doc_id and text with a row (doc_id, th) of gone; docs has any other columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"))
    same = F.col("rest.doc_id").eqNullSafe(F.col("doc_id")) & (F.hash("rest.text") == F.col("th"))
    kept = rows.join(gone.select("doc_id", "th"), same, "left_anti")
    return kept.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows that repeat a document share its verdict."""
    return without(docs, verdicts(docs).where(~F.col("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id (null last); rows of that doc_id and text stay together."""
    return without(docs, near_classes(docs).where(~F.col("kept")))


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that start earlier; what has no other words goes.

    A text without such passages stays as it is; of others the words left are joined by one space.
    """
    out = dedup_suffixes(docs, passage=50, carry=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.where("n_removed = 0 or n_removed < n_words").select(*[columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document that the mix of sources takes, with the white space between them; what is taken twice follows."""
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens; repeated rows are documents of their own."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), length=2048)


STAGES = [("quality_rules", quality), ("near_dedup", near), ("suffix_dedup", suffixes), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Estimates, alignments and draws are beyond SQL; the tests compare stages with plain versions.
ORACLE_SQL = None
