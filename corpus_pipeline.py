"""The corpus pipeline: documents to packed training sequences in four stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; all but the last return the columns of documents, whatever further
columns there are and whatever they are called.  Nulls in any column, empty and
very long texts, repeated rows and empty tables pass through as the docstrings
say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import contamination
from tidemark.llm.language import UNKNOWN, predict, train
from tidemark.llm.ngram_join import similar_documents
from tidemark.llm.packing import pack
from tidemark.llm.tokenize import tokenizer_path
from tidemark.session import table, written

#: Documents whose best language has less than this score are rejected.
MIN_SCORE = 0.5
#: Ids of removed documents that may be broadcast (8 bytes each); a shuffled join serves beyond.
BROADCAST_ROWS = 2_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; null, empty and letterless texts and uncertain ones go.

    The posterior of the best language must be MIN_SCORE at least, so ties of three
    languages go.  Whole texts of any length count; repeated rows are judged alike.
    Without any labelled row nothing can be identified and nothing stays.
    """
    found = predict(docs, train(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id; of rows with equal id and text one.

    Where ids are null or repeated, rows are numbered in order of id (null ones
    last) and text, and the row of the smallest number stays.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    key = "doc_id"
    columns = docs.columns
    if repeated.limit(1).count():
        key = "__row"
        ordered = docs.dropDuplicates(["doc_id", "text"]).orderBy(F.col("doc_id").asc_nulls_last(), F.sha2("text", 256))
        docs = written(ordered.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = similar_documents(docs, key, "text")
    gone = written(found.where("key <> component_id").select(F.col("key").alias(key)), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")
    return kept.select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: ten words in a row of an item, or a whole shorter item.

    Null and empty texts have no words and stay, as do all documents if the
    benchmark is empty.  Rows are judged one by one, so repeated and null ids do
    not matter.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, each with its ids.

    Every row is a document of its own, with repeated and null ids too; null and
    empty texts are the end id alone, and long ones fill sequences.
    """
    return pack(docs, tokenizer_path(), 1024, 0).withColumnRenamed("key", "doc_id")


STAGES = [("language", identify_language), ("near_duplicates", remove_near_duplicates), ("decontamination", decontaminate), ("packing", pack_sequences)]

#: Hashing, trees and tokenization are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
