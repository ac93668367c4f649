"""The queries of this subpackage, one for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokenize import tokenizer_path
from tidemark.session import table


def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.packing import pack

    pieces = pack(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path(), 1024, 0)
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Shards and slots of op2_shard: slots are a prime of over sixty times the shards.
SHARDS, SLOTS = 64, 4099


def op2_shard(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.sharding import place

    return place(table(spark, folder, "documents").select("doc_id"), "doc_id", [f"shard-{i:05d}" for i in range(SHARDS)], SLOTS)


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm import warc

    archives = warc.write(table(spark, folder, "pages").select("page_id", "url", "html"))
    records = warc.read(spark, archives, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string", verify=True)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:record:(.*)>$", 1), F.lit("")).cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op4_similar(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.ngram_join import similar_documents

    return similar_documents(table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("key", "doc_id")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.token_counts import n_tokens, token_counts

    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts(docs, tokenizer_path(), keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", n_tokens().alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > 512)


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.language import held_out, predict, train

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=["doc_id", "held_out"])


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm import token_files

    files = token_files.write(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path(), 0)
    return token_files.read(spark, files, ids=False).withColumnRenamed("key", "doc_id")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.decontaminate import contamination, n_hit

    found = contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), keep=["doc_id"])
    digests = found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return digests.withColumn("contaminated", F.col("n_hit") > 0)


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.fingerprints import fingerprints_of_edits

    return fingerprints_of_edits(table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("key", "doc_id")


def op10_extract(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.html import extract_text

    texts = extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The records of op3_warc.
WARC_SQL = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
    FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {f.__name__: f for f in (op1_pack, op2_shard, op3_warc, op4_similar, op5_token_counts, op6_language, op7_token_files, op8_decontaminate, op9_fingerprints, op10_extract)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import sharding

    return {"op2_shard": sharding.oracle("documents", "doc_id", SHARDS, SLOTS), "op3_warc": WARC_SQL}
