"""The registered queries: each applies one operator, with its production
parameters, to the whole of its table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import _spark, bpe, decontam, html, langid, lm, minhash, quality, rules, sharding, warc
from terravane.llm.oracles import ORACLE_SQL


__all__ = ["ORACLE_SQL", "QUERIES"]


def tokenizer_path() -> str:
    """The public byte-level vocabulary; TERRAVANE_TOKENIZER names another file."""
    import public_tokenizers

    return os.environ.get("TERRAVANE_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_spark.table(spark, sf_dir, "documents"), tokenizer_path())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.shard_documents(_spark.table(spark, sf_dir, "documents"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return written.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_spark.table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_spark.table(spark, sf_dir, "documents"), width=2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_spark.table(spark, sf_dir, "documents"), _spark.table(spark, sf_dir, "benchmark"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_spark.table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_spark.table(spark, sf_dir, "pages"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_spark.table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_spark.table(spark, sf_dir, "documents"), _spark.table(spark, sf_dir, "labels"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(_spark.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_lm, op4_minhash, op5_decontamination, op6_rules, op7_warc, op8_quality, op9_html, op10_langid)}
