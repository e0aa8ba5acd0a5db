"""A corpus pipeline of five operators, from raw documents to token ids.

Stages, in order: documents that the quality classifier predicts to be bad go;
documents without a language go; of each group of near copies (5-word shingles,
similarity 0.8) the one with the smallest id stays; documents that hold a
benchmark item go; what is left is encoded.  All stages but the last return the
columns of ``documents``, further ones included, whatever their names.

A null text is classified like an empty one and has no language; a row with a null
id is judged by its text, is near to nothing and stays.  Repeated rows share their
fate, except that one row of each id stays after the near copies.  Texts of any
length are read whole; equal scores and ties are resolved as each operator states.
An empty table goes through all stages empty.  Rows are dropped for no other reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravane.llm import _spark, bpe, decontam, langid, minhash, quality
from terravane.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _spark.table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _spark.ship(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _spark.ship(spark)
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, _spark.table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _spark.ship(spark)
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can't express the classifier or the language model; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each result is written and read again."""
    docs = _spark.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = _spark.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
