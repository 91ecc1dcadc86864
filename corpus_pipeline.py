"""A training corpus from raw documents: five stages, each one operator.

All stages but the last return the columns they get, in order, whatever other columns there are and however these are
called. An empty table gives an empty one with these columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language_id, minhash_dedup, mixing, packing, secret_scan
from lodestone.llm._spark import bounded_batches, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that have a model stay, however many of these they mix.

    Those go whose text is null, has no letter, or is explained no better by its languages than by noise. A null id,
    source or language decides nothing. Very long texts are judged whole; repeated rows stay or go together. Without
    any labelled row there is no model, and all go.
    """
    bounded_batches(spark)
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    return language_id.accept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    A text without words is a group of its own, as is any row with a null id. Of repeated rows of one id the first
    by text stays. Very long texts are compared whole.
    """
    bounded_batches(spark)
    return minhash_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked.

    Null and empty texts stay as they are, very long ones are scanned whole, repeated rows are masked alike. Where
    secrets overlap, one mask takes the place of all.
    """
    bounded_batches(spark)
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, up to three times, or left out so that sources meet their target weights.

    A null source is one of its own. Texts that are null or without words take nothing and go. Rows with a null or repeated id
    take the copies of their own source; ties go by a hash of the id, then by text.
    """
    bounded_batches(spark)
    return mixing.resample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into windows of 1024: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Very long texts are tokenized whole and cut; repeated rows,
    and rows with a null id, are packed each.
    """
    bounded_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixture),
    ("packing", sequences),
]

#: The last stage's tokenizer has no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
