"""A training-data pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

For every stage: a null text reads as empty; a null doc_id, lang or source is a value of its own; texts of any length are read whole; repeated rows are
rows each, unless the stage says so; ties are broken by values, never by the order of rows; an empty table gives an empty one; other columns, whatever
their names and types, stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, secrets, sentencepieces, simhash
from tidemark.llm.common import bounded_batches, drop_folder, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or without a text, go."""
    bounded_batches(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (sets of five-word shingles, similarity 0.8, linked directly or by others), the one with the smallest
    id, none last. Different texts under one id are documents each; of rows that repeat an id and a set of shingles one stays."""
    bounded_batches(spark)
    return simhash.keep_one_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced, and n_chars of those that changed; a document is a repository, its source the owner."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it has copies; rows that repeat an id are drawn together."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the mix in pieces of the vocabulary."""
    bounded_batches(spark)
    out = sentencepieces.encode_decode(docs.select("doc_id", "lang", "source", "text"), keep_text=False)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The stages need hashes, trained profiles and a tokenizer that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Tables go to the folder that the cluster shares; each goes once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            drop_folder(spark, before)
        before = out
    return docs
