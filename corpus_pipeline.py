"""A training corpus from ``documents``, stage by stage.

Every stage works on all that the one before it kept, is written as Parquet and
read again; all but the last return the columns of documents, and further
columns that the table has, whatever their names.  An empty table gives an empty
one in every stage, and texts of any length are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, exact_dedup, mixing, quality, simhash
from tessella.llm.common import documents, remove, scratch, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it learns from their labels.

    Null and empty texts are judged like a text of nothing, repeated rows alike;
    without labels all have one score, 0.5, and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, quality.train(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest doc_id.

    A null text is the empty one; a null doc_id comes last; of rows that share
    doc_id and text one stays.
    """
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that with the smallest doc_id.

    Texts without a word have fingerprint zero and link like any other; of
    several rows of that doc_id the one with the smallest hash stays, as in a
    group of null doc_ids.
    """
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes, as documents; a document taken twice gives two rows.

    Texts without a word are never taken; a null source is one more source, and
    rows that share a doc_id are documents of their own.
    """
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, written to a folder corpus-ids-* of the shared one, and digests of them and of what they decode to.

    The digests are of the ids read back.  Null and empty texts have none; each
    row of docs gives a row.
    """
    ranks, path = public_tokenizers.path("byte_bpe_50k.tiktoken"), f"{shared_dir(spark)}/corpus-ids-{uuid.uuid4().hex}"
    byte_bpe.encode(docs.select("doc_id", "source", "lang", "text"), ranks, public_tokenizers.PATTERN).drop("text").write.parquet(path)
    coded = byte_bpe.decode(spark.read.parquet(path), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(coded, "source", "lang", F.lit(path).alias("ids_path"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: The classifier and the fingerprints can't be told in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what stages write for themselves goes when they have ended, their rows when the next stage has."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
