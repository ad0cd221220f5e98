"""One thin query per operator over the whole ``documents`` or ``embeddings`` table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, centroids, descent, exact_dedup, id_store, lattice, mixing, quality, sharding, simhash, sketch, substring, vector_codes
from tessella.llm.common import documents
from tessella.llm.vectors import embeddings

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_lattice(spark, sf_dir):
    return lattice.score(documents(spark, sf_dir), PIECES)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_mixing(spark, sf_dir):
    return mixing.taken_words(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_sketch(spark, sf_dir):
    return sketch.neighbours_fingerprinted(documents(spark, sf_dir))


def op6_id_store(spark, sf_dir):
    return id_store.digests(id_store.stored(documents(spark, sf_dir), TOKENIZER, public_tokenizers.PATTERN, added_tokens=True))


def op7_byte_bpe(spark, sf_dir):
    coded = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).drop("text")
    return byte_bpe.digests(byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN))


def op8_simhash(spark, sf_dir):
    return simhash.digest_columns(simhash.near_duplicates(documents(spark, sf_dir)))


def op9_substring(spark, sf_dir):
    return substring.summary(documents(spark, sf_dir))


def op10_quality(spark, sf_dir):
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.digests(*vector_codes.trained(embeddings(spark, sf_dir)))


def op12_centroids(spark, sf_dir):
    return centroids.clusters(embeddings(spark, sf_dir))


def op13_descent(spark, sf_dir):
    return descent.nearest(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_lattice, op2_exact_dedup, op3_mixing, op4_sharding, op5_sketch, op6_id_store, op7_byte_bpe, op8_simhash, op9_substring, op10_quality, op11_vector_codes, op12_centroids, op13_descent)}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op9_substring": substring.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_centroids": centroids.ORACLE}
