"""The registered queries of this subpackage, over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, exact, lexical, lm, mixing, neardup, packing, secrets, sharding, spm, toxicity, urls
from .common import table
from .sql import ORACLE

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_key")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents")).drop("text_key")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the source; repository: a source's documents of one language."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), ["source", "lang"], ["source"])
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(secrets.in_order(F.concat("base", "added"))).alias("spans"),
        "n_example",
        "n_live",
        "n_shared",
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = spm.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_near_dedup,
        op3_sharding,
        op4_toxicity,
        op5_exact_dedup,
        op6_secrets,
        op7_lm_score,
        op8_nearest,
        op9_packing,
        op10_url_filter,
        op11_filter_audit,
        op12_lexical_search,
        op13_sentencepiece,
    )
}

__all__ = ["ORACLE", "QUERIES"]
