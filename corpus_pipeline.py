"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``, others that ``docs`` has included, under any
names.  An empty table stays empty in every stage, and texts of any length are read
whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import exact, mixing, neardup, packing, toxicity
from panelspark.llm.common import stage, table
from panelspark.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not judged toxic.

    A null text counts as empty and stays; rows with equal texts share their fate, so
    repeated rows do; a score of exactly 0.5 is toxic.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id.

    A null text equals an empty one; a null id is smaller than all others; of rows that
    repeat id and text one stays.
    """
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id.

    Null, empty and other texts without words are classes only if they are equal; a null
    id stays only where there is no other; of rows that repeat id and text one stays.
    """
    return neardup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; null and empty texts have size 0; equal sizes are told
    apart by a seeded hash; repeated rows share what is taken of them.
    """
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences.

    A null or empty text is its end id alone; repeated rows and null ids are documents of
    their own; of equally tight sequences the one opened first is filled.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL: a learned classifier, sketches and a packing are not SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
