"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.storage import drop_path, scratch_path

#: Rows with whole texts, or all their words, that travel to Python at a time.
BATCH_ROWS = 500
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks it ran, not the work
    before them, and values such as row numbers stay as first written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs run inside send ``rows`` rows to Python at a time, or fewer if the session says so.

    A batch is held several times over, outside the heap and in the worker, by every
    task.  Settings count when a job runs, so only what is written inside is affected.
    """
    before = spark.conf.get(_ROWS_SETTING)
    if not 0 < int(before) <= rows:
        spark.conf.set(_ROWS_SETTING, rows)
    try:
        yield
    finally:
        spark.conf.set(_ROWS_SETTING, before)


class Stages:
    """Stage tables of one job, deleted as soon as the last reader has run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((written, path))
        return written

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete the tables of ``frames``; no plan that is still to run may read them."""
        for path in [p for df, p in self.paths if any(df is f for f in frames)]:
            drop_path(self.spark, path)
        self.paths = [(df, p) for df, p in self.paths if not any(df is f for f in frames)]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What tells rows apart: id and text.  Rows equal in both are repeats."""
    return [
        F.col(id_col).alias("_id"),
        F.xxhash64(text_or_empty(text_col)).alias("_text_key"),
    ]


def apply_copies(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` as often as ``copies`` says.

    ``copies`` has one row per ``(_id, _text_key)`` with ``n_rows`` (repeats in
    ``docs``) and ``n_out`` (rows wanted over all of them).  Repeats are merged
    before they are multiplied; which of their other columns stay is not fixed.
    The columns of ``docs`` are returned unchanged.
    """
    # A row travels as one struct, so that its columns may have any name.
    keyed = docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_doc"),
        F.xxhash64(text_or_empty()).alias("_key"),
    )

    def chosen(times: Column) -> DataFrame:
        wanted = copies.where((F.col("n_out") > 0) & times).select("_id", "_text_key", "n_out")
        same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key"))
        return keyed.join(wanted, same)

    alone = chosen(F.col("n_rows") == 1).select("_row", "n_out")
    merged = chosen(F.col("n_rows") > 1).dropDuplicates(["_doc", "_key"]).select("_row", "n_out")
    return (
        alone.unionByName(merged)
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("n_out").cast("int"))))
        .select("_row.*")
    )
