"""Exact deduplication with streaming state.

A batch pass reduces every row to a digest, its identifier and a content
locator.  A Structured Streaming aggregation reads those rows and keeps, per
digest, the row that stays and the number of rows.  Its state lives in RocksDB on
the executors' disks, is written to the checkpoint folder with every batch and
never expires, so later arrivals can be checked against everything seen before.
Digests only propose: the full bytes behind a digest are compared, and texts that
differ under one digest are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.sources.storage import scratch_path

from .common import apply_copies, lower_ascii, stage, text_or_empty

#: Settings of the streaming query: state on disk, without preallocated files,
#: which many small state partitions would pay for with megabytes each; native memory
#: bounded for all stores of an executor, and given back soon after the query.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}
#: Files of digests that one micro-batch reads.
FILES_PER_BATCH = 1000


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_state(digests: DataFrame, checkpoint: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Fold a folder of ``(digest, doc_id, locator)`` rows into keyed state.

    ``digests`` is a streaming frame.  Running it again with the same
    ``checkpoint`` reads only new files.  Returns the state: ``digest``, ``keep``
    (struct of the largest ``doc_id`` and its ``locator``), ``n``.
    """
    spark = digests.sparkSession
    folded = digests.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        run = (
            folded.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return (
        spark.read.format("statestore")
        .load(checkpoint)
        .select(
            F.col("key.digest").alias("digest"),
            F.col("value.max").alias("keep"),
            F.col("value.count").alias("n"),
        )
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """One row per row of ``docs``: which row of its equal texts stays.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty.  Of equal texts the row with the largest id stays (null is smallest);
    of repeated ``(id, text)`` rows exactly one stays.  Returns ``doc_id``,
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``text_key`` (hash of
    the raw text, for :func:`keep_one`).  Other columns of ``docs`` are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        lower_ascii(plain).alias("norm"),
        F.xxhash64(plain).alias("text_key"),
    )
    path = scratch_path(spark, "digests")
    slim = rows.select(
        digest(F.col("norm")).alias("digest"),
        sha256_of(F.col("norm")).alias("text_sha256"),
        "doc_id",
        "text_key",
        F.monotonically_increasing_id().alias("locator"),
    )
    slim.write.parquet(path)
    seen = spark.read.schema(slim.schema).parquet(path)
    stream = (
        spark.readStream.schema(slim.schema)
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .parquet(path)
        .select("digest", "doc_id", "locator")
    )
    state = stage(digest_state(stream, scratch_path(spark, "digest-state")), "digest-groups")

    # Hits: smallest and largest text of a digest are the same bytes only if all
    # its texts are.  Map tasks merge copies first, so a group of any size costs
    # each task that shuffles it one row.
    unequal = stage(
        rows.groupBy(digest(F.col("norm")).alias("digest"))
        .agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        .where("low <> high")
        .select("digest"),
        "digest-collisions",
    )

    plain_rows = seen.join(
        state.select(F.col("digest").alias("d"), "keep", "n"), F.col("digest") == F.col("d")
    )
    if not unequal.take(1):
        out = plain_rows
    else:
        out = _split_collisions(seen, unequal)
    return out.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
        "text_sha256",
        "text_key",
    )


def _split_collisions(seen: DataFrame, unequal: DataFrame) -> DataFrame:
    """Groups by digest and differing content, when digests collide."""
    parts = seen.join(unequal.withColumnRenamed("digest", "ud"), F.col("digest") == F.col("ud"), "left")
    parts = parts.withColumn("part", F.when(F.col("ud").isNotNull(), F.col("text_sha256")).otherwise(""))
    groups = parts.groupBy("digest", "part").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    return parts.join(
        groups.withColumnsRenamed({"digest": "gd", "part": "gp"}),
        (F.col("digest") == F.col("gd")) & (F.col("part") == F.col("gp")),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    The row with the largest id stays, a null id only if the group has no other; of
    rows that repeat id and text, one.  A null text is equal to an empty one.  Very long
    texts are compared whole.  An empty table stays empty, and columns may have any
    names.
    """
    found = exact_groups(docs)
    copies = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("kept").cast("int")).alias("n_out")
    )
    return apply_copies(docs, copies)
