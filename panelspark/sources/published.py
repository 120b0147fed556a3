"""Tables that are replaced whole or not at all, and checked by the job that writes them.

A new version is written beside the old one.  Its rows are counted and its rules
evaluated by metrics of that very job, nothing is scanned again.  Only when all is well
does one pointer move to it; readers follow the pointer, so a write that fails, or
breaks a rule, leaves the last version readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators.quality import Rule, RuleViolation
from .storage import drop_path

_POINTER = "_current"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    where = _path(spark, path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed over the old file in one step."""
    conf, fresh = spark._jsc.hadoopConfiguration(), _path(spark, f"{path}-{uuid.uuid4().hex}")
    stream = fresh.getFileSystem(conf).create(fresh)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf)
    files.rename(fresh, _path(spark, path), options)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a published table says, or None if there is no version."""
    text = read_text(spark, f"{path.rstrip('/')}/{_POINTER}")
    return None if text is None else json.loads(text)


def publish(
    df: DataFrame,
    path: str,
    *,
    rules: Sequence[Rule] = (),
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    least_rows: int = 1,
) -> dict:
    """Write ``df`` as the new version of the table at ``path``; returns its manifest.

    Raises ``RuleViolation`` with the counts if a row rule is broken or there are fewer
    than ``least_rows`` rows; the version is then removed and the pointer not moved.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    version = uuid.uuid4().hex
    folder = f"{path}/{version}"
    seen = Observation()
    counts = [F.count_if(F.coalesce(r.broken, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    try:
        observed.write.partitionBy(*partition_by).format(fmt).save(folder)
        found = seen.get
        broken = {r.name: found[f"r{i}"] for i, r in enumerate(rules) if found[f"r{i}"]}
        if broken:
            raise RuleViolation(f"rules broken: {broken}")
        if found["rows"] < least_rows:
            raise RuleViolation(f"{found['rows']} rows, {least_rows} or more expected")
    except BaseException:
        drop_path(spark, folder)
        raise
    said = {
        "version": version,
        "format": fmt,
        "rows": found["rows"],
        "rules": [r.name for r in rules],
        "schema": df.schema.jsonValue(),
        "partition_by": list(partition_by),
    }
    replace_text(spark, f"{path}/{_POINTER}", json.dumps(said))
    return said


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names, with the columns as they were written."""
    said = manifest(spark, path)
    if said is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    schema = T.StructType.fromJson(said["schema"])
    folder = f"{path.rstrip('/')}/{said['version']}"
    return spark.read.format(said["format"]).schema(schema).load(folder).select(*[f"`{c}`" for c in schema.names])


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Remove every version but the current one; returns how many.  For quiet times:
    a reader that has followed the pointer may still read an old version."""
    said = manifest(spark, path)
    where = _path(spark, path.rstrip("/"))
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    old = [s.getPath() for s in found if s.isDirectory() and (said is None or s.getPath().getName() != said["version"])]
    for folder in old:
        drop_path(spark, folder.toString())
    return len(old)
