"""Writers.  Spark's committer makes each output appear whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.pages import PAGE_RECORD_COLUMNS, coverage_summary
from ..operators.quality import expect, not_blank, require_schema


def write_panel(
    df: DataFrame, path: str, *, fmt: str = "csv", partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Panel to CSV with ISO dates, or to Parquet, optionally partitioned."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("dateFormat", "yyyy-MM-dd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_metrics_json(document: DataFrame, path: str) -> None:
    """A one-row metrics document to JSON, NULL fields kept."""
    document.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def page_record_rules() -> list:
    return [not_blank(c) for c in ("source_id", "category", "url", "fetched_at_utc")]


def validate_page_records(records: DataFrame, *, on_violation: str = "raise"):
    """Record contract: exact columns, text fields present."""
    require_schema(records, PAGE_RECORD_COLUMNS, mode="exact")
    return expect(records, page_record_rules(), on_violation=on_violation)


def write_nested_jsonl(records: DataFrame, path: str) -> None:
    """Nested page records, one JSON document per line."""
    validate_page_records(records)
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_coverage_summary(records: DataFrame, path: str) -> None:
    """Flat CSV summary of page records."""
    coverage_summary(records).write.mode("overwrite").option("header", True).csv(path)
