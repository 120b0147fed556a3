"""The contract of landed page records, checked on the JSON itself.

A landed line is read as a ``VARIANT``, so that what a typed reader would coerce or
drop is still there: missing and unexpected fields, numbers in quotes, text that is no
JSON.  Each record gets the list of its faults; all of them are counted in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..operators.pages import PAGE_RECORD_COLUMNS
from ..operators.quality import RuleViolation

TEXT_FIELDS = ("source_id", "category", "url", "fetched_at_utc")
OPTIONAL_TEXT_FIELDS = ("title", "error")


def _faults_of_object(record: Column, value: Column, fields: Sequence[str]) -> Column:
    get = lambda f: F.variant_get(record, f"$.{f}", "variant")
    # The type of a field as written: VOID for null, and no type where it is missing.
    kind = lambda f: F.schema_of_variant(get(f))
    checks = [F.when(get(f).isNull(), F.lit(f"missing {f}")) for f in fields]
    for f in TEXT_FIELDS:
        text = F.when(kind(f) == "STRING", F.variant_get(record, f"$.{f}", "string"))
        # Leading and trailing white space of any kind is not text.
        blank = F.coalesce(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "") == "", F.lit(True))
        checks.append(F.when(get(f).isNotNull() & blank, F.lit(f"not text: {f}")))
    for f in OPTIONAL_TEXT_FIELDS:
        checks.append(F.when(~kind(f).isin("STRING", "VOID"), F.lit(f"neither text nor null: {f}")))
    checks.append(F.when(~kind("status_code").isin("BIGINT", "VOID"), F.lit("neither integer nor null: status_code")))
    items = F.coalesce(F.try_variant_get(record, "$.headings", "array<variant>"), F.array().cast("array<variant>"))
    mixed = F.exists(items, lambda x: F.schema_of_variant(x) != "STRING")
    array = lambda f: kind(f).startswith("ARRAY<")
    checks.append(F.when(~array("headings") | (array("headings") & mixed), F.lit("not a list of text: headings")))
    checks.append(F.when(~array("table_previews"), F.lit("not a list: table_previews")))
    extra = F.array_sort(F.array_except(F.json_object_keys(value), F.array(*[F.lit(f) for f in fields])))
    unexpected = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda f: F.concat(F.lit("unexpected "), f))
    return F.concat(F.array_compact(F.array(*checks)), unexpected)


def record_faults(value: Column, fields: Sequence[str] = PAGE_RECORD_COLUMNS) -> Column:
    """What is wrong with a landed JSON line, as a list; empty for a valid record.

    A line that is NULL, no JSON, or holds a number that JSON does not know (NaN,
    Infinity) is ``not valid JSON``; any other value than an object ``not an object``.
    """
    one = lambda text: F.array(F.lit(text))
    parsed = F.try_parse_json(value)
    return let(
        parsed,
        lambda v: F.when(v.isNull(), one("not valid JSON"))
        .when(~F.schema_of_variant(v).startswith("OBJECT<"), one("not an object"))
        .otherwise(_faults_of_object(v, value, fields)),
    )


def landed_faults(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """``(fault, records)``: how many lines have each fault.  Lazy, one aggregation."""
    found = lines.select(F.explode(record_faults(F.col(value))).alias("fault"))
    return found.groupBy("fault").agg(F.count(F.lit(1)).alias("records"))


def validate_landed(lines: DataFrame, *, value: str = "value", on_violation: str = "raise"):
    """Check landed lines: ``report`` gives the counts, ``quarantine`` a split pair.

    ``quarantine`` returns the good lines and the rejected ones with ``faults``;
    together they are always the input.  ``raise`` stops with counts and up to five
    lines, also for a table without any record, and else returns ``lines``.
    """
    if on_violation == "report":
        return landed_faults(lines, value=value)
    marked = lines.withColumn("faults", record_faults(F.col(value)))
    if on_violation == "quarantine":
        return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)
    if on_violation != "raise":
        raise ValueError(f"unknown on_violation {on_violation!r}")
    bad = F.size("faults") > 0
    seen = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    if not seen.n:
        raise RuleViolation("there is no record")
    if seen.bad:
        counts = {r.fault: r.records for r in landed_faults(lines, value=value).collect()}
        samples = [r.asDict() for r in marked.where(bad).limit(5).collect()]
        raise RuleViolation(f"{seen.bad} of {seen.n} records break the contract: {counts}; samples: {samples}")
    return lines
