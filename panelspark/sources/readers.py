"""Readers.  Files are read with a declared all-text schema and then converted,
so malformed values become rule violations instead of silent guesses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import SERIES_CATALOG
from ..functions.values import encode_bool_text, to_number
from ..operators.quality import (
    Rule,
    RuleViolation,
    Unique,
    expect,
    not_blank,
    numeric,
    require_schema,
    valid_date,
)

_DATE = "yyyy-MM-dd"


def _typed_series(text: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return text.select(
        *extra,
        F.try_to_date(F.trim("date"), _DATE).alias("date"),
        to_number(F.col("value")).alias("value"),
    )


def series_rules(key: Sequence[str] = ()) -> list:
    """Rules of a raw text series: dates valid, numbers numeric, dates unique."""
    return [
        valid_date("date", fmt=_DATE),
        numeric("value"),
        Unique("unique:date", [*key, "date"]),
    ]


def read_series_text(spark: SparkSession, path: str) -> DataFrame:
    """A ``date,value`` CSV as text; the header must hold exactly these columns."""
    text = spark.read.option("header", True).csv(path)
    return require_schema(text, ["date", "value"], mode="exact").select("date", "value")


def read_series_csv(
    spark: SparkSession, path: str, value_name: str = "value", *, on_violation: str = "raise"
) -> DataFrame:
    """One ``date,value`` file to a typed series named ``value_name``.

    ``report`` returns the rule counts instead, ``quarantine`` a pair of typed
    good rows and rejected text rows.
    """
    text = read_series_text(spark, path)
    checked = expect(text, series_rules(), on_violation=on_violation)
    if on_violation == "report":
        return checked
    if on_violation == "quarantine":
        good, bad = checked
        return _typed_series(good).withColumnRenamed("value", value_name), bad
    return _typed_series(checked).withColumnRenamed("value", value_name)


_OBSERVATIONS = "observations array<struct<date:string,value:string>>"


def read_series_json(
    spark: SparkSession, path: str, *, multi_line: bool = True, on_violation: str = "raise"
) -> DataFrame:
    """Landed API documents ``{"observations": [{"date", "value"}, ...]}`` to rows.

    ``.`` (and any other non-number) is a missing value.  A document without the
    list or without its fields is an error, and so are duplicate dates.
    ``multi_line`` reads one document per file, otherwise one per line.
    """
    docs = spark.read.schema(_OBSERVATIONS).option("multiLine", multi_line).json(path)
    return parse_series_json(docs, on_violation=on_violation)


def parse_series_json(
    docs: DataFrame, *, key: Sequence[str] = (), on_violation: str = "raise"
):
    """Rows of an ``observations`` array column, typed and checked.

    A document without the list breaks the rule ``observations``; it stands as
    one row without date and value.  ``quarantine`` returns typed good rows and
    rejected text rows, ``report`` the rule counts.
    """
    rows = docs.select(
        *key, F.col("observations").isNull().alias("_absent"), F.explode_outer("observations").alias("_o")
    ).where("_absent OR _o IS NOT NULL").select(*key, "_absent", "_o.*")
    rules = [
        Rule("observations", F.col("_absent")),
        valid_date("date", fmt=_DATE),
        Unique("unique:date", [*key, "date"]),
    ]
    checked = expect(rows, rules, on_violation=on_violation)
    if on_violation == "report":
        return checked
    if on_violation == "quarantine":
        good, bad = checked
        return _typed_series(good, key), bad.drop("_absent")
    return _typed_series(checked, key)


def series_catalog(spark: SparkSession) -> DataFrame:
    """The declared series (fixed and small)."""
    return spark.createDataFrame(
        list(SERIES_CATALOG), "logical_name string, series_id string, frequency string, role string"
    )


_FILE_NAME = r"/(?:logical_name=)?([^/=]+?)(?:\.csv)?(?:/part-[^/]*)?$"


def read_series_catalog(
    spark: SparkSession,
    folder: str,
    catalog: DataFrame | None = None,
    *,
    on_violation: str = "raise",
):
    """All series files below a folder as one long, tagged table.

    A series is a file or folder ``<logical_name>.csv``, or a partition folder
    ``logical_name=<logical_name>``.  The header of every file must name the
    columns ``date,value``; dates must be valid and unique per series, values
    numeric, and every series declared in ``catalog``.  ``quarantine`` returns
    typed good rows and rejected text rows, ``report`` the rule counts.
    ``verify_outputs_exist`` lists declared series without rows.
    """
    catalog = series_catalog(spark) if catalog is None else catalog
    text = (
        spark.read.option("header", True)
        .option("enforceSchema", False)  # the header's names are compared, not skipped
        .schema("date string, value string")
        .csv(folder, recursiveFileLookup=True, pathGlobFilter="*.csv")
        .withColumn("logical_name", F.regexp_extract(F.col("_metadata.file_path"), _FILE_NAME, 1))
    )
    tagged = text.join(catalog, "logical_name", "left")
    rules = [*series_rules(["logical_name"]), Rule("declared:logical_name", F.col("series_id").isNull())]
    tags = ["logical_name", "series_id", "frequency", "role"]
    checked = expect(tagged, rules, on_violation=on_violation)
    if on_violation == "report":
        return checked
    if on_violation == "quarantine":
        good, bad = checked
        return _typed_series(good, tags), bad
    return _typed_series(checked, tags)


def verify_outputs_exist(long: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows and date range per declared series; 0 rows for a missing one."""
    counts = long.groupBy("logical_name").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    return catalog.join(counts, "logical_name", "left").select(
        "logical_name", F.coalesce("_rows", F.lit(0)).alias("rows"), "first_date", "last_date"
    )


def require_outputs(report: DataFrame) -> None:
    """Raise if a declared series has no rows (the catalog is small and fixed)."""
    missing = [r.logical_name for r in report.where("rows = 0").collect()]
    if missing:
        raise RuleViolation(f"series without rows: {missing}")


def filter_observation_start(df: DataFrame, start: str | None, *, date: str = "date") -> DataFrame:
    """Optional lower bound; reaches the scan as a pushed filter."""
    if start is None:
        return df
    return df.where(F.col(date) >= F.to_date(F.lit(start)))


def event_calendar_rules(key: Sequence[str] = ()) -> list:
    """Rules of a raw text calendar: dates valid and unique, flags known, urls given."""
    return [
        valid_date("meeting_date", fmt=_DATE),
        Rule("domain:is_scheduled", encode_bool_text(F.trim("is_scheduled")).isNull()),
        not_blank("source_url"),
        Unique("unique:meeting_date", [*key, "meeting_date"]),
    ]


def read_event_calendar(
    spark: SparkSession, path: str, *, key: Sequence[str] = (), on_violation: str = "raise"
):
    """``meeting_date,is_scheduled,source_url`` CSV to typed events.

    ``key`` names text columns in front of them that tell calendars apart.  The
    header must name the columns.  ``quarantine`` returns typed good rows and
    rejected text rows, ``report`` the rule counts.
    """
    names = [*key, "meeting_date", "is_scheduled", "source_url"]
    text = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .schema(", ".join(f"{c} string" for c in names))
        .csv(path)
    )

    def typed(rows: DataFrame) -> DataFrame:
        return rows.select(
            *key,
            F.try_to_date(F.trim("meeting_date"), _DATE).alias("meeting_date"),
            encode_bool_text(F.trim("is_scheduled")).cast("boolean").alias("is_scheduled"),
            "source_url",
        )

    checked = expect(text, event_calendar_rules(key), on_violation=on_violation)
    if on_violation == "report":
        return checked
    if on_violation == "quarantine":
        return typed(checked[0]), checked[1]
    return typed(checked)


def read_panel(
    spark: SparkSession, path: str, rules: Sequence, *, fmt: str = "parquet", schema: str | None = None
) -> DataFrame:
    """Read a panel and check it before use."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("dateFormat", _DATE)
    if schema is not None:
        reader = reader.schema(schema)
    return expect(reader.load(path), list(rules))
