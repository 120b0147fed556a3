"""Equi-joins with asserted cardinality and reported misses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .quality import Unique, expect


def unique_or_fail(df: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """``df``; a second row of a key fails the query that reads it, naming the key.

    The key is counted in the shuffle and the order that a join on it needs anyway, so
    nothing is scanned before.  NULL keys are equal to each other.
    """
    w = Window.partitionBy(*on).orderBy(*on)
    keys = F.to_json(F.struct(*[F.col(f"`{c}`") for c in on]), {"ignoreNullFields": "false"})
    told = F.raise_error(F.concat(F.lit(f"{name}: more than one row for "), keys))
    once = F.when(F.col("_nth") == 1, F.lit(True)).otherwise(told.cast("boolean"))
    return df.withColumn("_nth", F.row_number().over(w)).where(once).drop("_nth")


def left_join_one_to_one(
    left: DataFrame, right: DataFrame, *, on: Sequence[str], check: bool | str = True
) -> DataFrame:
    """Left join whose key is unique on both sides.

    ``check=True`` proves it first, with one scan of each side and ``RuleViolation``;
    ``"plan"`` asserts it within the join, whose query fails at the first repeated key.
    """
    if check == "plan":
        left, right = unique_or_fail(left, on, "unique:left"), unique_or_fail(right, on, "unique:right")
    elif check:
        expect(left, [Unique("unique:left", list(on))])
        expect(right, [Unique("unique:right", list(on))])
    return left.join(right, list(on), "left")


def exact_date_lookup(
    left: DataFrame,
    right: DataFrame,
    *,
    key: Sequence[str],
    left_date: str,
    right_date: str,
    values: Mapping[str, str],
) -> DataFrame:
    """Values of ``right`` at exactly the left date; NULL where there is none.

    A key and date that stands twice in ``right`` fails the query.
    """
    picked = right.select(
        *key, F.col(right_date).alias(left_date), *[F.col(c).alias(o) for c, o in values.items()]
    )
    picked = unique_or_fail(picked, [*key, left_date], "unique:lookup")
    return left.join(picked, [*key, left_date], "left")


def missing_dates(
    left: DataFrame, right: DataFrame, *, key: Sequence[str], left_date: str, right_date: str
) -> DataFrame:
    """Distinct left ``(key, date)`` without a right row."""
    have = right.select(*key, F.col(right_date).alias(left_date))
    return left.select(*key, left_date).distinct().join(have, [*key, left_date], "left_anti")


def prediction_context_join(
    predictions: DataFrame, panel: DataFrame, *, on: Sequence[str], context: Sequence[str]
) -> DataFrame:
    """Predictions with the panel columns a report needs.

    Adds ``context_missing``, true where a needed value is absent.
    """
    joined = predictions.join(panel.select(*on, *context), list(on), "left")
    missing = F.lit(False)
    for c in context:
        missing = missing | F.col(c).isNull()
    return joined.withColumn("context_missing", missing)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def filter_available(df: DataFrame, *, value: str) -> DataFrame:
    """Rows that may serve an as-of lookup."""
    return df.where(F.col(value).isNotNull())


def filter_year_range(df: DataFrame, *, date: str, start: int, end: int) -> DataFrame:
    """Rows of the given years, written as a date range so that it is pushed down."""
    lo, hi = F.make_date(F.lit(start), F.lit(1), F.lit(1)), F.make_date(F.lit(end + 1), F.lit(1), F.lit(1))
    return df.where((F.col(date) >= lo) & (F.col(date) < hi))


def filter_positive(df: DataFrame, *, value: str) -> DataFrame:
    return df.where(F.col(value) > 0)
