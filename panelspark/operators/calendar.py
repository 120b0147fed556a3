"""Dense calendars, month-end resampling, fills and the regime splice.

Every input here is unique on ``(key, date)`` with DATE precision, so one key
holds at most one row per calendar day and a window over it is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import POINT_REGIME, RANGE_REGIME
from .hotkeys import running_last


def calendar_spine(
    df: DataFrame, *, key: Sequence[str], date: str, unit: str = "day"
) -> DataFrame:
    """One row per key and day (or month end) between its first and last date."""
    bounds = df.groupBy(*key).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return bounds.select(*key, F.explode_outer(_steps(F.col("_lo"), F.col("_hi"), unit)).alias(date))


def _steps(lo: Column, hi: Column, unit: str) -> Column:
    """The calendar between two dates; never empty, so explode_outer is explode
    without the optimizer's extra filter that would build the sequence again."""
    if unit == "day":
        return F.sequence(lo, hi, F.expr("interval 1 day"))
    if unit == "month_end":
        months = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month"))
        return F.transform(months, F.last_day)
    raise ValueError(f"unknown calendar unit {unit!r}")


def densify(
    df: DataFrame, *, key: Sequence[str], date: str, unit: str = "day"
) -> DataFrame:
    """Insert the missing days / month ends of each key as rows of NULLs.

    Each row is stretched up to its successor, so the gap rows come out of the
    partition the data is in already and no join against a spine is needed.
    """
    w = Window.partitionBy(*key).orderBy(date)
    nxt = F.lead(date).over(w)
    if unit == "day":
        end = F.date_sub(nxt, 1)
    else:
        end = F.add_months(F.trunc(nxt, "month"), -1)
    others = [c for c in df.columns if c not in (*key, date)]
    stretched = df.withColumn("_end", F.coalesce(end, F.col(date))).select(
        *df.columns, F.posexplode_outer(_steps(F.col(date), F.col("_end"), unit)).alias("_i", "_d")
    )
    return stretched.select(
        *[
            F.col("_d").alias(c)
            if c == date
            else (F.when(F.col("_i") == 0, F.col(c)).alias(c) if c in others else F.col(c))
            for c in df.columns
        ]
    )


def calendar_spine_join(
    df: DataFrame, *, key: Sequence[str], date: str, unit: str = "day"
) -> DataFrame:
    """The dense calendar of each key with the data of ``df`` attached."""
    return densify(df, key=key, date=date, unit=unit)


def month_end_last(
    df: DataFrame, *, key: Sequence[str], date: str, values: Sequence[str]
) -> DataFrame:
    """Last non-null value per observed month, labelled by month end (no gap rows)."""
    return df.groupBy(*key, F.last_day(date).alias("_month")).agg(
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.col(date))).alias(v)
            for v in values
        ]
    ).withColumnRenamed("_month", date)


def resample_month_end_last(
    df: DataFrame, *, key: Sequence[str], date: str, values: Sequence[str]
) -> DataFrame:
    """Month-end resampling: last non-null per month, empty months as NULL rows."""
    return densify(
        month_end_last(df, key=key, date=date, values=values),
        key=key,
        date=date,
        unit="month_end",
    )


def forward_fill(
    df: DataFrame,
    *,
    key: Sequence[str],
    order: str,
    values: Sequence[str],
    slices: str | int | None = None,
) -> DataFrame:
    """Carry the last known value forward, never backward.

    ``slices=None`` is for rows unique per key and day; pass a number for
    unbounded keys (see ``hotkeys``).
    """
    filled = running_last(
        df,
        key=key,
        order=[order],
        values={f"_f_{v}": F.col(v) for v in values},
        slices=slices,
    )
    return filled.select(
        *[F.col(f"_f_{c}").alias(c) if c in values else F.col(c) for c in df.columns]
    )


def series_date_bounds(
    df: DataFrame, *, key: Sequence[str], series_id: str, date: str, value: str
) -> DataFrame:
    """Per key: the latest start and the earliest and latest end over its series."""
    per_series = (
        df.where(F.col(value).isNotNull())
        .groupBy(*key, series_id)
        .agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    )
    return per_series.groupBy(*key).agg(
        F.count(F.lit(1)).alias("series_count"),
        F.max("_lo").alias("latest_start"),
        F.min("_hi").alias("earliest_end"),
        F.max("_hi").alias("latest_end"),
    )


def splice_regime_flag(date: Column, range_start: Column) -> Column:
    return F.when(date < range_start, POINT_REGIME).otherwise(RANGE_REGIME)


def splice_inputs(
    point: DataFrame, lower: DataFrame, upper: DataFrame, *, key: Sequence[str], date: str, value: str
) -> DataFrame:
    """Stack the three inputs: one row per key and date with the three values.

    Two values of one input for a key and date are refused when the result is
    computed; neither would be more right than the other.
    """

    def only(c: str) -> Column:
        twice = F.raise_error(F.lit(f"{c}: more than one value for a key and date")).cast("double")
        return F.when(F.count(c) > 1, twice).otherwise(F.max(c)).alias(c)

    stacked = None
    for name, df in (("point", point), ("lower", lower), ("upper", upper)):
        part = df.select(
            *key,
            F.col(date).alias("date"),
            *[
                (F.col(value) if c == name else F.lit(None).cast("double")).alias(c)
                for c in ("point", "lower", "upper")
            ],
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*key, "date").agg(only("point"), only("lower"), only("upper"))


def splice_wide(rows: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Splice ``(key, date, point, lower, upper)`` rows; see ``splice_series``."""
    whole = Window.partitionBy(*key)

    def first(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.col("date"))).over(whole)

    def final(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.col("date"))).over(whole)

    bounded = rows.select(
        *rows.columns,
        first("point").alias("_first"),
        first("lower").alias("_lo"),
        first("upper").alias("_up"),
        F.greatest(final("lower"), final("upper")).alias("_last"),
    )
    # greatest() skips NULLs, so a key without one bound is left out explicitly.
    usable = bounded.where(
        F.col("_first").isNotNull() & F.col("_lo").isNotNull() & F.col("_up").isNotNull()
    ).withColumn("_range_start", F.greatest("_lo", "_up"))
    # The calendar runs from the first point value to the last bound, both of
    # which are rows of this table.
    inside = usable.where(F.col("date").between(F.col("_first"), F.col("_last")))
    daily = densify(
        inside.select(*key, "date", "point", "lower", "upper", "_range_start"),
        key=key,
        date="date",
        unit="day",
    )
    filled = forward_fill(
        daily, key=key, order="date", values=["point", "lower", "upper", "_range_start"]
    )
    legacy = F.col("date") < F.col("_range_start")
    lower = F.when(legacy, F.col("point")).otherwise(F.col("lower"))
    upper = F.when(legacy, F.col("point")).otherwise(F.col("upper"))
    return filled.select(
        *key,
        "date",
        lower.alias("target_lower"),
        upper.alias("target_upper"),
        ((lower + upper) / 2.0).alias("policy_rate"),
        splice_regime_flag(F.col("date"), F.col("_range_start")).alias("policy_regime"),
    )


def splice_series(
    point: DataFrame,
    lower: DataFrame,
    upper: DataFrame,
    *,
    key: Sequence[str],
    date: str = "date",
    value: str = "value",
) -> DataFrame:
    """One dense daily series per key across a point and a range regime.

    Before the first day with both bounds the point value stands for both; from
    then on the level is the midpoint.  Values are carried forward over the whole
    calendar first and the regime is applied afterwards.  Keys without a point
    value or without either bound give no rows; ``splice_coverage`` lists them.
    """
    return splice_wide(
        splice_inputs(point, lower, upper, key=key, date=date, value=value), key=key
    )


def splice_coverage(rows: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Per key of ``splice_inputs``: which coverage rules of the splice fail."""

    def dates(f, c: str) -> Column:
        return f(F.when(F.col(c).isNotNull(), F.col("date")))

    b = rows.groupBy(*key).agg(
        dates(F.min, "point").alias("_pf"),
        dates(F.max, "point").alias("_pl"),
        dates(F.min, "lower").alias("_lf"),
        dates(F.min, "upper").alias("_uf"),
    )
    start = F.greatest("_lf", "_uf")
    complete = F.col("_pf").isNotNull() & F.col("_lf").isNotNull() & F.col("_uf").isNotNull()
    return b.select(
        *key,
        F.col("_pf").isNull().alias("no_point_values"),
        (F.col("_lf").isNull() | F.col("_uf").isNull()).alias("no_range_bounds"),
        F.coalesce(complete & (F.col("_pl") < F.date_sub(start, 1)), F.lit(False)).alias(
            "point_ends_before_range"
        ),
    )
