"""Month-grid windows and event-history windows.

Month windows expect a dense month grid (``resample_month_end_last``): an offset
of *n* rows is then *n* calendar months.  History windows count prior event rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import NO_PRIOR_CHANGE_DAYS
from ..functions.values import encode_bool_text, encode_direction
from .hotkeys import AUTO, prior_rows


def _grid(key: Sequence[str], order: str):
    return Window.partitionBy(*key).orderBy(order)


def pct_change_complete(
    df: DataFrame,
    *,
    key: Sequence[str],
    order: str,
    value: str,
    periods: int = 12,
    out: str = "pct_change",
) -> DataFrame:
    """Percent change over ``periods`` rows, only if all ``periods + 1`` are present."""
    w = _grid(key, order)
    full = F.count(value).over(w.rowsBetween(-periods, 0)) == periods + 1
    then = F.lag(value, periods).over(w)
    change = (F.try_divide(F.col(value), then) - 1) * 100.0
    return df.withColumn(out, F.when(full, change))


def diff_n(
    df: DataFrame, *, key: Sequence[str], order: str, value: str, n: int, out: str | None = None
) -> DataFrame:
    change = F.col(value) - F.lag(value, n).over(_grid(key, order))
    return df.withColumn(out or f"{value}_diff{n}", change)


def rolling_mean_full(
    df: DataFrame, *, key: Sequence[str], order: str, value: str, n: int, out: str | None = None
) -> DataFrame:
    """Trailing mean of ``n`` rows; NULL unless all ``n`` are present."""
    w = _grid(key, order).rowsBetween(-(n - 1), 0)
    mean = F.when(F.count(value).over(w) == n, F.avg(value).over(w))
    return df.withColumn(out or f"{value}_ma{n}", mean)


def lag_filled(
    df: DataFrame,
    *,
    key: Sequence[str],
    order: str,
    value: str,
    n: int = 1,
    fill=0,
    out: str | None = None,
    ties: Sequence[str] = (),
    slices: str | int | None = AUTO,
) -> DataFrame:
    """Value ``n`` event rows earlier, ``fill`` where there is none."""
    state = prior_rows(df, key=key, order=order, payload=[value], depth=n, ties=ties, slices=slices)
    return state.select(
        *df.columns,
        F.coalesce(F.col(f"_prev{n}")[value], F.lit(fill)).alias(out or f"prior{n}_{value}"),
    )


def _prior_sum(value: str, n: int) -> Column:
    """Sum over the struct columns _prev1.._prevn, missing rows counting 0."""
    total = F.lit(0)
    for i in range(1, n + 1):
        total = total + F.coalesce(F.col(f"_prev{i}")[value], F.lit(0))
    return total


def prior_rolling_sum(
    df: DataFrame,
    *,
    key: Sequence[str],
    order: str,
    value: str,
    n: int = 3,
    out: str | None = None,
    ties: Sequence[str] = (),
    slices: str | int | None = AUTO,
) -> DataFrame:
    """Sum over the ``n`` event rows before this one; fewer rows are allowed."""
    state = prior_rows(df, key=key, order=order, payload=[value], depth=n, ties=ties, slices=slices)
    return state.select(*df.columns, _prior_sum(value, n).alias(out or f"prior{n}_sum_{value}"))


def _streak_positions(direction: str) -> dict[str, Column]:
    return {f"_at_{d}": F.col(direction) == d for d in (-1, 0, 1)}


def _streak(direction: str) -> Column:
    """Length of the non-zero run ending at the previous row.

    It is the distance from the previous row back to the last row that had
    another direction.
    """
    prev = F.col("_prev1")[direction]
    other = (
        F.when(prev == 1, F.greatest("_at_-1", "_at_0"))
        .when(prev == -1, F.greatest("_at_1", "_at_0"))
        .otherwise(F.col("_pos") - 1)
    )
    return F.col("_pos") - 1 - other


def prior_streak(
    df: DataFrame,
    *,
    key: Sequence[str],
    order: str,
    direction: str,
    out: str = "same_direction_streak",
    ties: Sequence[str] = (),
    slices: str | int | None = AUTO,
) -> DataFrame:
    """Length of the same-direction, non-zero run that ended just before the row."""
    state = prior_rows(
        df,
        key=key,
        order=order,
        payload=[direction],
        depth=1,
        last_position=_streak_positions(direction),
        ties=ties, slices=slices,
    )
    return state.select(*df.columns, _streak(direction).alias(out))


def days_since_prior_event(
    df: DataFrame,
    *,
    key: Sequence[str],
    date: str,
    out: str = "days_since_prior_event",
    ties: Sequence[str] = (),
    slices: str | int | None = AUTO,
) -> DataFrame:
    state = prior_rows(df, key=key, order=date, payload=[date], depth=1, ties=ties, slices=slices)
    return state.select(*df.columns, _days_between(F.col("_prev1")[date], date, 0).alias(out))


def _days_between(earlier: Column, date: str, missing: int) -> Column:
    return F.coalesce(F.datediff(F.col(date), earlier), F.lit(missing))


def _days_since_change(earlier: Column, date: str, cap: int) -> Column:
    return F.least(F.greatest(_days_between(earlier, date, cap), F.lit(0)), F.lit(cap))


def days_since_prior_change(
    df: DataFrame,
    *,
    key: Sequence[str],
    date: str,
    flag: str,
    cap: int = NO_PRIOR_CHANGE_DAYS,
    out: str = "days_since_prior_change",
    ties: Sequence[str] = (),
    slices: str | int | None = AUTO,
) -> DataFrame:
    """Days since the last earlier row with ``flag`` = 1; ``cap`` if there is none."""
    state = prior_rows(
        df,
        key=key,
        order=date,
        payload=[date],
        depth=1,
        last={"_changed_at": F.when(F.col(flag) == 1, F.col(date))},
        ties=ties, slices=slices,
    )
    return state.select(*df.columns, _days_since_change(F.col("_changed_at"), date, cap).alias(out))


def history_features(
    df: DataFrame,
    *,
    key: Sequence[str],
    date: str,
    label: str = "decision",
    change: str = "is_change",
    size: str | None = "rate_change_bps",
    scheduled: str | None = "is_scheduled",
    cap: int = NO_PRIOR_CHANGE_DAYS,
    ties: Sequence[str] = (),
    slices: str | int | None = AUTO,
) -> DataFrame:
    """All event-history features from strictly earlier rows, in one window pass.

    ``(key, date)`` must be unique.  ``size`` is the signed change carried as
    ``prior_rate_change_bps``; ``scheduled`` is recoded to 1/0 if given.
    """
    coded = df.withColumn("_dir", encode_direction(F.col(label)))
    payload = ["_dir", change, date, *([size] if size else [])]
    state = prior_rows(
        coded,
        key=key,
        order=date,
        payload=payload,
        depth=3,
        last={"_changed_at": F.when(F.col(change) == 1, F.col(date))},
        last_position=_streak_positions("_dir"),
        ties=ties, slices=slices,
    )
    out = {
        "prior_decision": F.coalesce(F.col("_prev1")["_dir"], F.lit(0)),
        "prior_is_change": F.coalesce(F.col("_prev1")[change], F.lit(0)),
        "prior2_is_change": F.coalesce(F.col("_prev2")[change], F.lit(0)),
        "prior3_change_count": _prior_sum(change, 3),
        "prior3_direction": _prior_sum("_dir", 3),
    }
    if size:
        out["prior_rate_change_bps"] = F.coalesce(F.col("_prev1")[size], F.lit(0.0))
    out["same_direction_streak"] = _streak("_dir")
    out["days_since_prior_meeting"] = _days_between(F.col("_prev1")[date], date, 0)
    out["days_since_prior_change"] = _days_since_change(F.col("_changed_at"), date, cap)
    kept = [
        encode_bool_text(F.col(c)).alias(c) if c == scheduled else F.col(c) for c in df.columns
    ]
    return state.select(*kept, *[c.alias(n) for n, c in out.items()])


HISTORY_COLUMNS = (
    "prior_decision",
    "prior_is_change",
    "prior2_is_change",
    "prior3_change_count",
    "prior3_direction",
    "prior_rate_change_bps",
    "same_direction_streak",
    "days_since_prior_meeting",
    "days_since_prior_change",
)


def no_lookahead_recheck(
    df: DataFrame,
    *,
    key: Sequence[str],
    date: str,
    cutoff: Column,
    ties: Sequence[str] = (),
    slices: str | int | None = AUTO,
    **columns,
) -> DataFrame:
    """Rows up to ``cutoff`` whose history changes when later rows are removed.

    Features are computed on the full history and on the truncated one; the
    result lists the differing rows and is empty for look-ahead-free features.
    """
    size = columns.get("size", "rate_change_bps")
    names = [c for c in HISTORY_COLUMNS if size or c != "prior_rate_change_bps"]
    full = history_features(df, key=key, date=date, ties=ties, slices=slices, **columns)
    cut = history_features(
        df.where(F.col(date) <= cutoff), key=key, date=date, ties=ties, slices=slices, **columns
    )
    cols = [*key, date, *names]
    return full.where(F.col(date) <= cutoff).select(*cols).exceptAll(cut.select(*cols))
