"""As-of joins: the nearest earlier (or later) row of another series.

All sources of one event table are stacked with the events and resolved by one
ordered window per direction, so any number of as-of lookups costs one shuffle.
The right side must be unique on ``(key, date)`` (check it with ``Unique``).

With DATE columns one key holds at most one event row and one row per series and
calendar day, because repeated event dates are looked up once and joined back;
a window partition is therefore bounded by the calendar.  With timestamps hot
keys are cut into slices (see ``hotkeys``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.values import close
from .hotkeys import AUTO, running_last


@dataclass(frozen=True)
class Pick:
    """One lookup in a source: which rows count, what to take, how old it may be."""

    values: Mapping[str, str]
    reference_col: str | None = None
    where: Column | None = None
    direction: str = "backward"
    tolerance_days: int | None = None


@dataclass(frozen=True)
class Source:
    """A dated table unique on ``(key, date)`` (per ``where`` of each pick).

    ``months_ago`` asks for what was known that many calendar months before the event
    (``add_months`` of the event's date, so the last day of a shorter month stands for
    the days it lacks); dates only.
    """

    df: DataFrame
    date: str
    picks: Sequence[Pick] = field(default_factory=list)
    allow_exact: bool = True
    months_ago: int = 0


def _known_from(date: Column, months: int) -> Column:
    """First day whose ``add_months(day, -months)`` is ``date`` or later.

    Moving a source by this rule gives the same rows as moving every event back.
    """
    later = F.add_months(date, months)
    return F.when(F.add_months(later, -months) >= date, later).otherwise(F.date_add(later, 1))


def _age_ok(event: Column, ref: Column, days: int, is_date: bool) -> Column:
    if is_date:
        return F.abs(F.datediff(event, ref)) <= days
    micros = F.abs(F.timestamp_diff("MICROSECOND", ref, event))
    return micros <= days * 86_400_000_000


def asof_many(
    left: DataFrame,
    sources: Sequence[Source],
    *,
    key: Sequence[str],
    left_date: str,
    left_unique: bool = False,
    slices: str | int | None = AUTO,
) -> DataFrame:
    """Resolve every pick of every source for each row of ``left``.

    ``left_unique`` states that ``(key, left_date)`` is unique, which saves the
    join back.  Rows without a match keep NULLs.
    """
    key = list(key)
    is_date = isinstance(left.schema[left_date].dataType, T.DateType) and all(
        isinstance(s.df.schema[s.date].dataType, T.DateType) for s in sources
    )
    needle = [*key, F.col(left_date).alias("_t")]
    if left_unique:
        events = left.select(*needle, F.struct(*left.columns).alias("_left"))
    else:
        events = left.select(*needle).distinct().withColumn("_left", F.lit(True))
    stack = events.withColumn("_tie", F.lit(1))
    if any(s.months_ago for s in sources):
        if not is_date:
            raise ValueError("calendar months are counted from dates only")
        # Days that a shorter month lacks are known from one day on: the latest counts.
        stack = stack.withColumn("_day", F.lit(None).cast("date"))

    picks: list[tuple[str, str, Pick]] = []
    for i, s in enumerate(sources):
        slot = f"_s{i}"
        fields = [F.col(s.date).alias("_ref")]
        for j, p in enumerate(s.picks):
            picks.append((slot, f"_k{i}_{j}", p))
            fields += [F.col(c).alias(f"p{j}_{o}") for c, o in p.values.items()]
            if p.where is not None:
                fields.append(F.coalesce(p.where, F.lit(False)).alias(f"w{j}"))
        rows = s.df
        if all(p.where is not None for p in s.picks):
            # Rows no pick can use never reach the shuffle.
            used = reduce(or_, [F.coalesce(p.where, F.lit(False)) for p in s.picks])
            rows = rows.where(used)
        moved = [F.col(s.date).alias("_day")] if "_day" in stack.columns else []
        rows = rows.select(
            *key,
            (_known_from(F.col(s.date), s.months_ago) if s.months_ago else F.col(s.date)).alias("_t"),
            F.lit(0 if s.allow_exact else 2).alias("_tie"),
            *moved,
            F.struct(*fields).alias(slot),
        )
        stack = stack.unionByName(rows, allowMissingColumns=True)

    def value_of(slot: str, name: str, p: Pick) -> Column:
        j = name.rsplit("_", 1)[1]
        got = F.struct(
            F.col(f"{slot}._ref").alias("_ref"),
            *[F.col(f"{slot}.p{j}_{o}").alias(o) for o in p.values.values()],
        )
        usable = F.col(slot).isNotNull()
        if p.where is not None:
            usable = usable & F.col(f"{slot}.w{j}")
        return F.when(usable, got)

    # A date-grained key is bounded by the calendar unless the caller says otherwise.
    limit = None if is_date and slices == AUTO else slices
    for direction in ("backward", "forward"):
        values = {
            name: value_of(slot, name, p)
            for slot, name, p in picks
            if p.direction == direction
        }
        if values:
            stack = running_last(
                stack,
                key=key,
                order=["_t", "_tie", *(["_day"] if "_day" in stack.columns else [])],
                values=values,
                reverse=direction == "forward",
                slices=limit,
            )

    out: list[Column] = []
    for _, name, p in picks:
        ref = F.col(f"{name}._ref")
        ok = ref.isNotNull()
        if p.tolerance_days is not None:
            ok = ok & _age_ok(F.col("_t"), ref, p.tolerance_days, is_date)
        if p.reference_col:
            out.append(F.when(ok, ref).alias(p.reference_col))
        out += [F.when(ok, F.col(f"{name}.{o}")).alias(o) for o in p.values.values()]

    found = stack.where(F.col("_left").isNotNull())
    if left_unique:
        return found.select("_left.*", *out)
    found = found.select(*key, F.col("_t").alias(left_date), *out)
    return left.join(found, [*key, left_date], "left")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    key: Sequence[str],
    left_date: str,
    right_date: str,
    values: Mapping[str, str] | Sequence[str],
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance_days: int | None = None,
    reference_col: str | None = None,
    left_unique: bool = False,
    slices: str | int | None = AUTO,
) -> DataFrame:
    """Join each left row to the nearest right row in time.

    ``values`` are right columns, or a mapping to their output names.  A match
    older (or later) than ``tolerance_days`` becomes NULL; the nearest row is the
    only candidate, so checking it afterwards is exact.
    """
    if not isinstance(values, Mapping):
        values = {v: v for v in values}
    pick = Pick(
        values,
        reference_col=reference_col,
        direction=direction,
        tolerance_days=tolerance_days,
    )
    return asof_many(
        left,
        [Source(right, right_date, [pick], allow_exact)],
        key=key,
        left_date=left_date,
        left_unique=left_unique,
        slices=slices,
    )


def asof_multi(
    events: DataFrame,
    series: DataFrame,
    *,
    key: Sequence[str],
    event_date: str,
    series_ids: Sequence[str],
    series_id: str = "series_id",
    series_date: str = "date",
    value: str = "value",
    allow_exact: bool = True,
    max_age_days: int | None = None,
    left_unique: bool = False,
) -> DataFrame:
    """Several series of one long table onto one calendar, in one window pass.

    ``series`` is unique on ``(key, date, series_id)``.  Adds ``<id>`` and ``<id>_reference_date`` per series.  NULL values are not
    available and are skipped.
    """
    source = series_source(
        series,
        key=key,
        series_ids=series_ids,
        series_id=series_id,
        series_date=series_date,
        value=value,
        allow_exact=allow_exact,
        max_age_days=max_age_days,
    )
    return asof_many(events, [source], key=key, left_date=event_date, left_unique=left_unique)


def series_source(
    series: DataFrame,
    *,
    key: Sequence[str],
    series_ids: Sequence[str],
    series_id: str = "series_id",
    series_date: str = "date",
    value: str = "value",
    allow_exact: bool = True,
    max_age_days: int | None = None,
) -> Source:
    """Several series of one long table as one source; see ``asof_multi``.

    A value that stands twice for a key, date and series fails the query.
    """

    def only(s: str) -> Column:
        own = F.when(F.col(series_id) == s, F.col(value))
        twice = F.raise_error(F.lit(f"{s}: two values for one key and {series_date}"))
        kind = series.schema[value].dataType
        return F.when(F.count(own) > 1, twice.cast(kind)).otherwise(F.max(own)).alias(s)

    # One row per key and date first (combined map-side), so that the window
    # sorts as many rows as there are dates, not dates times series.
    wide = (
        series.where(F.col(series_id).isin(*series_ids))
        .groupBy(*key, series_date)
        .agg(*[only(s) for s in series_ids])
    )
    picks = [
        Pick(
            {s: s},
            reference_col=f"{s}_reference_date",
            where=F.col(s).isNotNull(),
            tolerance_days=max_age_days,
        )
        for s in series_ids
    ]
    return Source(wide, series_date, picks, allow_exact)


def stale_or_missing(
    df: DataFrame,
    *,
    event_date: str,
    reference_cols: Sequence[str],
    max_age_days: int,
) -> DataFrame:
    """Add ``<reference>_status``: ``ok``, ``missing`` or ``stale``."""
    out = {}
    for ref in reference_cols:
        out[f"{ref}_status"] = (
            F.when(F.col(ref).isNull(), "missing")
            .when(F.datediff(event_date, ref) > max_age_days, "stale")
            .otherwise("ok")
        )
    return df.withColumns(out)


def asof_calendar_offset(
    events: DataFrame,
    series: DataFrame,
    *,
    key: Sequence[str],
    event_date: str,
    series_date: str,
    value: str,
    months: Sequence[int] = (1, 3),
    out: str = "value_{}m_ago",
) -> DataFrame:
    """Value in force ``n`` calendar months before each event, per ``n``.

    All offsets of an event date are looked up in the same window and folded
    back on the same key partitioning.
    """
    key = list(key)
    lookups = (
        events.select(*key, event_date)
        .distinct()
        .select(
            *key,
            event_date,
            F.explode(F.array(*[F.lit(int(m)) for m in months])).alias("_m"),
        )
        .withColumn("_at", F.add_months(event_date, -F.col("_m")))
    )
    needles = lookups.select(
        *key,
        F.col("_at").alias("_t"),
        F.lit(1).alias("_tie"),
        F.struct(event_date, "_m").alias("_left"),
    )
    rows = series.where(F.col(value).isNotNull()).select(
        *key,
        F.col(series_date).alias("_t"),
        F.lit(0).alias("_tie"),
        F.col(value).alias("_v"),
    )
    # Bounded per key: calendar days times (1 + number of offsets).
    found = running_last(
        needles.unionByName(rows, allowMissingColumns=True),
        key=key,
        order=["_t", "_tie"],
        values={"_then": F.col("_v")},
        slices=None,
    ).where(F.col("_left").isNotNull())
    folded = found.groupBy(*key, F.col(f"_left.{event_date}").alias(event_date)).agg(
        *[
            F.max(F.when(F.col("_left._m") == m, F.col("_then"))).alias(out.format(m))
            for m in months
        ]
    )
    return events.join(folded, [*key, event_date], "left")


def asof_reconcile(
    panel: DataFrame,
    series: DataFrame,
    *,
    key: Sequence[str],
    date: str,
    value: str,
    series_date: str,
    series_value: str,
    atol: float = 1e-10,
    rtol: float = 1e-5,
) -> DataFrame:
    """Look the panel value up again in the raw series and compare.

    Adds ``raw_value`` and ``reconciled``; a missing raw value is not reconciled.
    """
    audited = asof_join(
        panel,
        series.where(F.col(series_value).isNotNull()),
        key=key,
        left_date=date,
        right_date=series_date,
        values={series_value: "raw_value"},
    )
    same = close(F.col(value), F.col("raw_value"), atol=atol, rtol=rtol)
    return audited.withColumn("reconciled", F.coalesce(same, F.lit(False)))
