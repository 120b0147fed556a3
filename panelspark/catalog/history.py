"""Event-history windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.values import encode_direction
from ..operators import windows as w
from . import fixtures as fx
from .registry import query, with_views

_K = ["k"]
_W = "PARTITION BY k ORDER BY ts"
_WD = "PARTITION BY k ORDER BY d"

# Length of the non-hold run ending at a row, by islands of equal direction.
_STREAK = f"""(SELECT *, CASE WHEN dir = 0 THEN 0 ELSE row_number() OVER (PARTITION BY k, island ORDER BY ts) END AS run
  FROM (SELECT *, sum(brk) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
    FROM (SELECT *, CASE WHEN lag(dir) OVER ({_W}) = dir THEN 0 ELSE 1 END AS brk FROM dec)))"""

_SUM3 = "coalesce(lag({0}, 1) OVER (%s), 0) + coalesce(lag({0}, 2) OVER (%s), 0) + coalesce(lag({0}, 3) OVER (%s), 0)" % (
    _W,
    _W,
    _W,
)
_CHANGED = f"last_value(CASE WHEN is_change = 1 THEN ts END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SINCE = f"CAST(least(greatest(coalesce(datediff('day', CAST({_CHANGED} AS DATE), CAST(ts AS DATE)), 3650), 0), 3650) AS INTEGER)"
_PREV_DAYS = f"CAST(coalesce(datediff('day', CAST(lag(ts) OVER ({_W}) AS DATE), CAST(ts AS DATE)), 0) AS INTEGER)"


@query(
    "lag_filled",
    with_views(
        "dec",
        f"""SELECT event_id, coalesce(lag(is_change, 1) OVER ({_W}), 0) AS prior_change,
        coalesce(lag(is_change, 2) OVER ({_W}), 0) AS prior2_change FROM dec""",
    ),
)
def lag_filled(spark, sf):
    out = fx.decisions(spark, sf)
    out = w.lag_filled(out, key=_K, order="ts", ties=["event_id"], value="is_change", n=1, out="prior_change")
    out = w.lag_filled(out, key=_K, order="ts", ties=["event_id"], value="is_change", n=2, out="prior2_change")
    return out.select("event_id", "prior_change", "prior2_change")


@query(
    "prior_rolling_sum",
    with_views(
        "dec",
        f"SELECT event_id, {_SUM3.format('is_change')} AS changes, {_SUM3.format('dir')} AS direction FROM dec",
    ),
)
def prior_rolling_sum(spark, sf):
    out = fx.decisions(spark, sf)
    out = w.prior_rolling_sum(out, key=_K, order="ts", ties=["event_id"], value="is_change", out="changes")
    out = w.prior_rolling_sum(out, key=_K, order="ts", ties=["event_id"], value="dir", out="direction")
    return out.select("event_id", "changes", "direction")


@query(
    "prior_streak",
    with_views(
        "dec",
        f"SELECT event_id, coalesce(lag(run) OVER ({_W}), 0) AS streak FROM {_STREAK}",
    ),
)
def prior_streak(spark, sf):
    coded = fx.decisions(spark, sf).withColumn("dir", encode_direction(F.col("decision")))
    out = w.prior_streak(coded, key=_K, order="ts", ties=["event_id"], direction="dir", out="streak")
    return out.select("event_id", "streak")


@query(
    "days_since_prior_event",
    with_views(
        "h",
        f"""SELECT k, CAST(d AS VARCHAR) AS d, CAST(coalesce(datediff('day', lag(d) OVER ({_WD}), d), 0) AS INTEGER) AS days
        FROM h""",
    ),
)
def days_since_prior_event(spark, sf):
    # One event per customer and day: bounded by the calendar.
    out = w.days_since_prior_event(
        fx.customer_history(spark, sf), key=_K, date="d", out="days", slices=None
    )
    return out.select("k", F.col("d").cast("string").alias("d"), "days")


@query(
    "days_since_prior_change",
    with_views("dec", f"SELECT event_id, {_SINCE} AS days FROM dec"),
)
def days_since_prior_change(spark, sf):
    out = w.days_since_prior_change(
        fx.decisions(spark, sf), key=_K, date="ts", ties=["event_id"], flag="is_change", out="days"
    )
    return out.select("event_id", "days")


@query(
    "history_features",
    with_views(
        "dec",
        f"""SELECT event_id, coalesce(lag(dir) OVER ({_W}), 0) AS prior_decision,
        coalesce(lag(is_change, 1) OVER ({_W}), 0) AS prior_is_change,
        coalesce(lag(is_change, 2) OVER ({_W}), 0) AS prior2_is_change,
        {_SUM3.format('is_change')} AS prior3_change_count, {_SUM3.format('dir')} AS prior3_direction,
        coalesce(lag(value) OVER ({_W}), 0.0) AS prior_rate_change_bps,
        coalesce(lag(run) OVER ({_W}), 0) AS same_direction_streak,
        {_PREV_DAYS} AS days_since_prior_meeting, {_SINCE} AS days_since_prior_change FROM {_STREAK}""",
    ),
)
def history_features(spark, sf):
    return fx.decision_features(spark, sf).select("event_id", *fx.HISTORY_FEATURES)


@query(
    "no_lookahead_recheck",
    """SELECT 'rows_that_change' AS check_name, CAST(0 AS BIGINT) AS n UNION ALL
    SELECT 'rows_checked', count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-16 00:00:00'""",
)
def no_lookahead_recheck(spark, sf):
    data = fx.decisions(spark, sf)
    cutoff = F.lit(dt.datetime(2024, 1, 16)).cast("timestamp_ntz")
    changed = w.no_lookahead_recheck(
        data, key=_K, date="ts", ties=["event_id"], cutoff=cutoff, size="value", scheduled=None
    )
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("check_name"), "n"
    )
    return count(changed, "rows_that_change").unionByName(
        count(data.where(F.col("ts") <= cutoff), "rows_checked")
    )
