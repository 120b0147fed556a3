"""As-of and equi-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import label_by_tolerance
from ..operators import joins as j
from ..operators.asof import (
    asof_calendar_offset,
    asof_join,
    asof_multi,
    asof_reconcile,
    stale_or_missing,
)
from ..operators.calendar import calendar_spine, calendar_spine_join, resample_month_end_last
from ..operators.metrics import class_counts_zero_filled, predict_correct_flag
from . import fixtures as fx
from .fixtures import plain
from .registry import query, with_views

_PICK = {"v": "value"}


def _asof(spark, sf, **kw):
    return asof_join(
        fx.order_events(spark, sf),
        fx.series(spark, sf),
        key=["k"],
        left_date="d",
        right_date="d",
        values=_PICK,
        reference_col="ref",
        **kw,
    )


_SHAPE = ["event_id", "k", "d", "value", "ref"]


@query(
    "asof_backward",
    with_views(
        "s e",
        "SELECT e.event_id, e.k, CAST(e.d AS VARCHAR) AS d, s.v AS value, CAST(s.d AS VARCHAR) AS ref "
        "FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.d >= s.d",
    ),
)
def asof_backward(spark, sf):
    return plain(_asof(spark, sf).select(*_SHAPE))


def _tolerant(op: str, age: str) -> str:
    return with_views(
        "s e",
        f"""SELECT e.event_id, e.k, CAST(e.d AS VARCHAR) AS d,
        CASE WHEN {age} <= 7 THEN s.v END AS value,
        CASE WHEN {age} <= 7 THEN CAST(s.d AS VARCHAR) END AS ref
        FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.d {op} s.d""",
    )


@query("asof_backward_strict_tol", _tolerant(">", "datediff('day', s.d, e.d)"))
def asof_backward_strict_tol(spark, sf):
    return plain(_asof(spark, sf, allow_exact=False, tolerance_days=7).select(*_SHAPE))


@query("asof_forward_strict_tol", _tolerant("<", "datediff('day', e.d, s.d)"))
def asof_forward_strict_tol(spark, sf):
    return plain(
        _asof(spark, sf, direction="forward", allow_exact=False, tolerance_days=7).select(*_SHAPE)
    )


@query(
    "asof_backward_strict_stale_raise",
    with_views(
        "s e",
        """SELECT e.event_id, e.k, s.v AS value, CAST(s.d AS VARCHAR) AS ref,
        CASE WHEN s.d IS NULL THEN 'missing' WHEN datediff('day', s.d, e.d) > 10 THEN 'stale' ELSE 'ok' END AS ref_status
        FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.d > s.d""",
    ),
)
def asof_backward_strict_stale_raise(spark, sf):
    found = _asof(spark, sf, allow_exact=False)
    marked = stale_or_missing(found, event_date="d", reference_cols=["ref"], max_age_days=10)
    return plain(marked.select("event_id", "k", "value", "ref", "ref_status"))


@query(
    "asof_multi",
    with_views(
        "meas ev market",
        """SELECT ev.k, CAST(ev.meeting_date AS VARCHAR) AS meeting_date,
        a.value AS treasury_3m_pct, CAST(a.date AS VARCHAR) AS treasury_3m_pct_reference_date,
        b.value AS treasury_1y_pct, CAST(b.date AS VARCHAR) AS treasury_1y_pct_reference_date,
        c.value AS curve_10y_minus_2y_pct, CAST(c.date AS VARCHAR) AS curve_10y_minus_2y_pct_reference_date
        FROM ev
        ASOF LEFT JOIN (SELECT * FROM market WHERE series_id = 'treasury_3m_pct') a ON ev.k = a.k AND ev.meeting_date > a.date
        ASOF LEFT JOIN (SELECT * FROM market WHERE series_id = 'treasury_1y_pct') b ON ev.k = b.k AND ev.meeting_date > b.date
        ASOF LEFT JOIN (SELECT * FROM market WHERE series_id = 'curve_10y_minus_2y_pct') c ON ev.k = c.k AND ev.meeting_date > c.date""",
    ),
)
def asof_multi_query(spark, sf):
    ids = ["treasury_3m_pct", "treasury_1y_pct", "curve_10y_minus_2y_pct"]
    found = asof_multi(
        fx.daily_events(spark, sf).select("k", "meeting_date"),
        fx.macro_inputs(fx.measures(spark, sf))["market"],
        key=["k"],
        event_date="meeting_date",
        series_ids=ids,
        allow_exact=False,
        left_unique=True,
    )
    return plain(found)


@query(
    "asof_calendar_offset",
    with_views(
        "s e",
        """SELECT x.event_id, x.k, x.now_v - a.v AS chg_1m, x.now_v - b.v AS chg_3m FROM
        (SELECT e.*, s.v AS now_v FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.d >= s.d) x
        ASOF LEFT JOIN s a ON x.k = a.k AND CAST(x.d - INTERVAL 1 MONTH AS DATE) >= a.d
        ASOF LEFT JOIN s b ON x.k = b.k AND CAST(x.d - INTERVAL 3 MONTH AS DATE) >= b.d""",
    ),
)
def asof_calendar_offset_query(spark, sf):
    now = _asof(spark, sf)
    then = asof_calendar_offset(
        now, fx.series(spark, sf), key=["k"], event_date="d", series_date="d", value="v", out="then_{}"
    )
    return then.select(
        "event_id",
        "k",
        (F.col("value") - F.col("then_1")).alias("chg_1m"),
        (F.col("value") - F.col("then_3")).alias("chg_3m"),
    )


@query(
    "asof_reconcile",
    with_views(
        "s e m",
        """SELECT p.event_id, p.k, p.value, r.v AS raw_value,
        coalesce(abs(p.value - r.v) <= 1e-10 + 1e-5 * abs(r.v), false) AS reconciled
        FROM (SELECT e.event_id, e.k, m.v AS value, m.d AS ref FROM e ASOF LEFT JOIN
              (SELECT * FROM m WHERE v IS NOT NULL) m ON e.k = m.k AND e.d >= m.d) p
        ASOF LEFT JOIN s r ON p.k = r.k AND p.ref >= r.d""",
    ),
)
def asof_reconcile_query(spark, sf):
    raw = fx.series(spark, sf)
    monthly = resample_month_end_last(raw, key=["k"], date="d", values=["v"])
    panel = asof_join(
        fx.order_events(spark, sf),
        j.filter_available(monthly, value="v"),
        key=["k"],
        left_date="d",
        right_date="d",
        values=_PICK,
        reference_col="ref",
    ).select("event_id", "k", "value", "ref")
    audited = asof_reconcile(
        panel, raw, key=["k"], date="ref", value="value", series_date="d", series_value="v"
    )
    return audited.select("event_id", "k", "value", "raw_value", "reconciled")


@query(
    "filter_available",
    with_views(
        "sparse e",
        """SELECT e.event_id, e.k, s.v AS value, CAST(s.d AS VARCHAR) AS ref FROM e
        ASOF LEFT JOIN (SELECT * FROM sparse WHERE v IS NOT NULL) s ON e.k = s.k AND e.d >= s.d""",
    ),
)
def filter_available(spark, sf):
    usable = j.filter_available(fx.sparse_series(spark, sf), value="v")
    found = asof_join(
        fx.order_events(spark, sf),
        usable,
        key=["k"],
        left_date="d",
        right_date="d",
        values=_PICK,
        reference_col="ref",
    )
    return plain(found.select("event_id", "k", "value", "ref"))


@query(
    "left_join_one_to_one",
    with_views(
        "s h",
        """SELECT x.k, CAST(x.d AS VARCHAR) AS d, x.v AS shipped, y.v AS ordered FROM s x
        LEFT JOIN (SELECT k, d, max(v) AS v FROM h GROUP BY 1, 2) y ON x.k = y.k AND x.d = y.d""",
    ),
)
def left_join_one_to_one(spark, sf):
    left = fx.series(spark, sf).withColumnRenamed("v", "shipped")
    right = fx.customer_history(spark, sf).withColumnsRenamed({"v": "ordered"})
    right = right.select(F.col("k").cast("int").alias("k"), "d", "ordered")
    return plain(j.left_join_one_to_one(left, right, on=["k", "d"], check="plan"))


@query(
    "exact_date_lookup",
    with_views(
        "m e",
        """SELECT e.event_id, e.k, m.v AS month_value,
        m.v - lag_v AS month_change FROM e LEFT JOIN
        (SELECT k, d, v, lag(v) OVER (PARTITION BY k ORDER BY d) AS lag_v FROM m) m
        ON e.k = m.k AND last_day(e.d) = m.d""",
    ),
)
def exact_date_lookup(spark, sf):
    from ..operators.windows import diff_n

    monthly = resample_month_end_last(fx.series(spark, sf), key=["k"], date="d", values=["v"])
    monthly = diff_n(monthly, key=["k"], order="d", value="v", n=1, out="chg")
    events = fx.order_events(spark, sf).withColumn("month", F.last_day("d"))
    found = j.exact_date_lookup(
        events,
        monthly,
        key=["k"],
        left_date="month",
        right_date="d",
        values={"v": "month_value", "chg": "month_change"},
    )
    return found.select("event_id", "k", "month_value", "month_change")


@query(
    "missing_dates",
    with_views(
        "s e",
        """SELECT DISTINCT k, CAST(d AS VARCHAR) AS d FROM e
        WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = e.k AND s.d = e.d)""",
    ),
)
def missing_dates(spark, sf):
    return plain(
        j.missing_dates(
            fx.order_events(spark, sf), fx.series(spark, sf), key=["k"], left_date="d", right_date="d"
        )
    )


@query(
    "calendar_spine_join",
    with_views(
        "s",
        """SELECT g.k, CAST(g.d AS VARCHAR) AS d, s.v FROM
        (SELECT k, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM s GROUP BY k) g
        LEFT JOIN s ON g.k = s.k AND g.d = s.d""",
    ),
)
def calendar_spine_join_query(spark, sf):
    return plain(calendar_spine_join(fx.series(spark, sf), key=["k"], date="d", unit="day"))


@query(
    "calendar_spine",
    with_views(
        "h",
        """SELECT k, CAST(last_day(CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE)) AS VARCHAR) AS d
        FROM h GROUP BY k""",
    ),
)
def calendar_spine_query(spark, sf):
    return plain(calendar_spine(fx.customer_history(spark, sf), key=["k"], date="d", unit="month_end"))


@query(
    "prediction_context_join",
    with_views(
        "c",
        """SELECT c.doc_id, c.actual, c.predicted, c.actual = c.predicted AS correct, d.lang, d.n_chars,
        l.toxic, l.toxic IS NULL OR d.lang IS NULL OR d.n_chars IS NULL AS context_missing
        FROM c LEFT JOIN documents d ON c.doc_id = d.doc_id LEFT JOIN labels l ON c.doc_id = l.doc_id""",
    ),
)
def prediction_context_join(spark, sf):
    pairs = predict_correct_flag(fx.class_pairs(spark, sf), actual="actual", predicted="predicted")
    docs = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id", "left")
    return j.prediction_context_join(
        pairs, docs, on=["doc_id"], context=["lang", "n_chars", "toxic"]
    )


_BOTH = """SELECT e.event_id, e.k, CASE WHEN datediff('day', b.d, e.d) <= 7 THEN b.v END AS before,
        CASE WHEN datediff('day', e.d, f.d) <= 7 THEN f.v END AS after
        FROM e ASOF LEFT JOIN s b ON e.k = b.k AND e.d > b.d ASOF LEFT JOIN s f ON e.k = f.k AND e.d < f.d"""


def before_after(spark, sf):
    """Each event with the series just before and just after it, within a week."""
    from ..operators.asof import Pick, Source, asof_many

    around = Source(
        fx.series(spark, sf),
        "d",
        [
            Pick({"v": "before"}, reference_col="before_date", tolerance_days=7),
            Pick({"v": "after"}, reference_col="after_date", tolerance_days=7, direction="forward"),
        ],
        allow_exact=False,
    )
    return asof_many(fx.order_events(spark, sf), [around], key=["k"], left_date="d")


@query(
    "drop_null_required",
    with_views("s e", f"SELECT * FROM ({_BOTH}) WHERE before IS NOT NULL AND after IS NOT NULL"),
)
def drop_null_required(spark, sf):
    from ..operators.quality import drop_null_required as drop

    return drop(before_after(spark, sf), ["before", "after"]).select(
        "event_id", "k", "before", "after"
    )


@query(
    "label_by_tolerance",
    with_views(
        "s e",
        f"""SELECT event_id, k, (after - before) * 100.0 AS rate_change_bps,
        CASE WHEN (after - before) * 100.0 > 0.25 THEN 'hike' WHEN (after - before) * 100.0 < -0.25 THEN 'cut' ELSE 'hold' END AS decision,
        CASE WHEN abs((after - before) * 100.0) > 0.25 THEN 1 ELSE 0 END AS is_change
        FROM ({_BOTH}) WHERE before IS NOT NULL AND after IS NOT NULL""",
    ),
)
def label_by_tolerance_query(spark, sf):
    labelled = label_by_tolerance(
        before_after(spark, sf).dropna(subset=["before", "after"]), before="before", after="after"
    )
    return labelled.select("event_id", "k", "rate_change_bps", "decision", "is_change")


@query(
    "class_counts_zero_filled",
    with_views(
        "s e",
        f"""SELECT l.decision, count(x.event_id) AS n FROM (VALUES ('cut'), ('hold'), ('hike')) l(decision)
        LEFT JOIN (SELECT event_id, CASE WHEN (after - before) * 100.0 > 0.25 THEN 'hike'
          WHEN (after - before) * 100.0 < -0.25 THEN 'cut' ELSE 'hold' END AS decision
          FROM ({_BOTH}) WHERE before IS NOT NULL AND after IS NOT NULL) x ON l.decision = x.decision GROUP BY 1""",
    ),
)
def class_counts(spark, sf):
    from ..functions.constants import DECISION_CLASSES

    labelled = label_by_tolerance(
        before_after(spark, sf).dropna(subset=["before", "after"]), before="before", after="after"
    )
    return class_counts_zero_filled(labelled, label="decision", labels=DECISION_CLASSES)
