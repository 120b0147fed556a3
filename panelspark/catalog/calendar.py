"""Resampling, fills, month windows and the splice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import windows as w
from . import fixtures as fx
from .fixtures import plain
from .registry import query, with_views

_K = ["k"]


def months(spark, sf):
    return cal.resample_month_end_last(fx.series(spark, sf), key=_K, date="d", values=["v"])


def sparse_months(spark, sf):
    return cal.resample_month_end_last(fx.sparse_series(spark, sf), key=_K, date="d", values=["v"])


_SPARSE_M = """(SELECT g.k, g.d, x.v FROM (
  SELECT k, last_day(CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE)) AS d
  FROM sparse GROUP BY k) g
  LEFT JOIN (SELECT k, last_day(d) AS d, arg_max(v, d) FILTER (WHERE v IS NOT NULL) AS v FROM sparse GROUP BY 1, 2) x
  ON g.k = x.k AND g.d = x.d)"""


@query(
    "resample_month_end_last",
    with_views("sparse", f"SELECT k, CAST(d AS VARCHAR) AS d, v FROM {_SPARSE_M}"),
)
def resample(spark, sf):
    return plain(sparse_months(spark, sf))


@query(
    "resample_history_month_end",
    with_views(
        "h",
        """SELECT g.k, CAST(g.d AS VARCHAR) AS d, x.v FROM (
        SELECT k, last_day(CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE)) AS d
        FROM h GROUP BY k) g
        LEFT JOIN (SELECT k, last_day(d) AS d, arg_max(v, d) AS v FROM h GROUP BY 1, 2) x ON g.k = x.k AND g.d = x.d""",
    ),
)
def resample_history(spark, sf):
    """Many keys with gap months: empty months appear as NULL rows."""
    return plain(
        cal.resample_month_end_last(fx.customer_history(spark, sf), key=_K, date="d", values=["v"])
    )


@query(
    "forward_fill",
    with_views(
        "s",
        """SELECT g.k, CAST(g.d AS VARCHAR) AS d,
        last_value(s.v IGNORE NULLS) OVER (PARTITION BY g.k ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
        FROM (SELECT k, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM s GROUP BY k) g
        LEFT JOIN (SELECT k, d, CASE WHEN v > 20000 THEN v END AS v FROM s) s ON g.k = s.k AND g.d = s.d""",
    ),
)
def forward_fill(spark, sf):
    daily = cal.densify(fx.sparse_series(spark, sf), key=_K, date="d", unit="day")
    return plain(cal.forward_fill(daily, key=_K, order="d", values=["v"]))


@query(
    "series_date_bounds",
    with_views(
        "meas market",
        """SELECT k, count(*) AS series_count, CAST(max(lo) AS VARCHAR) AS latest_start,
        CAST(min(hi) AS VARCHAR) AS earliest_end, CAST(max(hi) AS VARCHAR) AS latest_end
        FROM (SELECT k, series_id, min(date) AS lo, max(date) AS hi FROM market WHERE value > 3 GROUP BY 1, 2) GROUP BY k""",
    ),
)
def series_date_bounds(spark, sf):
    market = fx.macro_inputs(fx.measures(spark, sf))["market"]
    shown = market.withColumn("value", F.when(F.col("value") > 3, F.col("value")))
    return plain(
        cal.series_date_bounds(shown, key=_K, series_id="series_id", date="date", value="value")
    )


_GRID = "PARTITION BY k ORDER BY d"


@query(
    "pct_change_complete",
    with_views(
        "sparse",
        f"""SELECT k, CAST(d AS VARCHAR) AS d, round(CASE WHEN count(v) OVER ({_GRID} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 13
        THEN (v / lag(v, 12) OVER ({_GRID}) - 1) * 100.0 END, 8) AS yoy FROM {_SPARSE_M}""",
    ),
)
def pct_change(spark, sf):
    out = w.pct_change_complete(sparse_months(spark, sf), key=_K, order="d", value="v", out="yoy")
    return plain(out.select("k", "d", F.round("yoy", 8).alias("yoy")))


@query(
    "diff_n",
    with_views(
        "sparse",
        f"""SELECT k, CAST(d AS VARCHAR) AS d, round(v - lag(v, 1) OVER ({_GRID}), 4) AS chg1,
        round(v - lag(v, 3) OVER ({_GRID}), 4) AS chg3 FROM {_SPARSE_M}""",
    ),
)
def diff_n(spark, sf):
    out = sparse_months(spark, sf)
    for n in (1, 3):
        out = w.diff_n(out, key=_K, order="d", value="v", n=n, out=f"chg{n}")
    return plain(out.drop("v"), digits=4)


@query(
    "rolling_mean_full",
    with_views(
        "sparse",
        f"""SELECT k, CAST(d AS VARCHAR) AS d,
        round((lag(v, 2) OVER ({_GRID}) + lag(v, 1) OVER ({_GRID}) + v) / 3, 4) AS ma3,
        round((lag(v, 5) OVER ({_GRID}) + lag(v, 4) OVER ({_GRID}) + lag(v, 3) OVER ({_GRID})
          + lag(v, 2) OVER ({_GRID}) + lag(v, 1) OVER ({_GRID}) + v) / 6, 4) AS ma6 FROM {_SPARSE_M}""",
    ),
)
def rolling_mean(spark, sf):
    out = sparse_months(spark, sf)
    for n in (3, 6):
        out = w.rolling_mean_full(out, key=_K, order="d", value="v", n=n, out=f"ma{n}")
    return plain(out.drop("v"), digits=4)


def _splice(spark, sf):
    x = fx.macro_inputs(fx.measures(spark, sf))
    return x, cal.splice_series(x["point"], x["lower"], x["upper"], key=_K)


@query(
    "splice_series",
    with_views(
        "pol",
        "SELECT k, CAST(date AS VARCHAR) AS date, target_lower, target_upper, policy_rate, policy_regime FROM pol",
    ),
)
def splice(spark, sf):
    return plain(_splice(spark, sf)[1])


@query(
    "splice_regime_flag",
    with_views(
        "meas",
        """SELECT m.k, CASE WHEN m.date < r.rs THEN 'point_target' ELSE 'target_range' END AS regime, count(*) AS days
        FROM meas m JOIN (SELECT k, min(date) AS rs FROM meas WHERE date >= DATE '1998-01-01' AND qlo < qhi GROUP BY k) r
        ON m.k = r.k GROUP BY 1, 2""",
    ),
)
def splice_regime(spark, sf):
    x = fx.macro_inputs(fx.measures(spark, sf))
    start = x["lower"].groupBy("k").agg(F.min("date").alias("start"))
    flagged = x["point"].join(start, "k")
    regime = cal.splice_regime_flag(F.col("date"), F.col("start")).alias("regime")
    return flagged.groupBy("k", regime).agg(F.count(F.lit(1)).alias("days"))
