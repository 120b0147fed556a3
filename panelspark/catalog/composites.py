"""Composite pipelines over the keyed measures of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import quality as q
from ..operators.calendar import splice_series
from ..plans import features as pf
from ..plans import macro as pm
from . import fixtures as fx
from .fixtures import plain
from .registry import query, with_views

_KEY = ["k"]


def inputs(spark, sf) -> dict:
    """Raw series as a written table, read several times, and their sources."""
    return fx.macro_inputs(fx.materialise(fx.measures(spark, sf), "measures"))


def policy_of(x: dict):
    return splice_series(x["point"], x["lower"], x["upper"], key=_KEY)


def monthly_of(x: dict, policy):
    return pm.monthly_panel(
        policy,
        pm.inflation_monthly(x["index"], key=_KEY),
        pm.labour_panel(x["unemployment"], x["natural"], key=_KEY),
        key=_KEY,
    )


@query(
    "inflation_monthly",
    with_views("inf", "SELECT k, CAST(date AS VARCHAR) AS date, pce_index, round(pce_yoy, 8) AS pce_yoy FROM inf"),
)
def inflation_monthly(spark, sf):
    x = fx.macro_inputs(fx.measures(spark, sf))
    return plain(pm.inflation_monthly(x["index"], key=_KEY), digits=8)


@query(
    "labour_panel",
    with_views("lab", "SELECT k, CAST(date AS VARCHAR) AS date, unemployment, natural_unemployment FROM lab"),
)
def labour_panel(spark, sf):
    x = inputs(spark, sf)
    return plain(pm.labour_panel(x["unemployment"], x["natural"], key=_KEY))


@query(
    "monthly_panel",
    with_views("panel", "SELECT * REPLACE (CAST(date AS VARCHAR) AS date, round(pce_yoy, 8) AS pce_yoy) FROM panel"),
)
def monthly_panel(spark, sf):
    x = inputs(spark, sf)
    return plain(monthly_of(x, policy_of(x)), digits=8)


_REFS = (
    "meeting_date",
    "pce_reference_date",
    "unemployment_reference_date",
    "natural_unemployment_reference_date",
    "policy_date_before",
    "policy_date_after",
)
_ISO = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _REFS)


def _aligned(spark, sf):
    x = inputs(spark, sf)
    policy = fx.materialise(policy_of(x), "policy")
    events = fx.daily_events(spark, sf)
    return x, policy, pm.event_alignment(monthly_of(x, policy), policy, events, key=_KEY)


@query(
    "event_alignment",
    with_views("aligned", f"SELECT * REPLACE ({_ISO}, round(pce_yoy, 8) AS pce_yoy) FROM aligned"),
)
def event_alignment(spark, sf):
    return plain(_aligned(spark, sf)[2], digits=8)


def clean_of(spark, sf):
    """Inputs with the daily policy as a written table, good and rejected events."""
    x = inputs(spark, sf)
    x["policy"] = fx.materialise(policy_of(x), "policy")
    panel = pm.build_clean_panel(
        point=x["point"],
        lower=x["lower"],
        upper=x["upper"],
        index=x["index"],
        unemployment=x["unemployment"],
        natural=x["natural"],
        events=fx.daily_events(spark, sf),
        key=_KEY,
        policy=x["policy"],
        on_violation="quarantine",
    )
    return x, *panel


@query(
    "clean_panel",
    with_views(
        "clean",
        f"""SELECT k, {', '.join(K.CLEAN_COLUMNS)} FROM
        (SELECT * REPLACE ({_ISO}, round(pce_yoy, 8) AS pce_yoy) FROM clean)""",
    ),
)
def clean_panel(spark, sf):
    return plain(clean_of(spark, sf)[1], digits=8)


@query(
    "clean_panel_rejects",
    with_views(
        "labelled",
        """SELECT k, CAST(meeting_date AS VARCHAR) AS meeting_date,
        pce_reference_date IS NULL AS no_inflation FROM labelled
        WHERE pce_reference_date IS NULL OR unemployment_reference_date IS NULL OR natural_unemployment_reference_date IS NULL""",
    ),
)
def clean_panel_rejects(spark, sf):
    bad = clean_of(spark, sf)[2]
    missing = F.array_contains("broken_rules", "not_null:pce_reference_date")
    return plain(bad.select("k", "meeting_date", missing.alias("no_inflation")))


_RATE = """(SELECT c.*, c.policy_rate_before AS rate_level, c.policy_rate_before - a.policy_rate AS rate_chg_1m,
  c.policy_rate_before - b.policy_rate AS rate_chg_3m FROM clean c
  ASOF LEFT JOIN pol a ON c.k = a.k AND CAST(c.meeting_date - INTERVAL 1 MONTH AS DATE) >= a.date
  ASOF LEFT JOIN pol b ON c.k = b.k AND CAST(c.meeting_date - INTERVAL 3 MONTH AS DATE) >= b.date)"""


def _clean_and_policy(spark, sf):
    x, good, _ = clean_of(spark, sf)
    return x, x["policy"], fx.materialise(good, "clean_panel")


@query(
    "rate_features",
    with_views(
        "clean pol",
        f"SELECT k, CAST(meeting_date AS VARCHAR) AS meeting_date, rate_level, rate_chg_1m, rate_chg_3m FROM {_RATE}",
    ),
)
def rate_features(spark, sf):
    _, policy, panel = _clean_and_policy(spark, sf)
    out = pf.rate_features(panel, policy, key=_KEY)
    return plain(out.select("k", "meeting_date", "rate_level", "rate_chg_1m", "rate_chg_3m"))


@query(
    "rate_reconciliation",
    with_views("clean", "SELECT k, true AS reconciled, count(*) AS n FROM clean GROUP BY k"),
)
def rate_reconciliation(spark, sf):
    _, policy, panel = _clean_and_policy(spark, sf)
    out = pf.rate_reconciliation(panel, policy, key=_KEY)
    return out.groupBy("k", "reconciled").agg(F.count(F.lit(1)).alias("n"))


_WM = "PARTITION BY k ORDER BY date"


def _lags(c: str, n: int) -> str:
    return "(" + " + ".join([f"lag({c}, {i}) OVER ({_WM})" for i in range(n - 1, 0, -1)] + [c]) + f") / {n}"


_INF_WINDOWS = f"""(SELECT k, date, pce_yoy - lag(pce_yoy, 1) OVER ({_WM}) AS pce_yoy_chg, pce_yoy - lag(pce_yoy, 3) OVER ({_WM}) AS pce_yoy_chg3,
  {_lags('pce_yoy', 3)} AS pce_yoy_ma3, {_lags('pce_yoy', 6)} AS pce_yoy_ma6 FROM inf)"""
_LAB_WINDOWS = f"""(SELECT k, date, unemployment - lag(unemployment, 1) OVER ({_WM}) AS unemp_chg, unemployment - lag(unemployment, 3) OVER ({_WM}) AS unemp_chg3,
  {_lags('unemployment', 3)} AS unemp_ma3 FROM mon)"""


@query(
    "inflation_features",
    with_views(
        "clean inf",
        f"""SELECT c.k, CAST(c.meeting_date AS VARCHAR) AS meeting_date, round(pce_yoy_chg, 6) AS pce_yoy_chg, round(pce_yoy_chg3, 6) AS pce_yoy_chg3,
        round(pce_yoy_ma3, 6) AS pce_yoy_ma3, round(pce_yoy_ma6, 6) AS pce_yoy_ma6, true AS inflation_reconciled
        FROM clean c LEFT JOIN {_INF_WINDOWS} w ON c.k = w.k AND c.pce_reference_date = w.date""",
    ),
)
def inflation_features(spark, sf):
    x, good, _ = clean_of(spark, sf)
    out = pf.inflation_features(good, x["index"], key=_KEY)
    names = ["pce_yoy_chg", "pce_yoy_chg3", "pce_yoy_ma3", "pce_yoy_ma6", "inflation_reconciled"]
    return plain(out.select("k", "meeting_date", *names), digits=6)


@query(
    "labour_features",
    with_views(
        "clean mon",
        f"""SELECT c.k, CAST(c.meeting_date AS VARCHAR) AS meeting_date, round(unemp_chg, 6) AS unemp_chg, round(unemp_chg3, 6) AS unemp_chg3,
        round(unemp_ma3, 6) AS unemp_ma3, true AS labour_reconciled
        FROM clean c LEFT JOIN {_LAB_WINDOWS} w ON c.k = w.k AND c.unemployment_reference_date = w.date""",
    ),
)
def labour_features(spark, sf):
    x, good, _ = clean_of(spark, sf)
    out = pf.labour_features(good, x["unemployment"], key=_KEY)
    names = ["unemp_chg", "unemp_chg3", "unemp_ma3", "labour_reconciled"]
    return plain(out.select("k", "meeting_date", *names), digits=6)


_MARKET_JOIN = "\n".join(
    f"ASOF LEFT JOIN (SELECT k, date, value FROM market WHERE series_id = '{c}') m{i} ON c.k = m{i}.k AND c.meeting_date > m{i}.date"
    for i, c in enumerate(K.MARKET_COLUMNS)
)
_MARKET_VALUES = ", ".join(f"m{i}.value AS {c}" for i, c in enumerate(K.MARKET_COLUMNS))
_SPREADS = ", ".join(f"{v} - rate_level AS {s}" for v, s in K.SPREAD_PAIRS)
_SPREAD_NAMES = [s for _, s in K.SPREAD_PAIRS]


@query(
    "market_features",
    with_views(
        "clean market",
        f"""SELECT k, CAST(meeting_date AS VARCHAR) AS meeting_date, CAST(market_date AS VARCHAR) AS market_date,
        {', '.join(K.MARKET_COLUMNS)}, {_SPREADS} FROM
        (SELECT c.k, c.meeting_date, c.policy_rate_before AS rate_level, m0.date AS market_date, {_MARKET_VALUES} FROM clean c {_MARKET_JOIN})""",
    ),
)
def market_features(spark, sf):
    x, good, _ = clean_of(spark, sf)
    panel = good.withColumn("rate_level", F.col("policy_rate_before"))
    out = pf.market_features(panel, x["market"], key=_KEY)
    return plain(
        out.select(
            "k",
            "meeting_date",
            F.col("treasury_3m_pct_reference_date").alias("market_date"),
            *K.MARKET_COLUMNS,
            *_SPREAD_NAMES,
        )
    )


_WH = "PARTITION BY k ORDER BY meeting_date"
_CHANGED = f"last_value(CASE WHEN is_change = 1 THEN meeting_date END IGNORE NULLS) OVER ({_WH} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _prior3(c: str) -> str:
    return " + ".join(f"coalesce(lag({c}, {i}) OVER ({_WH}), 0)" for i in (1, 2, 3))


# All features of the clean events whose market values are present and fresh.
_FULL = f"""(
  SELECT r.k, r.meeting_date, rate_level, rate_chg_1m, rate_chg_3m, pce_yoy, pce_yoy_chg, pce_yoy_chg3, pce_yoy_ma3, pce_yoy_ma6,
    unemployment, unemp_chg, unemp_chg3, unemp_ma3, natural_unemployment, abs(pce_yoy - 2.0) AS abs_inflation_gap,
    {', '.join(K.MARKET_COLUMNS)}, {_SPREADS},
    CASE WHEN is_scheduled THEN 1 ELSE 0 END AS is_scheduled, prior_decision, prior_is_change, prior2_is_change, prior3_change_count,
    prior3_direction, prior_rate_change_bps, same_direction_streak, days_since_prior_meeting, days_since_prior_change, is_change, decision,
    market_date
  FROM {_RATE} r
  LEFT JOIN {_INF_WINDOWS} wi ON r.k = wi.k AND r.pce_reference_date = wi.date
  LEFT JOIN {_LAB_WINDOWS} wl ON r.k = wl.k AND r.unemployment_reference_date = wl.date
  LEFT JOIN (SELECT c.k, c.meeting_date, m0.date AS market_date, {_MARKET_VALUES} FROM clean c {_MARKET_JOIN}) mk
    ON r.k = mk.k AND r.meeting_date = mk.meeting_date
  LEFT JOIN (SELECT k, meeting_date,
      coalesce(lag(dir) OVER ({_WH}), 0) AS prior_decision, coalesce(lag(is_change, 1) OVER ({_WH}), 0) AS prior_is_change,
      coalesce(lag(is_change, 2) OVER ({_WH}), 0) AS prior2_is_change, {_prior3('is_change')} AS prior3_change_count,
      {_prior3('dir')} AS prior3_direction, coalesce(lag(rate_change_bps) OVER ({_WH}), 0.0) AS prior_rate_change_bps,
      coalesce(lag(run) OVER ({_WH}), 0) AS same_direction_streak,
      CAST(coalesce(datediff('day', lag(meeting_date) OVER ({_WH}), meeting_date), 0) AS INTEGER) AS days_since_prior_meeting,
      CAST(least(coalesce(datediff('day', {_CHANGED}, meeting_date), 3650), 3650) AS INTEGER) AS days_since_prior_change
    FROM (SELECT *, CASE WHEN dir = 0 THEN 0 ELSE row_number() OVER (PARTITION BY k, island ORDER BY meeting_date) END AS run
      FROM (SELECT *, sum(brk) OVER ({_WH} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
        FROM (SELECT *, CASE WHEN lag(dir) OVER ({_WH}) = dir THEN 0 ELSE 1 END AS brk
          FROM (SELECT *, CASE decision WHEN 'hike' THEN 1 WHEN 'cut' THEN -1 ELSE 0 END AS dir FROM clean))))) hi
    ON r.k = hi.k AND r.meeting_date = hi.meeting_date)"""

_INTS = (
    "is_scheduled",
    "prior_decision",
    "prior_is_change",
    "prior2_is_change",
    "prior3_change_count",
    "prior3_direction",
    "same_direction_streak",
    "days_since_prior_meeting",
    "days_since_prior_change",
)
_ROUNDED = ", ".join(
    c if c in _INTS else f"round({c}, 6) AS {c}" for c in K.FEATURE_COLUMNS
)
_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in K.FEATURE_COLUMNS)


def feature_panel_of(spark, sf):
    """Model table and rejected events; each stage is a written table."""
    x, policy, panel = _clean_and_policy(spark, sf)
    return pf.build_feature_panel(
        panel,
        policy=policy,
        index=x["index"],
        unemployment=x["unemployment"],
        market=x["market"],
        key=_KEY,
        on_violation="quarantine",
    )


@query(
    "feature_panel",
    with_views(
        "clean pol inf mon market",
        f"""SELECT k, CAST(meeting_date AS VARCHAR) AS meeting_date, {_ROUNDED}, is_change, decision FROM {_FULL}
        WHERE market_date IS NOT NULL AND datediff('day', market_date, meeting_date) <= 10 AND {_NOT_NULL}
        AND {' AND '.join(f"{c} BETWEEN 0 AND 100" for c in ("rate_level", "unemployment", "natural_unemployment"))}
        AND {' AND '.join(f"{c} BETWEEN -20 AND 30" for c in (*K.MARKET_COLUMNS, *_SPREAD_NAMES))}""",
    ),
)
def feature_panel(spark, sf):
    return plain(feature_panel_of(spark, sf)[0], digits=6)


# Events without a complete, fresh set of features, or outside the ranges.
_FRESH = "market_date IS NOT NULL AND datediff('day', market_date, meeting_date) <= 10"
_BOUNDS = " AND ".join(
    [f"{c} BETWEEN 0 AND 100" for c in ("rate_level", "unemployment", "natural_unemployment")]
    + [f"{c} BETWEEN -20 AND 30" for c in (*K.MARKET_COLUMNS, *_SPREAD_NAMES)]
)


@query(
    "feature_panel_rejects",
    with_views(
        "clean pol inf mon market",
        f"""SELECT k, CAST(meeting_date AS VARCHAR) AS meeting_date, market_date IS NULL AS no_market,
        NOT ({_NOT_NULL}) AS incomplete FROM {_FULL}
        WHERE NOT coalesce({_FRESH} AND {_NOT_NULL} AND {_BOUNDS}, false)""",
    ),
)
def feature_panel_rejects(spark, sf):
    """Every event of the clean panel that is not in the model table."""
    bad = feature_panel_of(spark, sf)[1]
    broken = lambda names: F.arrays_overlap("broken_rules", F.array(*map(F.lit, names)))
    return plain(
        bad.select(
            "k",
            "meeting_date",
            broken([f"missing_match:{c}" for c in K.MARKET_COLUMNS]).alias("no_market"),
            broken([f"finite:{c}" for c in K.FEATURE_COLUMNS]).alias("incomplete"),
        )
    )


@query(
    "rule_reconcile",
    with_views(
        "clean market",
        """SELECT 'reconcile:inflation' AS rule, count(*) FILTER (WHERE k % 5 = 0) AS violations FROM clean UNION ALL
        SELECT 'reconcile:labour', count(*) FILTER (WHERE k % 4 = 1) FROM clean""",
    ),
)
def rule_reconcile(spark, sf):
    """Panel values that differ from the raw history for some entities."""
    x, good, _ = clean_of(spark, sf)
    faulty = good.withColumns(
        {
            "pce_index": F.when(F.col("k") % 5 == 0, F.col("pce_index") * 1.01).otherwise(F.col("pce_index")),
            "unemployment": F.when(F.col("k") % 4 == 1, F.col("unemployment") + 1).otherwise(F.col("unemployment")),
        }
    )
    panel = pf.labour_features(
        pf.inflation_features(faulty, x["index"], key=_KEY), x["unemployment"], key=_KEY
    )
    return q.violations(panel, pf.reconciliation_rules())


def _full_features(spark, sf):
    x, policy, panel = _clean_and_policy(spark, sf)
    return pf.all_features(
        panel, policy=policy, index=x["index"], unemployment=x["unemployment"], market=x["market"], key=_KEY
    )


# All features with faults of every kind, each in an entity of its own.
_FAULTY = f"""(SELECT * REPLACE (CASE WHEN k = 5 THEN rate_level + 1 ELSE rate_level END AS rate_level,
  CASE WHEN k = 7 THEN 'unknown' ELSE decision END AS decision, CASE WHEN k = 8 THEN 2 ELSE is_scheduled END AS is_scheduled,
  CASE WHEN k = 9 THEN -1 ELSE days_since_prior_change END AS days_since_prior_change,
  CASE WHEN k = 10 THEN abs_inflation_gap + 1 ELSE abs_inflation_gap END AS abs_inflation_gap,
  CASE WHEN k = 11 THEN 101 ELSE unemployment END AS unemployment, CASE WHEN k = 12 THEN 1 - is_change ELSE is_change END AS is_change)
  FROM (SELECT * FROM {_FULL} UNION ALL SELECT * FROM {_FULL} WHERE k = 3))"""


def _fault_counts() -> str:
    count = {"not_null:meeting_date": "meeting_date IS NULL"}
    count |= {f"finite:{c}": f"{c} IS NULL" for c in K.FEATURE_COLUMNS}
    count |= {f"range:{c}": f"{c} < 0 OR {c} > 100" for c in ("rate_level", "unemployment", "natural_unemployment")}
    count |= {f"range:{c}": f"{c} < -20 OR {c} > 30" for c in (*K.MARKET_COLUMNS, *_SPREAD_NAMES)}
    count |= {f"range:{c}": f"{c} < 0" for c in ("abs_inflation_gap", "same_direction_streak", "days_since_prior_change")}
    count["domain:decision"] = "decision NOT IN ('cut', 'hold', 'hike')"
    count["domain:is_change"] = "is_change NOT IN (0, 1)"
    count["label:is_change"] = "is_change <> CAST(decision <> 'hold' AS INTEGER)"
    count["domain:is_scheduled"] = "is_scheduled NOT IN (0, 1)"
    count["identity:abs_inflation_gap"] = "pce_yoy IS NULL OR k = 10"
    count |= {f"identity:{s}": f"{v} IS NULL OR rate_level IS NULL OR k = 5" for v, s in K.SPREAD_PAIRS}
    parts = [f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {broken}) AS violations FROM f" for rule, broken in count.items()]
    repeated = "SELECT 'unique:meeting_date', CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM f GROUP BY k, meeting_date)"
    return f"SELECT * FROM (WITH f AS (SELECT * FROM {_FAULTY}) {' UNION ALL '.join([*parts, repeated])})"


@query("feature_panel_rules", with_views("clean pol inf mon market", _fault_counts()))
def feature_panel_rules(spark, sf):
    """Every rule of the final table over all features, with faults of every kind."""
    full = fx.materialise(_full_features(spark, sf), "features")
    k = F.col("k")
    faulty = full.unionByName(full.where(k == 3)).withColumns(
        {
            "rate_level": F.when(k == 5, F.col("rate_level") + 1).otherwise(F.col("rate_level")),
            "decision": F.when(k == 7, "unknown").otherwise(F.col("decision")),
            "is_scheduled": F.when(k == 8, 2).otherwise(F.col("is_scheduled")),
            "days_since_prior_change": F.when(k == 9, -1).otherwise(F.col("days_since_prior_change")),
            "abs_inflation_gap": F.when(k == 10, F.col("abs_inflation_gap") + 1).otherwise(F.col("abs_inflation_gap")),
            "unemployment": F.when(k == 11, 101.0).otherwise(F.col("unemployment")),
            "is_change": F.when(k == 12, 1 - F.col("is_change")).otherwise(F.col("is_change")),
        }
    )
    return q.violations(faulty, pf.feature_panel_rules(_KEY))


@query(
    "project_panel",
    with_views(
        "clean pol inf mon market",
        f"SELECT k, CAST(meeting_date AS VARCHAR) AS meeting_date, {_ROUNDED}, is_change, decision FROM {_FULL}",
    ),
)
def project_panel(spark, sf):
    """The configured columns of every event, incomplete ones included."""
    return plain(pf.project_panel(_full_features(spark, sf), key=_KEY), digits=6)


@query(
    "rule_series_coverage",
    with_views(
        "meas pol mon lab",
        """SELECT b.k, false AS no_point_values, coalesce(p.n IS NULL, true) AS no_range_bounds,
          CAST(coalesce(CASE WHEN b.k % 5 = 0 THEN p.ranged ELSE 0 END, 0) AS BIGINT) AS days_lower_above_upper,
          b.k % 7 = 1 OR m.longest < 13 AS under_13_months, b.k % 6 = 2 OR l.common = 0 AS no_labour_overlap
        FROM (SELECT DISTINCT k FROM meas) b
        LEFT JOIN (SELECT k, count(*) AS n, count(*) FILTER (WHERE policy_regime = 'target_range') AS ranged FROM pol GROUP BY k) p ON b.k = p.k
        LEFT JOIN (SELECT k, max(n) AS longest FROM (SELECT k, g, count(pce_index) AS n FROM
            (SELECT *, sum(CASE WHEN pce_index IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY date) AS g FROM mon)
            GROUP BY k, g) GROUP BY k) m ON b.k = m.k
        LEFT JOIN (SELECT k, count(*) FILTER (WHERE unemployment IS NOT NULL AND natural_unemployment IS NOT NULL) AS common
            FROM lab GROUP BY k) l ON b.k = l.k""",
    ),
)
def rule_series_coverage(spark, sf):
    """Coverage of the raw series, with bounds out of order, a short index and no slow series for some."""
    x = inputs(spark, sf)
    k = F.col("k")
    first = x["index"].groupBy("k").agg(F.min("date").alias("first"))
    short = x["index"].join(first, "k").where((k % 7 != 1) | (F.datediff("date", "first") < 300))
    found = pm.series_coverage(
        point=x["point"],
        lower=x["lower"].withColumn("value", F.when(k % 5 == 0, F.col("value") + 1000).otherwise(F.col("value"))),
        upper=x["upper"],
        index=short.select("k", "date", "value"),
        unemployment=x["unemployment"],
        natural=x["natural"].where(k % 6 != 2),
        key=_KEY,
    )
    return found.select(
        "k", "no_point_values", "no_range_bounds", "days_lower_above_upper", "under_13_months", "no_labour_overlap"
    )
