"""Query registry and the shared SQL fragments of the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check, or None for a rows-only one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# Views that stand in for the domain tables, as SQL.  Later ones build on
# earlier ones; ``with_views`` adds what a view needs.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # Keyed daily series, unique on (k, d).
    "s": (
        (),
        """SELECT s_nationkey AS k, CAST(l_shipdate AS DATE) AS d,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    ),
    # Events on the same key, several per day.
    "e": (
        (),
        """SELECT o_orderkey AS event_id, c_nationkey AS k, CAST(o_orderdate AS DATE) AS d,
           o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    # One event per customer and day.
    "h": (
        (),
        """SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d,
           arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2""",
    ),
    # Decisions, unique on (k, ts).
    "dec": (
        (),
        """SELECT event_id, user_id AS k, ts, value,
           CASE event_type WHEN 'purchase' THEN 'hike' WHEN 'error' THEN 'cut' ELSE 'hold' END AS decision,
           CASE WHEN event_type IN ('purchase','error') THEN 1 ELSE 0 END AS is_change,
           CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS dir
           FROM events""",
    ),
    # Classification pairs.
    "c": (
        (),
        """SELECT l.doc_id, l.quality AS actual, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS predicted
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    ),
    # Month ends of the series: last value per month on a dense month grid.
    "m": (
        ("s",),
        """SELECT g.k, g.d, x.v FROM (
             SELECT k, last_day(CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE)) AS d
             FROM s GROUP BY k) g
           LEFT JOIN (SELECT k, last_day(d) AS d, arg_max(v, d) AS v FROM s GROUP BY 1, 2) x
           ON g.k = x.k AND g.d = x.d""",
    ),
    # A sparse series: days on which the value is above 20000, others NULL.
    "sparse": (
        ("s",),
        "SELECT k, d, CASE WHEN v > 20000 THEN v END AS v FROM s",
    ),
    # Measures per key and day for the composite pipelines.
    "meas": (
        (),
        """SELECT s_nationkey AS k, CAST(l_shipdate AS DATE) AS date,
           min(l_quantity) / 4 AS qlo, max(l_quantity) / 4 AS qhi,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
           CAST(max(CAST(l_tax AS DECIMAL(9,2))) * 100 AS DOUBLE) AS tax_hi,
           CAST(min(CAST(l_tax AS DECIMAL(9,2))) * 100 AS DOUBLE) AS tax_lo,
           CAST(max(CAST(l_discount AS DECIMAL(9,2))) * 100 AS DOUBLE) AS disc_hi,
           CAST(min(CAST(l_discount AS DECIMAL(9,2))) * 100 AS DOUBLE) AS disc_lo
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    ),
    # One event per key and day: the largest order.
    "ev": (
        (),
        """SELECT c_nationkey AS k, CAST(o_orderdate AS DATE) AS meeting_date,
           max(o_orderkey) AS event_id,
           arg_max(o_orderpriority, o_orderkey) <> '1-URGENT' AS is_scheduled,
           'https://example.org/orders/' || CAST(max(o_orderkey) AS VARCHAR) AS source_url
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    ),
    # Daily state of the splice.
    "spine": (
        ("meas",),
        """SELECT k, CAST(unnest(generate_series(min(date), max(date) FILTER (WHERE date >= DATE '1998-01-01' AND qlo < qhi), INTERVAL 1 DAY)) AS DATE) AS date
           FROM meas GROUP BY k HAVING count(*) FILTER (WHERE date >= DATE '1998-01-01' AND qlo < qhi) > 0""",
    ),
    "pol": (
        ("meas", "spine"),
        """SELECT k, date,
             CASE WHEN date < rs THEN p ELSE lo END AS target_lower,
             CASE WHEN date < rs THEN p ELSE up END AS target_upper,
             CASE WHEN date < rs THEN p ELSE (lo + up) / 2.0 END AS policy_rate,
             CASE WHEN date < rs THEN 'point_target' ELSE 'target_range' END AS policy_regime
           FROM (SELECT sp.k, sp.date, r.rs,
                   last_value(x.qhi IGNORE NULLS) OVER w AS p,
                   last_value(CASE WHEN x.date >= DATE '1998-01-01' AND x.qlo < x.qhi THEN x.qlo END IGNORE NULLS) OVER w AS lo,
                   last_value(CASE WHEN x.date >= DATE '1998-01-01' AND x.qlo < x.qhi THEN x.qhi END IGNORE NULLS) OVER w AS up
                 FROM spine sp
                 JOIN (SELECT k, min(date) AS rs FROM meas WHERE date >= DATE '1998-01-01' AND qlo < qhi GROUP BY k) r ON sp.k = r.k
                 LEFT JOIN meas x ON sp.k = x.k AND sp.date = x.date
                 WINDOW w AS (PARTITION BY sp.k ORDER BY sp.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    ),
    # Dense months with the index, its yearly change, and the labour pair.
    "mon": (
        ("meas",),
        """SELECT g.k, g.date, x.price AS pce_index, x.tax_hi AS unemployment
           FROM (SELECT k, last_day(CAST(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS DATE)) AS date
                 FROM meas GROUP BY k) g
           LEFT JOIN (SELECT k, last_day(date) AS date, arg_max(price, date) AS price, arg_max(tax_hi, date) AS tax_hi
                      FROM meas GROUP BY 1, 2) x ON g.k = x.k AND g.date = x.date""",
    ),
    "inf": (
        ("mon",),
        """SELECT k, date, pce_index,
             CASE WHEN count(pce_index) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 13
                  THEN (pce_index / lag(pce_index, 12) OVER (PARTITION BY k ORDER BY date) - 1) * 100.0 END AS pce_yoy
           FROM mon""",
    ),
    "lab": (
        ("mon", "meas"),
        """SELECT b.k, b.date, b.unemployment,
             last_value(n.v IGNORE NULLS) OVER (PARTITION BY b.k ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS natural_unemployment
           FROM mon b LEFT JOIN (
             SELECT k, last_day(date) AS date, arg_max(disc_hi, date) AS v FROM meas
             WHERE month(date) IN (1, 4, 7, 10) GROUP BY 1, 2) n ON b.k = n.k AND b.date = n.date""",
    ),
    "panel": (
        ("pol", "inf", "lab", "mon"),
        """SELECT b.k, b.date,
             last_value(p.target_lower IGNORE NULLS) OVER w AS target_lower,
             last_value(p.target_upper IGNORE NULLS) OVER w AS target_upper,
             last_value(p.policy_rate IGNORE NULLS) OVER w AS policy_rate,
             last_value(p.policy_regime IGNORE NULLS) OVER w AS policy_regime,
             i.pce_index, i.pce_yoy, l.unemployment, l.natural_unemployment
           FROM mon b
           LEFT JOIN (SELECT k, last_day(date) AS date, arg_max(target_lower, date) AS target_lower,
                        arg_max(target_upper, date) AS target_upper, arg_max(policy_rate, date) AS policy_rate,
                        arg_max(policy_regime, date) AS policy_regime FROM pol GROUP BY 1, 2) p
             ON b.k = p.k AND b.date = p.date
           LEFT JOIN inf i ON b.k = i.k AND b.date = i.date
           LEFT JOIN lab l ON b.k = l.k AND b.date = l.date
           WINDOW w AS (PARTITION BY b.k ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "aligned": (
        ("ev", "panel", "pol"),
        """SELECT a.*, u.unemployment, u.date AS unemployment_reference_date,
             n.natural_unemployment, n.date AS natural_unemployment_reference_date,
             b.date AS policy_date_before, b.target_lower AS target_lower_before, b.target_upper AS target_upper_before,
             b.policy_rate AS policy_rate_before, b.policy_regime AS policy_regime_before,
             f.date AS policy_date_after, f.target_lower AS target_lower_after, f.target_upper AS target_upper_after,
             f.policy_rate AS policy_rate_after, f.policy_regime AS policy_regime_after
           FROM (SELECT ev.*, i.pce_index, i.pce_yoy, i.date AS pce_reference_date
                 FROM ev ASOF LEFT JOIN (SELECT * FROM panel WHERE pce_yoy IS NOT NULL) i
                 ON ev.k = i.k AND ev.meeting_date >= i.date) a
           ASOF LEFT JOIN (SELECT k, date, unemployment FROM panel WHERE unemployment IS NOT NULL) u
             ON a.k = u.k AND a.meeting_date >= u.date
           ASOF LEFT JOIN (SELECT k, date, natural_unemployment FROM panel WHERE natural_unemployment IS NOT NULL) n
             ON a.k = n.k AND a.meeting_date >= n.date
           ASOF LEFT JOIN pol b ON a.k = b.k AND a.meeting_date > b.date
           ASOF LEFT JOIN pol f ON a.k = f.k AND a.meeting_date < f.date
           WHERE datediff('day', b.date, a.meeting_date) <= 7 AND datediff('day', a.meeting_date, f.date) <= 7""",
    ),
    "labelled": (
        ("aligned",),
        """SELECT *, CASE WHEN rate_change_bps > 0.25 THEN 'hike' WHEN rate_change_bps < -0.25 THEN 'cut' ELSE 'hold' END AS decision,
             CASE WHEN abs(rate_change_bps) > 0.25 THEN 1 ELSE 0 END AS is_change
           FROM (SELECT *, (policy_rate_after - policy_rate_before) * 100.0 AS rate_change_bps FROM aligned)""",
    ),
    "clean": (
        ("labelled",),
        """SELECT * FROM labelled WHERE pce_reference_date IS NOT NULL AND unemployment_reference_date IS NOT NULL
             AND natural_unemployment_reference_date IS NOT NULL""",
    ),
    # The eight market series as a long table.
    "market": (
        ("meas",),
        """SELECT k, date, 'treasury_3m_pct' AS series_id, disc_hi AS value FROM meas
           UNION ALL SELECT k, date, 'treasury_6m_pct', disc_lo FROM meas
           UNION ALL SELECT k, date, 'treasury_1y_pct', tax_hi FROM meas
           UNION ALL SELECT k, date, 'treasury_2y_pct', tax_lo FROM meas
           UNION ALL SELECT k, date, 'treasury_5y_pct', (disc_hi + tax_hi) / 2 FROM meas
           UNION ALL SELECT k, date, 'treasury_10y_pct', (disc_lo + tax_lo) / 2 FROM meas
           UNION ALL SELECT k, date, 'curve_10y_minus_2y_pct', disc_hi - tax_lo FROM meas
           UNION ALL SELECT k, date, 'curve_10y_minus_3m_pct', disc_lo - tax_hi FROM meas""",
    ),
}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the views it needs (space-separated names)."""
    order: list[str] = []

    def need(n: str) -> None:
        for d in VIEWS[n][0]:
            need(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order]
    return f"WITH {', '.join(parts)} {body}" if parts else body
