"""Projections, filters and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import values as fv
from ..operators import joins as j
from ..operators import quality as q
from . import fixtures as fx
from .fixtures import plain
from .registry import query, with_views


@query(
    "project_columns",
    with_views("dec", "SELECT event_id, is_change, decision, value FROM dec"),
)
def project_columns(spark, sf):
    panel = fx.decision_features(spark, sf)
    return panel.select("event_id", "value", "is_change", "decision")


@query(
    "rename_columns",
    with_views("s", "SELECT k AS entity, CAST(d AS VARCHAR) AS reference_date, v AS shipped_value FROM s"),
)
def rename_columns(spark, sf):
    names = {"k": "entity", "d": "reference_date", "v": "shipped_value"}
    return plain(j.rename_columns(fx.series(spark, sf), names))


@query(
    "filter_year_range",
    with_views("e", "SELECT event_id, k, CAST(d AS VARCHAR) AS d FROM e WHERE year(d) BETWEEN 1996 AND 1999"),
)
def filter_year_range(spark, sf):
    events = fx.order_events(spark, sf)
    return plain(
        j.filter_year_range(events, date="d", start=1996, end=1999).select("event_id", "k", "d")
    )


@query(
    "leakage_column_guard",
    with_views("dec", "SELECT 'value_after' AS refused, count(*) AS rows_kept FROM dec"),
)
def leakage_column_guard(spark, sf):
    """The guard passes the feature table and refuses a column from the future."""
    panel = fx.decision_features(spark, sf)
    kept = q.leakage_column_guard(panel, features=fx.HISTORY_FEATURES)
    refused = ""
    try:
        q.leakage_column_guard(panel.withColumn("value_after", F.lit(1)), features=fx.HISTORY_FEATURES)
    except q.RuleViolation:
        refused = "value_after"
    return kept.agg(F.count(F.lit(1)).alias("rows_kept")).withColumn("refused", F.lit(refused))


_CONTEXT = """SELECT event_id, rate - pce_yoy AS real_rate_proxy, pce_yoy - 2.0 AS inflation_gap, nat - un AS labour_gap,
  (pce_yoy - 2.0) + 0.5 * (nat - un) AS hawk_dove_score, abs(pce_yoy - 2.0) AS abs_inflation_gap, rate - ma3 AS policy_tightness
  FROM (SELECT o_orderkey AS event_id, o_totalprice / 1024 AS rate, c_acctbal / 512 AS pce_yoy, o_totalprice / 256 AS ma3,
    c_acctbal / 128 AS nat, c_nationkey / 4.0 AS un FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("policy_context_features", _CONTEXT)
def policy_context_features(spark, sf):
    orders, customers = fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer")
    panel = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("event_id"),
        (F.col("o_totalprice") / 1024).alias("rate_level"),
        (F.col("c_acctbal") / 512).alias("pce_yoy"),
        (F.col("o_totalprice") / 256).alias("pce_yoy_ma3"),
        (F.col("c_acctbal") / 128).alias("natural_unemployment"),
        (F.col("c_nationkey") / 4.0).alias("unemployment"),
    )
    added = ["real_rate_proxy", "inflation_gap", "labour_gap", "hawk_dove_score", "abs_inflation_gap", "policy_tightness"]
    return fv.policy_context_features(panel).select("event_id", *added)


@query(
    "spread_features",
    with_views(
        "meas",
        """SELECT k, CAST(date AS VARCHAR) AS date, disc_hi - qhi AS spread_a, disc_lo - qhi AS spread_b, tax_hi - qhi AS spread_c FROM meas""",
    ),
)
def spread_features(spark, sf):
    pairs = [("disc_hi", "spread_a"), ("disc_lo", "spread_b"), ("tax_hi", "spread_c")]
    out = fv.spread_features(fx.measures(spark, sf), level="qhi", pairs=pairs)
    return plain(out.select("k", "date", "spread_a", "spread_b", "spread_c"))


@query("encode_direction", with_views("dec", "SELECT event_id, dir AS direction FROM dec"))
def encode_direction(spark, sf):
    return fx.decisions(spark, sf).select(
        "event_id", fv.encode_direction(F.col("decision")).alias("direction")
    )


@query(
    "encode_bool_text",
    """SELECT event_id, CASE WHEN k < 25 THEN 1 WHEN k < 50 THEN 0 WHEN k < 75 THEN 1 WHEN k < 90 THEN 0 END AS flag
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""",
)
def encode_bool_text(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    text = (
        F.when(k < 25, "TRUE").when(k < 50, "false").when(k < 75, "1").when(k < 90, "0").otherwise("maybe")
    )
    return fx.table(spark, sf, "events").select("event_id", fv.encode_bool_text(text).alias("flag"))


@query(
    "class_weight_balanced",
    with_views(
        "dec",
        """SELECT event_id, decision, round((SELECT count(*) FROM dec) / (3 * n), 10) AS class_weight
        FROM dec JOIN (SELECT decision, count(*) AS n FROM dec GROUP BY 1) c USING (decision)""",
    ),
)
def class_weight_balanced(spark, sf):
    from ..operators.forest import class_weight_balanced as weigh

    out = weigh(fx.decisions(spark, sf), label="decision", classes=K.DECISION_CLASSES)
    return plain(out.select("event_id", "decision", "class_weight"), digits=10)
