"""Data rules; each query reports ``(rule, violations)`` or the rows found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import calendar as cal
from ..operators import metrics as m
from ..operators import quality as q
from ..operators.asof import Pick, Source, asof_many
from . import fixtures as fx
from .fixtures import plain
from .registry import query, with_views


def _one(rule: str, count: str) -> str:
    return f"SELECT '{rule}' AS rule, {count} AS violations"


@query(
    "rule_schema_exact",
    with_views(
        "s",
        """SELECT 'missing' AS problem, 'source' AS column_name, (SELECT count(*) FROM s) AS rows UNION ALL
        SELECT 'unexpected', 'k', (SELECT count(*) FROM s)""",
    ),
)
def rule_schema_exact(spark, sf):
    data = fx.series(spark, sf)
    report = q.schema_report(data, ["d", "v", "source"])
    problems = [
        F.struct(F.lit(p).alias("problem"), F.lit(c).alias("column_name"))
        for p, cols in report.items()
        for c in cols
    ]
    return data.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(F.array(*problems)).alias("_p"), "rows"
    ).select("_p.*", "rows")


def _text_series(spark, sf):
    v = F.col("v")
    return fx.series(spark, sf).select(
        "k",
        F.when(v > 60000, "n/a").otherwise(F.col("d").cast("string")).alias("date"),
        F.when(v > 60000, "abc").when(v < 5000, " ").otherwise(v.cast("string")).alias("value"),
    )


@query(
    "rule_valid_date",
    with_views("s", _one("valid_date:date", "(SELECT count(*) FROM s WHERE v > 60000)")),
)
def rule_valid_date(spark, sf):
    return q.violations(_text_series(spark, sf), [q.valid_date("date", fmt="yyyy-MM-dd")])


@query("rule_numeric", with_views("s", _one("numeric:value", "(SELECT count(*) FROM s WHERE v > 60000)")))
def rule_numeric(spark, sf):
    return q.violations(_text_series(spark, sf), [q.numeric("value")])


@query(
    "rule_not_null_finite",
    _one("finite:x", "(SELECT count(*) FROM events WHERE value > 50 OR value < 1)"),
)
def rule_not_null_finite(spark, sf):
    v = F.col("value")
    x = F.when(v > 100, None).when(v > 50, float("inf")).when(v < 1, float("nan")).otherwise(v)
    return q.violations(fx.table(spark, sf, "events").withColumn("x", x), [q.not_null_finite("x")])


@query(
    "rule_not_blank",
    _one("not_blank:url", "(SELECT count(*) FROM pages WHERE url LIKE 'https%' OR url LIKE '%?%')"),
)
def rule_not_blank(spark, sf):
    url = F.col("url")
    blanked = F.when(url.contains("?"), None).when(url.startswith("https"), "  ").otherwise(url)
    return q.violations(fx.table(spark, sf, "pages").withColumn("url", blanked), [q.not_blank("url")])


@query(
    "rule_unique",
    _one(
        "unique:customer_day",
        """(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders
        GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1))""",
    ),
)
def rule_unique(spark, sf):
    orders = fx.table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return q.violations(orders, [q.Unique("unique:customer_day", ["o_custkey", "day"])])


@query(
    "rule_sorted",
    with_views(
        "h",
        _one(
            "unique:order",
            "(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM h GROUP BY k, d HAVING count(*) > 1))",
        ),
    ),
)
def rule_sorted(spark, sf):
    """A table has no row order; what an ordered window needs is a unique order key."""
    return q.violations(fx.customer_history(spark, sf), [q.Unique("unique:order", ["k", "d"])])


@query("rule_range", _one("range:value", "(SELECT count(*) FROM events WHERE value < 1 OR value > 100)"))
def rule_range(spark, sf):
    return q.violations(fx.table(spark, sf, "events"), [q.in_range("value", 1, 100)])


@query(
    "rule_domain",
    _one("domain:event_type", "(SELECT count(*) FROM events WHERE event_type NOT IN ('view', 'click', 'purchase'))"),
)
def rule_domain(spark, sf):
    return q.violations(
        fx.table(spark, sf, "events"), [q.in_domain("event_type", ["view", "click", "purchase"])]
    )


@query(
    "rule_order_columns",
    with_views(
        "meas",
        """SELECT 'order:tax_hi<=disc_hi' AS rule, (SELECT count(*) FROM meas WHERE tax_hi > disc_hi) AS violations UNION ALL
        SELECT 'order:qlo<qhi', (SELECT count(*) FROM meas WHERE date >= DATE '1998-01-01' AND qlo >= qhi)""",
    ),
)
def rule_order_columns(spark, sf):
    late = F.col("date") >= F.lit("1998-01-01").cast("date")
    rules = [q.ordered("tax_hi", "disc_hi"), q.ordered("qlo", "qhi", strict=True, where=late)]
    return q.violations(fx.measures(spark, sf), rules)


@query(
    "rule_identity",
    with_views(
        "meas",
        """SELECT 'identity:exact' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL
        SELECT 'identity:shifted', (SELECT count(*) FROM meas WHERE qhi >= 10)""",
    ),
)
def rule_identity(spark, sf):
    mid = (F.col("qlo") + F.col("qhi")) / 2.0
    shifted = mid + F.when(F.col("qhi") >= 10, 0.01).otherwise(0.0)
    rules = [
        q.identity("exact", mid + 1e-12, mid),
        q.identity("shifted", shifted, mid),
    ]
    return q.violations(fx.measures(spark, sf), rules)


@query(
    "rule_label_consistent",
    with_views(
        "dec",
        """SELECT 'label:decision' AS rule, (SELECT count(*) FROM dec WHERE dir <> 0 AND value > 50) AS violations UNION ALL
        SELECT 'label:is_change', (SELECT count(*) FROM dec WHERE value > 90)""",
    ),
)
def rule_label_consistent(spark, sf):
    """Large values get a zero change, the largest a flipped flag."""
    large = F.col("value")
    faulty = fx.decisions(spark, sf).withColumns(
        {
            "rate_change_bps": F.when(large > 50, 0.0).otherwise(F.col("dir") * 25.0),
            "is_change": F.when(large > 90, 1 - F.col("is_change")).otherwise(F.col("is_change")),
        }
    )
    return q.violations(faulty, q.label_consistent())


# Events with the dates of the series around them, some of them moved.
_MOVED = """(SELECT e.d, CASE WHEN event_id % 7 = 0 THEN e.d + CAST(event_id % 3 AS INTEGER) ELSE a.d END AS bef,
  CASE WHEN event_id % 11 = 0 THEN e.d - CAST(event_id % 2 AS INTEGER) ELSE b.d END AS aft
  FROM e ASOF LEFT JOIN s a ON e.k = a.k AND e.d > a.d ASOF LEFT JOIN s b ON e.k = b.k AND e.d < b.d)"""


@query(
    "rule_chronology",
    with_views(
        "s e",
        f"""SELECT * FROM (WITH m AS (SELECT * FROM {_MOVED})
        SELECT 'chronology:before<d' AS rule, count(*) FILTER (WHERE bef >= d) AS violations FROM m UNION ALL
        SELECT 'chronology:d<after', count(*) FILTER (WHERE d >= aft) FROM m UNION ALL
        SELECT 'chronology:before<=d', count(*) FILTER (WHERE bef > d) FROM m UNION ALL
        SELECT 'age:before', count(*) FILTER (WHERE abs(datediff('day', bef, d)) > 7) FROM m UNION ALL
        SELECT 'age:after', count(*) FILTER (WHERE abs(datediff('day', d, aft)) > 7) FROM m)""",
    ),
)
def rule_chronology(spark, sf):
    """Dates around each event, moved to or past it for some."""
    around = Source(
        fx.series(spark, sf),
        "d",
        [
            Pick({"v": "v_before"}, reference_col="before"),
            Pick({"v": "v_after"}, reference_col="after", direction="forward"),
        ],
        allow_exact=False,
    )
    panel = asof_many(fx.order_events(spark, sf), [around], key=["k"], left_date="d")
    n = F.col("event_id")
    moved = panel.withColumns(
        {
            "before": F.when(n % 7 == 0, F.date_add("d", (n % 3).cast("int"))).otherwise(F.col("before")),
            "after": F.when(n % 11 == 0, F.date_sub("d", (n % 2).cast("int"))).otherwise(F.col("after")),
        }
    )
    rules = [
        q.strictly_before("before", "d"),
        q.strictly_before("d", "after"),
        q.not_after("before", "d"),
        q.max_age("before", "d", 7),
        q.max_age("after", "d", 7),
    ]
    return q.violations(moved, rules)


@query(
    "rule_coverage",
    with_views(
        "meas",
        """SELECT k, pf IS NULL AS no_point_values, lf IS NULL AS no_range_bounds,
        coalesce(pl < lf - 1, false) AS point_ends_before_range FROM (SELECT k,
          min(date) FILTER (WHERE date < DATE '1997-06-01') AS pf, max(date) FILTER (WHERE date < DATE '1997-06-01') AS pl,
          min(date) FILTER (WHERE date >= DATE '1998-01-01' AND qlo < qhi) AS lf FROM meas GROUP BY k)""",
    ),
)
def rule_coverage(spark, sf):
    x = fx.macro_inputs(fx.measures(spark, sf))
    early = x["point"].withColumn(
        "value", F.when(F.col("date") < F.lit("1997-06-01").cast("date"), F.col("value"))
    )
    rows = cal.splice_inputs(early, x["lower"], x["upper"], key=["k"], date="date", value="value")
    return cal.splice_coverage(rows, key=["k"])


@query(
    "rule_sum_to_one",
    with_views(
        "s",
        """SELECT CAST(d AS VARCHAR) AS d, round(total, 6) AS total FROM
        (SELECT s.d, sum(CASE WHEN s.k = 0 THEN 2 ELSE 1 END * v / t) AS total
         FROM s JOIN (SELECT d, sum(v) AS t FROM s GROUP BY d) x ON s.d = x.d GROUP BY s.d) WHERE abs(total - 1) > 1.1e-5""",
    ),
)
def rule_sum_to_one(spark, sf):
    """Daily shares of the nations, with one nation counted twice."""
    data = fx.series(spark, sf)
    totals = data.groupBy("d").agg(F.sum("v").alias("t"))
    twice = F.when(F.col("k") == 0, 2).otherwise(1)
    shares = data.join(totals, "d").withColumn("share", twice * F.col("v") / F.col("t"))
    bad = q.shares_sum_to_one(shares, group=["d"], share="share", atol=1e-6)
    return plain(bad, digits=6)


@query(
    "rule_classes_present",
    with_views(
        "dec",
        """SELECT k, CAST(count(DISTINCT decision) AS INTEGER) AS classes_present, count(DISTINCT decision) = 3 AS complete
        FROM dec GROUP BY k""",
    ),
)
def rule_classes_present(spark, sf):
    return q.classes_present(
        fx.decisions(spark, sf), split="k", label="decision", classes=K.DECISION_CLASSES
    )


@query(
    "rule_matrix_totals",
    with_views("c", "SELECT count(*) AS total, count(*) FILTER (WHERE actual = predicted) AS trace FROM c"),
)
def rule_matrix_totals(spark, sf):
    cells = m.confusion_cells(
        fx.class_pairs(spark, sf), actual="actual", predicted="predicted", labels=[0, 1]
    )
    return q.matrix_totals(cells, actual="actual", predicted="predicted")


@query(
    "expect_quarantine",
    """SELECT event_id, CASE WHEN value > 100 THEN 'range:value' ELSE '' END ||
      CASE WHEN value > 100 AND event_type = 'error' THEN '|' ELSE '' END ||
      CASE WHEN event_type = 'error' THEN 'domain:event_type' ELSE '' END AS broken
    FROM events WHERE value > 100 OR event_type = 'error'""",
)
def expect_quarantine(spark, sf):
    rules = [
        q.in_range("value", None, 100),
        q.in_domain("event_type", ["view", "click", "purchase", "signup"]),
    ]
    _, bad = q.expect(fx.table(spark, sf, "events"), rules, on_violation="quarantine")
    return bad.select("event_id", F.array_join("broken_rules", "|").alias("broken"))


@query(
    "first_n_bad_rows",
    "SELECT event_id, value FROM events WHERE value > 100 ORDER BY event_id LIMIT 5",
)
def first_n_bad_rows(spark, sf):
    bad = q.first_n_bad_rows(fx.table(spark, sf, "events"), F.col("value") > 100, order=["event_id"])
    return bad.select("event_id", "value")
