"""Aggregates, metrics, rankings, splits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import joins as j
from ..operators import metrics as m
from ..operators import quality as q
from ..operators import ranking as rk
from ..plans.reports import headline_counts, holdout_report_tables
from . import fixtures as fx
from .fixtures import plain
from .registry import query, with_views

_AP = dict(actual="actual", predicted="predicted")
_LABELS = [0, 1]

# Per-label counts of the classification pairs, labels 0 and 1.
_PER = """(SELECT label, CAST(sum(a) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS called, CAST(sum(h) AS BIGINT) AS hits FROM (
  SELECT l.label, CASE WHEN c.actual = l.label THEN 1 ELSE 0 END AS a,
    CASE WHEN c.predicted = l.label THEN 1 ELSE 0 END AS p,
    CASE WHEN c.actual = l.label AND c.predicted = l.label THEN 1 ELSE 0 END AS h
  FROM c CROSS JOIN (VALUES {0}) l(label)) GROUP BY label)"""
_PRF = f"""(SELECT *, CASE WHEN called > 0 THEN hits / called ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall,
  CASE WHEN called + support > 0 THEN 2.0 * hits / (called + support) ELSE 0.0 END AS f1 FROM {_PER})"""
_TWO, _THREE = "(0), (1)", "(0), (1), (2)"


@query(
    "predict_correct_flag",
    with_views("c", "SELECT doc_id, actual, predicted, actual = predicted AS correct FROM c"),
)
def predict_correct_flag(spark, sf):
    return m.predict_correct_flag(fx.class_pairs(spark, sf), **_AP)


@query(
    "confusion_matrix",
    with_views(
        "c",
        """SELECT actual, count(*) FILTER (WHERE predicted = 0) AS predicted_0,
        count(*) FILTER (WHERE predicted = 1) AS predicted_1 FROM c GROUP BY actual""",
    ),
)
def confusion_matrix(spark, sf):
    return m.confusion_matrix(fx.class_pairs(spark, sf), **_AP, labels=_LABELS)


@query(
    "accuracy",
    with_views("c", "SELECT avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS accuracy, count(*) AS n FROM c"),
)
def accuracy(spark, sf):
    return m.accuracy(fx.class_pairs(spark, sf), **_AP)


@query(
    "balanced_accuracy",
    with_views(
        "c",
        f"SELECT round(avg(recall) FILTER (WHERE support > 0), 10) AS balanced_accuracy FROM {_PRF.format(_TWO)}",
    ),
)
def balanced_accuracy(spark, sf):
    report = m.classification_report(fx.class_pairs(spark, sf), **_AP, labels=_LABELS)
    return report.select(F.round("balanced_accuracy", 10).alias("balanced_accuracy"))


@query(
    "per_class_prf",
    with_views(
        "c",
        f"""SELECT label, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1,
        support, called, hits FROM {_PRF.format(_TWO)}""",
    ),
)
def per_class_prf(spark, sf):
    cells = m.confusion_cells(fx.class_pairs(spark, sf), **_AP, labels=_LABELS)
    return plain(m.per_class_prf(cells), digits=10)


@query(
    "macro_f1_present",
    with_views(
        "c",
        f"SELECT round(avg(f1) FILTER (WHERE support + called > 0), 10) AS macro_f1 FROM {_PRF.format(_THREE)}",
    ),
)
def macro_f1_present(spark, sf):
    report = m.classification_report(fx.class_pairs(spark, sf), **_AP, labels=[0, 1, 2])
    return report.select(F.round("macro_f1", 10).alias("macro_f1"))


@query(
    "macro_f1_fixed",
    with_views("c", f"SELECT round(avg(f1), 10) AS macro_f1 FROM {_PRF.format(_THREE)}"),
)
def macro_f1_fixed(spark, sf):
    report = m.classification_report(
        fx.class_pairs(spark, sf), **_AP, labels=[0, 1, 2], macro="fixed"
    )
    return report.select(F.round("macro_f1", 10).alias("macro_f1"))


@query(
    "class_recall_table",
    with_views(
        "c",
        """SELECT actual AS label, count(*) AS actual_rows, count(*) FILTER (WHERE actual = predicted) AS correct,
        round(avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END), 10) AS recall FROM c GROUP BY 1""",
    ),
)
def class_recall_table(spark, sf):
    return plain(m.class_recall_table(fx.class_pairs(spark, sf), **_AP), digits=10)


_F_NULLS = ("value", "v")


@query(
    "null_counts",
    with_views(
        "sparse",
        """SELECT 'd' AS column_name, count(*) FILTER (WHERE d IS NULL) AS null_count FROM sparse UNION ALL
        SELECT 'k', count(*) FILTER (WHERE k IS NULL) FROM sparse UNION ALL
        SELECT 'v', count(*) FILTER (WHERE v IS NULL) FROM sparse""",
    ),
)
def null_counts(spark, sf):
    return q.null_counts(fx.sparse_series(spark, sf), ["k", "d", "v"])


@query(
    "drop_incomplete_rows",
    with_views(
        "sparse",
        "SELECT k, CAST(d AS VARCHAR) AS d, v FROM sparse WHERE v IS NOT NULL AND d IS NOT NULL",
    ),
)
def drop_incomplete_rows(spark, sf):
    return plain(q.drop_incomplete_rows(fx.sparse_series(spark, sf), ["d", "v"])[0])


@query(
    "distinct_variation",
    with_views(
        "dec",
        """SELECT 'decision' AS column_name, count(DISTINCT decision) <= 1 AS no_variation FROM dec UNION ALL
        SELECT 'is_change', count(DISTINCT is_change) <= 1 FROM dec UNION ALL
        SELECT 'constant', count(DISTINCT 7) <= 1 FROM dec UNION ALL
        SELECT 'one_value_or_null', count(DISTINCT CASE WHEN is_change = 1 THEN 1 END)
          + CAST(count(*) FILTER (WHERE is_change <> 1) > 0 AS INTEGER) <= 1 FROM dec UNION ALL
        SELECT 'value', count(DISTINCT value) <= 1 FROM dec""",
    ),
)
def distinct_variation(spark, sf):
    data = fx.decisions(spark, sf).select(
        "decision",
        "is_change",
        F.lit(7).alias("constant"),
        F.when(F.col("is_change") == 1, 1).alias("one_value_or_null"),
        "value",
    )
    # One type per unpivot: the flags are all boolean.
    return q.distinct_variation(data, data.columns)


@query(
    "duplicate_keys",
    """SELECT o_orderkey AS event_id, o_custkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders
    WHERE (o_custkey, CAST(o_orderdate AS DATE)) IN
      (SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders GROUP BY 1, 2 HAVING count(*) > 1)""",
)
def duplicate_keys(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("k"),
        F.col("o_orderdate").cast("date").alias("d"),
    )
    return plain(q.duplicate_keys(orders, key=["k", "d"]))


# One row per user stands in for one row per seed: share of changes and mean size.
_SEEDS = """(SELECT k AS random_state, avg(is_change) AS accuracy,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS size FROM dec GROUP BY k)"""


def _seed_table(spark, sf):
    return (
        fx.decisions(spark, sf)
        .groupBy(F.col("k").alias("random_state"))
        .agg(
            F.avg("is_change").alias("accuracy"),
            (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("size"),
        )
    )


@query(
    "seed_summary",
    with_views(
        "dec",
        f"""SELECT 'accuracy' AS metric, round(avg(accuracy), 8) AS mean, round(stddev_pop(accuracy), 8) AS std,
        round(min(accuracy), 8) AS min, round(max(accuracy), 8) AS max FROM {_SEEDS} UNION ALL
        SELECT 'size', round(avg(size), 8), round(stddev_pop(size), 8), round(min(size), 8), round(max(size), 8) FROM {_SEEDS}""",
    ),
)
def seed_summary(spark, sf):
    return plain(m.seed_summary(_seed_table(spark, sf), ["accuracy", "size"]), digits=8)


@query(
    "delta_vs_baseline_row",
    with_views(
        "dec",
        f"""SELECT s.random_state, round(s.accuracy - b.accuracy, 8) AS accuracy_delta, round(s.size - b.size, 8) AS size_delta
        FROM {_SEEDS} s CROSS JOIN (SELECT * FROM {_SEEDS} WHERE random_state = (SELECT min(k) FROM dec)) b""",
    ),
)
def delta_vs_baseline_row(spark, sf):
    seeds = _seed_table(spark, sf)
    first = fx.decisions(spark, sf).agg(F.min("k")).first()[0]
    out = m.delta_vs_baseline_row(
        seeds, row=F.col("random_state") == first, metrics=["accuracy", "size"]
    )
    return plain(out.select("random_state", "accuracy_delta", "size_delta"), digits=8)


# --- rankings: brands and parts by revenue stand in for features by importance.

_BRANDS = """(SELECT p_type AS grp, p_brand AS feature, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS importance
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_PARTS = """(SELECT p_name || '#' || CAST(p_partkey AS VARCHAR) AS feature,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) AS importance
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def _brands(spark, sf):
    lines, parts = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "part")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.col("p_type").alias("grp"), F.col("p_brand").alias("feature"))
        .agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("importance"))
    )


def _parts(spark, sf):
    lines, parts = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "part")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0)
    name = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(name.alias("feature"))
        .agg(F.sum(returned).cast("double").alias("importance"))
    )


@query(
    "rank_min_desc",
    f"SELECT grp, feature, importance, CAST(rank() OVER (PARTITION BY grp ORDER BY importance DESC) AS INTEGER) AS rank FROM {_BRANDS}",
)
def rank_min_desc(spark, sf):
    return rk.rank_min_desc(_brands(spark, sf), group=["grp"], value="importance")


@query(
    "sequential_rank",
    f"""SELECT grp, feature, importance,
    CAST(row_number() OVER (PARTITION BY grp ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM {_BRANDS}""",
)
def sequential_rank(spark, sf):
    return rk.sequential_rank(_brands(spark, sf), group=["grp"], value="importance", name="feature")


_MOST_LEAST = f"""SELECT * FROM (SELECT 'most_influential' AS influence_group,
    CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, importance
    FROM {_PARTS} WHERE importance > 0) WHERE rank <= 10
  UNION ALL SELECT * FROM (SELECT 'least_influential' AS influence_group,
    CAST(row_number() OVER (ORDER BY importance, feature) AS INTEGER) AS rank, feature, importance
    FROM {_PARTS}) WHERE rank <= 10"""


@query("topk_most_least", _MOST_LEAST)
def topk_most_least(spark, sf):
    return m.topk_most_least(_parts(spark, sf), value="importance", name="feature")


@query(
    "factor_rankings",
    f"""SELECT influence_group, count(*) AS entries, string_agg(CAST(rank AS VARCHAR) || ':' || feature, ',' ORDER BY rank) AS ranked
    FROM ({_MOST_LEAST}) GROUP BY 1""",
)
def factor_rankings(spark, sf):
    nested = m.factor_rankings_nested(
        m.topk_most_least(_parts(spark, sf), value="importance", name="feature")
    )
    text = F.transform("entries", lambda e: F.concat_ws(":", e["rank"].cast("string"), e["feature"]))
    return nested.select(
        "influence_group",
        F.size("entries").cast("long").alias("entries"),
        F.array_join(text, ",").alias("ranked"),
    )


@query(
    "topk_chart_rows",
    f"""SELECT feature, importance, rank, rank = 1 AS is_leader FROM
    (SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM {_PARTS})
    WHERE rank <= 15""",
)
def topk_chart_rows(spark, sf):
    return m.topk_chart_rows(_parts(spark, sf), value="importance", name="feature", k=K.CHART_FEATURES)


@query("filter_positive_importance", f"SELECT feature, importance FROM {_PARTS} WHERE importance > 0")
def filter_positive_importance(spark, sf):
    return j.filter_positive(_parts(spark, sf), value="importance")


@query("sort_by_date", with_views("h", "SELECT k, CAST(d AS VARCHAR) AS d, v FROM h ORDER BY d, k"))
def sort_by_date(spark, sf):
    return plain(fx.customer_history(spark, sf).orderBy("d", "k"))


# --- split and folds over the decisions, by day -------------------------------

_DAYS = """(SELECT day, rows, CAST(sum(rows) OVER (ORDER BY day) AS BIGINT) AS upto, sum(c1) OVER (ORDER BY day) AS s1,
  sum(c2) OVER (ORDER BY day) AS s2, sum(c3) OVER (ORDER BY day) AS s3 FROM
  (SELECT CAST(ts AS DATE) AS day, count(*) AS rows, count(*) FILTER (WHERE decision = 'cut') AS c1,
   count(*) FILTER (WHERE decision = 'hold') AS c2, count(*) FILTER (WHERE decision = 'hike') AS c3
   FROM dec {0} GROUP BY 1))"""
_CUT = f"""(SELECT max(day) AS cut FROM {_DAYS.format('')}
  WHERE upto - rows <= (SELECT count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM dec))"""
_RANGES = """SELECT split, count(*) AS rows, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_date,
  CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_date FROM
  (SELECT ts, CASE WHEN CAST(ts AS DATE) < (SELECT cut FROM {0}) THEN 'train' ELSE 'test' END AS split FROM dec) GROUP BY 1"""


def _labelled_split(spark, sf):
    split = m.chronological_split(fx.decisions(spark, sf), date="ts")
    return split.train.withColumn("split", F.lit("train")).unionByName(
        split.test.withColumn("split", F.lit("test"))
    )


#: The side of the split of every decision.
SPLIT_ROWS = f"SELECT event_id, CASE WHEN CAST(ts AS DATE) < (SELECT cut FROM {_CUT}) THEN 'train' ELSE 'test' END AS split FROM dec"


@query("chronological_split", with_views("dec", SPLIT_ROWS))
def chronological_split(spark, sf):
    return _labelled_split(spark, sf).select("event_id", "split")


@query("partition_date_ranges", with_views("dec", _RANGES.format(_CUT)))
def partition_date_ranges(spark, sf):
    dated = _labelled_split(spark, sf).withColumn("day", F.to_date("ts"))
    return plain(m.partition_date_ranges(dated, split=["split"], date="day"))


@query(
    "class_complete_prefix",
    with_views(
        "dec",
        f"""SELECT CAST(min(upto) AS BIGINT) AS prefix_rows, CAST(min(day) AS VARCHAR) AS prefix_day
        FROM {_DAYS.format('')} WHERE s1 > 0 AND s2 > 0 AND s3 > 0""",
    ),
)
def class_complete_prefix(spark, sf):
    return plain(
        m.class_complete_prefix(
            fx.decisions(spark, sf), date="ts", label="decision", classes=K.DECISION_CLASSES
        )
    )


_FOLD_SQL = f"""SELECT f.fold, CASE WHEN CAST(d.ts AS DATE) < f.start THEN 'train' ELSE 'validate' END AS role,
  count(*) AS rows, CAST(min(CAST(d.ts AS DATE)) AS VARCHAR) AS first_date, CAST(max(CAST(d.ts AS DATE)) AS VARCHAR) AS last_date
  FROM dec d JOIN (
    SELECT i + 1 AS fold, start, lead(start) OVER (ORDER BY i) AS finish FROM (
      SELECT i, (SELECT min(day) FROM {_DAYS.format('')} WHERE upto - rows >= n - (5 - i) * size) AS start FROM (
        SELECT CAST(unnest(range(5)) AS INTEGER) AS i, n, least(n // 6, (n - complete) // 5) AS size FROM (
          SELECT max(upto) AS n, CAST(min(upto) FILTER (WHERE s1 > 0 AND s2 > 0 AND s3 > 0) AS BIGINT) AS complete
          FROM {_DAYS.format('')})))) f
  ON f.finish IS NULL OR CAST(d.ts AS DATE) < f.finish GROUP BY 1, 2"""


@query("forward_cv_folds", with_views("dec", _FOLD_SQL))
def forward_cv_folds(spark, sf):
    data = fx.decisions(spark, sf)
    folds = m.forward_cv_folds(data, date="ts", label="decision", classes=K.DECISION_CLASSES)
    dated = m.fold_roles(data, folds, date="ts").withColumn("day", F.to_date("ts"))
    return plain(m.partition_date_ranges(dated, split=["fold", "role"], date="day"))


# --- set operations -----------------------------------------------------------


@query(
    "union_by_name",
    """SELECT o_orderkey AS id, 'order' AS kind, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, NULL AS user_id FROM orders
    UNION ALL SELECT event_id, 'event', CAST(CAST(ts AS DATE) AS VARCHAR), user_id FROM events""",
)
def union_by_name(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        F.lit("order").alias("kind"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("d"),
    )
    events = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.lit("event").alias("kind"),
        F.col("ts").cast("date").alias("d"),
        "user_id",
    )
    return plain(orders.unionByName(events, allowMissingColumns=True))


@query(
    "set_mismatch_report",
    """SELECT coalesce(e.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
    FROM (SELECT DISTINCT doc_id AS id FROM documents) e FULL OUTER JOIN (SELECT DISTINCT doc_id AS id FROM labels
    UNION SELECT page_id * 7 FROM pages) a ON e.id = a.id WHERE e.id IS NULL OR a.id IS NULL""",
)
def set_mismatch_report(spark, sf):
    expected = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    actual = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).union(
        fx.table(spark, sf, "pages").select((F.col("page_id") * 7).alias("id"))
    )
    return q.set_mismatch_report(expected, actual, on="id")


# --- report tables ------------------------------------------------------------


@query(
    "holdout_report_tables",
    with_views(
        "c",
        """SELECT c.doc_id, d.n_chars AS rate, l.toxic, c.predicted, c.actual <> c.predicted AS incorrect
        FROM c LEFT JOIN documents d ON c.doc_id = d.doc_id LEFT JOIN labels l ON c.doc_id = l.doc_id""",
    ),
)
def holdout_report(spark, sf):
    tables = _report(spark, sf)
    return tables["rate_path"].join(
        tables["labour_path"].select("doc_id", "toxic"), "doc_id"
    )


def _report(spark, sf):
    docs = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id", "left")
    return holdout_report_tables(
        fx.class_pairs(spark, sf),
        docs.withColumnRenamed("n_chars", "rate"),
        _parts(spark, sf).withColumnRenamed("importance", "random_forest_importance"),
        on=["doc_id"],
        actual="actual",
        predicted="predicted",
        classes=_LABELS,
        rate="rate",
        labour=["toxic"],
    )


@query(
    "holdout_report_rows",
    with_views(
        "c",
        f"""SELECT * FROM (WITH p AS (SELECT c.doc_id, d.n_chars AS rate, l.toxic, c.actual, c.predicted FROM c
          LEFT JOIN documents d ON c.doc_id = d.doc_id LEFT JOIN labels l ON c.doc_id = l.doc_id)
        SELECT 'rate_path' AS part, CAST(doc_id AS VARCHAR) AS id, 'rate' AS metric, CAST(rate AS DOUBLE) AS value FROM p
        UNION ALL SELECT 'rate_path', CAST(doc_id AS VARCHAR), 'incorrect', CASE WHEN actual <> predicted THEN 1 ELSE 0 END FROM p
        UNION ALL SELECT 'labour_path', CAST(doc_id AS VARCHAR), 'toxic', toxic FROM p
        UNION ALL SELECT 'labour_path', CAST(doc_id AS VARCHAR), 'incorrect', CASE WHEN actual <> predicted THEN 1 ELSE 0 END FROM p
        UNION ALL SELECT 'confusion_matrix', CAST(a AS VARCHAR), 'predicted_' || b,
          (SELECT count(*) FROM c WHERE actual = a AND predicted = b) FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b)
        UNION ALL SELECT 'class_recall', CAST(actual AS VARCHAR), 'actual_rows', count(*) FROM c GROUP BY actual
        UNION ALL SELECT 'class_recall', CAST(actual AS VARCHAR), 'correct', count(*) FILTER (WHERE actual = predicted) FROM c GROUP BY actual
        UNION ALL SELECT 'top_features', feature, 'importance', importance FROM (SELECT * FROM {_PARTS} ORDER BY importance DESC, feature LIMIT 15)
        UNION ALL SELECT 'top_features', feature, 'rank', row_number() OVER (ORDER BY importance DESC, feature)
          FROM (SELECT * FROM {_PARTS} ORDER BY importance DESC, feature LIMIT 15)
        UNION ALL SELECT 'headline', '', 'events', count(*) FROM c
        UNION ALL SELECT 'headline', '', 'correct', count(*) FILTER (WHERE actual = predicted) FROM c
        UNION ALL SELECT 'headline', '', 'first', min(doc_id) FROM c UNION ALL SELECT 'headline', '', 'last', max(doc_id) FROM c)""",
    ),
)
def holdout_report_rows(spark, sf):
    """All six tables of the report, one row per value."""
    tables = _report(spark, sf)

    def long(part: str, id_col, **metrics):
        df = tables[part]
        cells = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()]
        out = df.select(id_col.cast("string").alias("id"), F.explode(F.array(*cells)).alias("_m"))
        return out.select(F.lit(part).alias("part"), "id", "_m.metric", "_m.value")

    wrong = F.col("incorrect").cast("int")
    parts = [
        long("rate_path", F.col("doc_id"), rate=F.col("rate"), incorrect=wrong),
        long("labour_path", F.col("doc_id"), toxic=F.col("toxic"), incorrect=wrong),
        long("confusion_matrix", F.col("actual"), **{f"predicted_{c}": F.col(f"predicted_{c}") for c in _LABELS}),
        long("class_recall", F.col("label"), actual_rows=F.col("actual_rows"), correct=F.col("correct")),
        long("top_features", F.col("feature"), importance=F.col("random_forest_importance"), rank=F.col("rank")),
        long("headline", F.lit(""), events=F.col("events"), correct=F.col("correct"), first=F.col("first_date"), last=F.col("last_date")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "headline_counts",
    with_views(
        "c",
        """SELECT count(*) AS events, count(*) FILTER (WHERE actual = predicted) AS correct,
        round(avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END), 10) AS accuracy, min(doc_id) AS first_date, max(doc_id) AS last_date FROM c""",
    ),
)
def headline(spark, sf):
    return plain(headline_counts(fx.class_pairs(spark, sf), date="doc_id", **_AP), digits=10)
