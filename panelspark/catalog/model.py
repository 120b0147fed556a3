"""Forest training and evaluation on the decision features (rows-only checks).

The registered queries train small forests; tree count, grid and seeds of the
full study are parameters with the published values as defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..operators import forest as fo
from ..operators import nodes as nd
from ..operators.metrics import class_counts_zero_filled
from ..plans import training as tr
from ..sources.storage import scratch_path, staged
from ..sources.writers import write_metrics_json
from . import fixtures as fx
from .aggregates import SPLIT_ROWS
from .registry import query, with_views

_CLASSES = K.DECISION_CLASSES
_FEATURES = fx.HISTORY_FEATURES
_TREES = 10
_GRID = fo.parameter_grid(depths=(5,), leaves=(1, 5), features=("sqrt",), weights=(None,))
_PARAMS = {"max_depth": 5, "min_samples_leaf": 5, "max_features": "sqrt", "class_weight": "balanced"}


def _panel(spark, sf):
    """Feature table; training passes over it many times, so it is written once."""
    return fx.materialise(fx.decision_features(spark, sf), "decision_features")


def _fitted(spark, sf):
    panel = _panel(spark, sf)
    rows = fo.assemble(panel, features=_FEATURES, label="decision", classes=_CLASSES)
    model = fo.forest_fit(rows, label="decision", classes=_CLASSES, params=_PARAMS, num_trees=_TREES)
    return rows, model


@query("forest_fit")
def forest_fit(spark, sf):
    rows, model = _fitted(spark, sf)
    found = fo.forest_predict(model, rows, classes=_CLASSES)
    return class_counts_zero_filled(found, label="predicted", labels=_CLASSES).withColumn(
        "trees", F.lit(model.getNumTrees)
    )


@query("forest_predict_proba")
def forest_predict_proba(spark, sf):
    rows, model = _fitted(spark, sf)
    found = fo.forest_predict(model, rows, classes=_CLASSES)
    return fo.prediction_table(
        found, keep=["event_id"], actual="decision", predicted="predicted", classes=_CLASSES
    )


@query("feature_importance")
def feature_importance(spark, sf):
    _, model = _fitted(spark, sf)
    return fo.feature_importance(model, spark, features=_FEATURES)


def _trained(spark, sf):
    return tr.train_forest(
        _panel(spark, sf),
        keep=["event_id"],
        date="ts",
        features=_FEATURES,
        grid=_GRID,
        num_trees=_TREES,
    )


@query("forest_grid_search")
def forest_grid_search(spark, sf):
    return fo.search_table(spark, _trained(spark, sf))


@query("metrics_document")
def metrics_document(spark, sf):
    return tr.metrics_document(_trained(spark, sf), date="ts", features=_FEATURES)


@query("write_metrics_json")
def write_metrics_json_query(spark, sf):
    document = tr.metrics_document(_trained(spark, sf), date="ts", features=_FEATURES)
    path = scratch_path(spark, "metrics")
    write_metrics_json(document, path)
    return spark.read.schema(document.schema).json(path)


def _seed_study(spark, sf):
    panel = _panel(spark, sf)
    split, folds = tr.split_and_folds(panel, date="ts", label="decision", classes=_CLASSES)
    return tr.seed_sensitivity(
        split.train,
        split.test,
        keep=["event_id"],
        features=_FEATURES,
        label="decision",
        classes=_CLASSES,
        date="ts",
        folds=folds,
        params=_PARAMS,
        seeds=(41, K.RANDOM_STATE),
        num_trees=_TREES,
    )


@query("seed_sensitivity")
def seed_sensitivity(spark, sf):
    return _seed_study(spark, sf)[0]


@query("seed_predictions")
def seed_predictions(spark, sf):
    return _seed_study(spark, sf)[1]


# --- what must hold of them, whatever the forest ---------------------------------


def _checks(**counts: DataFrame) -> DataFrame:
    """``(check_name, n)``: one row of one count per check."""
    return reduce(
        DataFrame.unionByName,
        [
            df.toDF("_n").select(F.lit(name).alias("check_name"), F.col("_n").cast("long").alias("n"))
            for name, df in counts.items()
        ],
    )


def _n(df: DataFrame, condition=None) -> DataFrame:
    return df.agg(F.count(F.lit(1)) if condition is None else F.count_if(condition))


def _apart(a: str, b: str):
    return F.coalesce(F.abs(F.col(a) - F.col(b)) > 1e-9, F.lit(True))


@query(
    "forest_node_checks",
    f"""SELECT 'trees' AS check_name, CAST({_TREES} AS BIGINT) AS n UNION ALL
    SELECT 'rows_scored', count(*) FROM events UNION ALL SELECT 'rows_apart', 0 UNION ALL
    SELECT 'classes_apart', 0 UNION ALL SELECT 'importances_apart', 0 UNION ALL
    SELECT 'nodes_without_their_rows', 0""",
)
def forest_node_checks(spark, sf):
    """Probabilities from the node table against those of the model, row by row."""
    rows, model = _fitted(spark, sf)
    nodes = staged(nd.forest_nodes(model, spark, features=_FEATURES, classes=_CLASSES), "nodes")
    probabilities = [f"probability_{c}" for c in _CLASSES]
    own = nd.score_by_nodes(rows, nodes, keep=["event_id"], features=_FEATURES, classes=_CLASSES)
    theirs = fo.forest_predict(model, rows, classes=_CLASSES).select(
        F.col("event_id").alias("id"), F.col("predicted").alias("called"), *[F.col(p).alias(f"m_{p}") for p in probabilities]
    )
    both = staged(own.join(theirs, F.col("event_id") == F.col("id"), "full"), "scored")
    apart = reduce(lambda x, y: x | y, [_apart(p, f"m_{p}") for p in probabilities])
    # Where two classes are equally probable, sums in another order may differ.
    best = F.sort_array(F.array(*probabilities), asc=False)
    clear = best[0] - best[1] > 1e-9
    importance = fo.feature_importance(model, spark, features=_FEATURES)
    by_nodes = nd.importance_by_nodes(nodes, features=_FEATURES)
    children = nodes.select("tree", F.explode_outer(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
    sums = children.join(nodes.select("tree", "node", "n_rows"), ["tree", "node"]).groupBy("tree", F.col("parent").alias("node"))
    inner = nodes.where("left IS NOT NULL").join(sums.agg(F.sum("n_rows").alias("below")), ["tree", "node"], "left")
    return _checks(
        trees=nodes.agg(F.count_distinct("tree")),
        rows_scored=_n(both),
        rows_apart=_n(both, apart),
        classes_apart=_n(both, clear & (F.col("predicted") != F.col("called"))),
        importances_apart=_n(
            importance.join(by_nodes, "feature", "full"), _apart("importance", "random_forest_importance")
        ),
        nodes_without_their_rows=_n(inner, ~F.col("n_rows").eqNullSafe(F.col("below"))),
    )


@query(
    "search_checks",
    with_views(
        "dec",
        f"""SELECT 'candidates' AS check_name, CAST({len(_GRID)} AS BIGINT) AS n UNION ALL SELECT 'selected', 1 UNION ALL
        SELECT 'selected_below_best', 0 UNION ALL SELECT 'means_apart', 0 UNION ALL
        SELECT 'fold_scores', {len(_GRID) * K.CV_SPLITS} UNION ALL
        SELECT 'train_rows', (SELECT count(*) FROM ({SPLIT_ROWS}) WHERE split = 'train') UNION ALL
        SELECT 'holdout_rows', (SELECT count(*) FROM ({SPLIT_ROWS}) WHERE split = 'test') UNION ALL
        SELECT 'confusion_total', (SELECT count(*) FROM ({SPLIT_ROWS}) WHERE split = 'test') UNION ALL
        SELECT 'importance_sum_apart', 0 UNION ALL SELECT 'probability_sums_apart', 0""",
    ),
)
def search_checks(spark, sf):
    """What a search must say of itself, its data and its document."""
    result = _trained(spark, sf)
    table = fo.search_table(spark, result)
    folds = spark.createDataFrame(
        [(c["candidate"], f) for c in result["candidates"] for f in c["fold_scores"]], "candidate int, f1 double"
    )
    means = folds.groupBy("candidate").agg(F.avg("f1").alias("mean")).join(table, "candidate", "full")
    best = table.agg(F.max("mean_macro_f1").alias("best"), F.max(F.when(F.col("selected"), F.col("mean_macro_f1"))).alias("own"))
    document = tr.metrics_document(result, date="ts", features=_FEATURES)
    total = F.aggregate(F.flatten("holdout.confusion_matrix"), F.lit(0).cast("long"), lambda s, x: s + x)
    predictions = result["predictions"]
    shares = reduce(lambda x, y: x + y, [F.col(f"random_forest_probability_{c}") for c in _CLASSES])
    return _checks(
        candidates=_n(table),
        selected=_n(table, F.col("selected")),
        selected_below_best=_n(best, _apart("best", "own")),
        means_apart=_n(means, _apart("mean", "mean_macro_f1")),
        fold_scores=_n(folds),
        train_rows=document.select("dataset.train_rows"),
        holdout_rows=document.select("dataset.test_rows"),
        confusion_total=document.select(total),
        importance_sum_apart=_n(
            result["importance"].agg(F.sum("random_forest_importance").alias("s")), F.abs(F.col("s") - 1) > 1e-9
        ),
        probability_sums_apart=_n(predictions, F.abs(shares - 1) > 1e-9),
    )


@query(
    "seed_study_checks",
    with_views(
        "dec",
        f"""SELECT 'seeds' AS check_name, CAST(2 AS BIGINT) AS n UNION ALL
        SELECT 'predictions', 2 * (SELECT count(*) FROM ({SPLIT_ROWS}) WHERE split = 'test') UNION ALL
        SELECT 'rows_without_an_event', 0 UNION ALL SELECT 'accuracies_apart', 0 UNION ALL
        SELECT 'baseline_deltas', 0 UNION ALL SELECT 'fold_means_apart', 0""",
    ),
)
def seed_study_checks(spark, sf):
    """Accuracy recomputed from every written prediction, and the deltas of the baseline."""
    results, predictions = _seed_study(spark, sf)
    again = predictions.groupBy(F.col("random_state").alias("seed")).agg(
        F.avg((F.col("actual_decision") == F.col("predicted_decision")).cast("int")).alias("again")
    )
    scored = results.join(again, F.col("random_state") == F.col("seed"), "full")
    # The actual classes are those of the events themselves.
    events = fx.decisions(spark, sf).select("event_id", F.col("decision").alias("truth"))
    lost = predictions.join(events, "event_id", "left").where(~F.col("truth").eqNullSafe(F.col("actual_decision")))
    deltas = [F.col(f"{m}_delta_vs_configured_seed") != 0 for m in tr.DELTA_METRICS]
    folds = reduce(lambda x, y: x + y, [F.col(f"fold_{i + 1}_accuracy") for i in range(K.CV_SPLITS)])
    means = results.select((folds / K.CV_SPLITS).alias("again"), "cv_accuracy_mean")
    return _checks(
        seeds=_n(results),
        predictions=_n(predictions),
        rows_without_an_event=_n(lost),
        accuracies_apart=_n(scored, _apart("again", "holdout_accuracy")),
        baseline_deltas=_n(
            results.where(F.col("random_state") == K.RANDOM_STATE), reduce(lambda x, y: x | y, deltas)
        ),
        fold_means_apart=_n(means, _apart("again", "cv_accuracy_mean")),
    )
