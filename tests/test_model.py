"""Forest operators: shape, determinism and forward folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions.constants import DECISION_CLASSES
from panelspark.operators import forest as fo
from panelspark.plans import training as tr

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def panel(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(180):
        x = rnd.random()
        label = "cut" if x < 0.3 else "hike" if x > 0.7 else "hold"
        rows.append((i, dt.date(2000, 1, 1) + dt.timedelta(days=i), x, rnd.random(), label))
    return spark.createDataFrame(rows, "id int, d date, x double, y double, decision string").cache()


def test_grid_has_the_published_size_and_order():
    grid = fo.parameter_grid()
    assert len(grid) == 36
    assert grid[0] == {"class_weight": None, "max_depth": 5, "max_features": "sqrt", "min_samples_leaf": 1}
    assert grid[1]["min_samples_leaf"] == 3 and grid[-1]["class_weight"] == "balanced"


def test_training_and_document(spark, panel):
    grid = fo.parameter_grid(depths=(3,), leaves=(1, 3), features=("sqrt",), weights=("balanced",))
    result = tr.train_forest(panel, keep=["id"], date="d", features=FEATURES, grid=grid, num_trees=8)
    rows = result["predictions"].collect()
    assert len(rows) == 36
    for r in rows:
        p = [r[f"random_forest_probability_{c}"] for c in DECISION_CLASSES]
        assert abs(sum(p) - 1) < 1e-9
        assert r.random_forest_prediction in DECISION_CLASSES
    assert sum(r.random_forest_correct for r in rows) > 25
    best = max(c["mean_macro_f1"] for c in result["candidates"])
    assert result["best_cv_macro_f1"] == best
    imp = {r.feature: r for r in result["importance"].collect()}
    assert imp["x"].random_forest_rank == 1
    assert abs(sum(r.random_forest_importance for r in imp.values()) - 1) < 1e-9
    doc = tr.metrics_document(result, date="d", features=FEATURES).first()
    assert doc.dataset.train_rows == 144 and doc.dataset.test_rows == 36
    assert sum(map(sum, doc.holdout.confusion_matrix)) == 36
    assert [e.feature for e in doc.feature_influence.rankings.most_influential] == ["x", "y"]


def test_seed_study(spark, panel):
    split, folds = tr.split_and_folds(panel, date="d", label="decision", classes=DECISION_CLASSES, k=3)
    results, predictions = tr.seed_sensitivity(
        split.train, split.test, keep=["id"], features=FEATURES, label="decision", classes=DECISION_CLASSES,
        date="d", folds=folds, params={"max_depth": 3}, seeds=(1, 42), num_trees=3,
    )
    rows = {r.random_state: r for r in results.collect()}
    assert set(rows) == {1, 42}
    assert rows[42].holdout_accuracy_delta_vs_configured_seed == 0.0
    assert predictions.count() == 2 * 36
    hit = predictions.where("random_state = 42").agg(F.avg(F.col("correct").cast("int"))).first()[0]
    assert abs(hit - rows[42].holdout_accuracy) < 1e-12


def test_balanced_weights(spark):
    df = spark.createDataFrame([("cut",)] * 1 + [("hold",)] * 3, "decision string")
    out = fo.class_weight_balanced(df, label="decision", classes=DECISION_CLASSES)
    got = {r.decision: r.class_weight for r in out.distinct().collect()}
    assert got == {"cut": 2.0, "hold": pytest.approx(4 / 6)}
