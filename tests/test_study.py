"""Studies that go on where they were stopped, and forests as tables of nodes."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from panelspark.functions.constants import DECISION_CLASSES
from panelspark.operators import forest as fo
from panelspark.operators import nodes as nd
from panelspark.plans import training as tr
from panelspark.plans.study import Study, table_mark

FEATURES = ["x", "y", "z"]
FIT = dict(label="decision", classes=DECISION_CLASSES)


@pytest.fixture(scope="module")
def panel(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(150):
        x, z = rnd.random(), rnd.random()
        label = "cut" if x < 0.3 else "hike" if z > 0.7 else "hold"
        rows.append((i, dt.date(2000, 1, 1) + dt.timedelta(days=i), x, rnd.random(), z, label))
    return spark.createDataFrame(rows, "id int, d date, x double, y double, z double, decision string").cache()


@pytest.mark.parametrize("params", [{}, {"max_depth": 3, "class_weight": "balanced", "min_samples_leaf": 5}])
def test_the_node_table_scores_like_the_model(spark, panel, params):
    rows = fo.assemble(panel, features=FEATURES, **FIT)
    model = fo.forest_fit(rows, params=params, num_trees=12, **FIT)
    nodes = nd.forest_nodes(model, spark, features=FEATURES, classes=DECISION_CLASSES).cache()
    want = {r.id: r for r in fo.forest_predict(model, rows, classes=DECISION_CLASSES).collect()}
    got = nd.score_by_nodes(rows, nodes, keep=["id"], features=FEATURES, classes=DECISION_CLASSES).collect()
    assert len(got) == len(want) == 150
    for r in got:
        for c in DECISION_CLASSES:
            assert r[f"probability_{c}"] == pytest.approx(want[r.id][f"probability_{c}"], abs=1e-12)
        assert r.predicted == want[r.id].predicted
    # Every inner node's rows are those of its children, and its threshold parts them.
    child = nodes.select("tree", F.col("node").alias("n"), F.col("n_rows").alias("r"))
    inner = nodes.where("left IS NOT NULL")
    for side in ("left", "right"):
        at = child.withColumnsRenamed({"n": side, "r": f"r_{side}"})
        inner = inner.join(at, ["tree", side])
    assert inner.where("n_rows <> r_left + r_right").count() == 0
    assert nodes.where("(feature IS NULL) <> (threshold IS NULL)").count() == 0
    assert nodes.select("tree").distinct().count() == 12
    importance = fo.feature_importance(model, spark, features=FEATURES).collect()
    by_nodes = {r.feature: r.importance for r in nd.importance_by_nodes(nodes, features=FEATURES).collect()}
    assert by_nodes == pytest.approx({r.feature: r.random_forest_importance for r in importance}, abs=1e-9)


def test_a_class_that_was_never_seen(spark, panel):
    rows = fo.assemble(panel.where("decision <> 'hold'"), features=FEATURES, **FIT)
    model = fo.forest_fit(rows, num_trees=3, **FIT)
    nodes = nd.forest_nodes(model, spark, features=FEATURES, classes=DECISION_CLASSES)
    got = nd.score_by_nodes(rows, nodes, keep=["id"], features=FEATURES, classes=DECISION_CLASSES)
    assert got.where("probability_hold <> 0 OR predicted = 'hold'").count() == 0


def test_pieces_run_once_and_a_failed_one_again(spark, tmp_path):
    calls, lock, fail = [], threading.Lock(), {"b"}

    def work(name):
        with lock:
            calls.append(name)
        if name in fail:
            raise RuntimeError("stopped")
        return {"name": name, "n": spark.range(10).count()}

    study = Study(spark, str(tmp_path), {"work": 1})
    with pytest.raises(RuntimeError, match="stopped"):
        study.run("abc", work, workers=3)
    assert sorted(calls) == ["a", "b", "c"]
    fail.clear()
    again = Study(spark, str(tmp_path), {"work": 1}).run("abcd", work, workers=2)
    assert list(again) == ["a", "b", "c", "d"] and again["a"] == {"name": "a", "n": 10}
    assert sorted(calls) == ["a", "b", "b", "c", "d"]
    other = Study(spark, str(tmp_path), {"work": 2})
    assert other.record("a") is None


def test_pieces_run_side_by_side(spark, tmp_path):
    together = threading.Barrier(3, timeout=60)
    Study(spark, str(tmp_path), {}).run("abc", lambda name: {"n": together.wait()}, workers=3)


def test_a_stopped_search_goes_on(spark, panel, tmp_path, monkeypatch):
    split, folds = tr.split_and_folds(panel, date="d", k=3, **FIT)
    grid = fo.parameter_grid(depths=(2, 3), leaves=(1,), features=("sqrt",), weights=(None, "balanced"))
    search = lambda: tr.forest_grid_search(
        split.train, features=FEATURES, date="d", folds=folds, grid=grid, num_trees=3, store=str(tmp_path), **FIT
    )
    real, fits = tr.fold_scores, []

    def counted(*args, **kw):
        if len(fits) == 2:
            raise RuntimeError("executor lost")
        fits.append(kw["params"])
        return real(*args, **kw)

    monkeypatch.setattr(tr, "fold_scores", counted)
    with pytest.raises(RuntimeError, match="lost"):
        search()
    monkeypatch.setattr(tr, "fold_scores", lambda *a, **kw: fits.append(kw["params"]) or real(*a, **kw))
    found = search()
    assert len(fits) == 4 and {str(p) for p in fits} == {str(p) for p in grid}
    assert [c["params"] for c in found["candidates"]] == grid
    assert found["best_cv_macro_f1"] == max(c["mean_macro_f1"] for c in found["candidates"])
    assert search()["candidates"] == found["candidates"] and len(fits) == 4


def test_missing_seeds_only_are_run(spark, panel, tmp_path, monkeypatch):
    split, folds = tr.split_and_folds(panel, date="d", k=3, **FIT)
    real, seeds = tr.fold_scores, []
    monkeypatch.setattr(tr, "fold_scores", lambda *a, **kw: seeds.append(kw["seed"]) or real(*a, **kw))
    study = lambda which: tr.seed_sensitivity(
        split.train, split.test, keep=["id"], features=FEATURES, date="d", folds=folds,
        params={"max_depth": 3}, seeds=which, num_trees=3, store=str(tmp_path), **FIT,
    )
    study((42,))
    results, predictions = study((7, 42))
    assert seeds == [42, 7]
    rows = {r.random_state: r for r in results.collect()}
    assert set(rows) == {7, 42} and predictions.count() == 2 * 30
    recomputed = predictions.groupBy("random_state").agg(F.avg(F.col("correct").cast("int")).alias("a"))
    for r in recomputed.collect():
        assert r.a == pytest.approx(rows[r.random_state].holdout_accuracy)
    assert rows[42].cv_macro_f1_mean_delta_vs_configured_seed == 0.0


def test_balanced_weights_of_folds_come_from_one_count(spark, panel):
    _, folds = tr.split_and_folds(panel, date="d", k=3, **FIT)
    counts = fo.fold_class_counts(panel, folds, date="d", **FIT)
    assert len(counts) == 4 and sum(counts[-1].values()) == 150
    for f, n in zip(folds, counts, strict=False):
        part = panel.where(F.col("d") < F.lit(f["start"]))
        assert fo.class_counts(part, **FIT) == n
        own = fo.class_weight_balanced(part, **FIT).select("class_weight").collect()
        assert fo.class_weight_balanced(part, counts=n, **FIT).select("class_weight").collect() == own


def test_a_table_is_known_by_its_content(spark, panel):
    assert table_mark(panel) == table_mark(panel.repartition(5))
    assert table_mark(panel) != table_mark(panel.where("id > 0"))
    assert table_mark(panel.unionByName(panel)) != table_mark(panel)
