"""Metrics, splits and folds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions.constants import DECISION_CLASSES
from panelspark.operators import metrics as m

D0 = dt.date(2000, 1, 1)


def pairs(spark, matrix, labels):
    rows = [
        (a, p)
        for a, line in zip(labels, matrix)
        for p, n in zip(labels, line)
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "actual string, predicted string")


def test_published_matrix_gives_published_metrics(spark):
    df = pairs(spark, [[7, 0, 0], [1, 33, 3], [0, 0, 11]], DECISION_CLASSES)
    row = m.classification_report(df, actual="actual", predicted="predicted", labels=DECISION_CLASSES).first()
    assert row.n == 55
    assert round(row.accuracy, 3) == 0.927
    assert round(row.balanced_accuracy, 3) == 0.964
    assert round(row.macro_f1, 3) == 0.919
    wide = {r.actual: (r.predicted_cut, r.predicted_hold, r.predicted_hike) for r in
            m.confusion_matrix(df, actual="actual", predicted="predicted", labels=DECISION_CLASSES).collect()}
    assert wide == {"cut": (7, 0, 0), "hold": (1, 33, 3), "hike": (0, 0, 11)}


def test_macro_variants_differ_on_absent_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b")], "actual string, predicted string")
    kw = dict(actual="actual", predicted="predicted", labels=["a", "b", "c"])
    assert m.classification_report(df, **kw).first().macro_f1 == 1.0
    assert round(m.classification_report(df, macro="fixed", **kw).first().macro_f1, 3) == 0.667


def panel(spark, n, label=lambda i: DECISION_CLASSES[i % 3], per_day=1):
    rows = [(i, D0 + dt.timedelta(days=i // per_day), label(i)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, d date, decision string")


def test_split_and_folds_of_the_published_size(spark):
    # First complete prefix is 20: "hike" first occurs at position 19.
    df = panel(spark, 273, lambda i: "hike" if i == 19 else ("cut" if i % 2 else "hold") if i < 20 else DECISION_CLASSES[i % 3])
    split = m.chronological_split(df, date="d")
    assert (split.train.count(), split.test.count()) == (218, 55)
    prefix = m.class_complete_prefix(split.train, date="d", label="decision", classes=DECISION_CLASSES).first()
    assert prefix.prefix_rows == 20
    folds = m.forward_cv_folds(split.train, date="d", label="decision", classes=DECISION_CLASSES)
    assert [(f["start"] - D0).days for f in folds] == [38, 74, 110, 146, 182]
    for f in folds:
        fit, held = m.fold_parts(split.train, f, date="d")
        assert held.count() == 36
        assert fit.agg({"d": "max"}).first()[0] < held.agg({"d": "min"}).first()[0]


def test_split_keeps_days_whole(spark):
    split = m.chronological_split(panel(spark, 100, per_day=7), date="d")
    assert split.test.count() >= 20
    assert split.train.agg({"d": "max"}).first()[0] < split.test.agg({"d": "min"}).first()[0]


def test_short_history_is_refused(spark):
    with pytest.raises(ValueError):
        m.forward_cv_folds(panel(spark, 5), date="d", label="decision", classes=DECISION_CLASSES)
    with pytest.raises(ValueError):
        m.forward_cv_folds(panel(spark, 60, lambda i: "cut"), date="d", label="decision", classes=DECISION_CLASSES)
    with pytest.raises(ValueError):
        m.chronological_split(panel(spark, 10, per_day=10), date="d")


def test_rankings(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.0), ("d", 0.2)], "feature string, v double")
    out = [tuple(r) for r in m.topk_most_least(df, value="v", name="feature", k=3).collect()]
    assert out == [
        ("most_influential", 1, "a", 0.5), ("most_influential", 2, "b", 0.5), ("most_influential", 3, "d", 0.2),
        ("least_influential", 1, "c", 0.0), ("least_influential", 2, "d", 0.2), ("least_influential", 3, "a", 0.5),
    ]
    chart = m.topk_chart_rows(df, value="v", name="feature", k=2).collect()
    assert [(r.feature, r.is_leader) for r in chart] == [("b", False), ("a", True)]


def test_baseline_row_must_be_one(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "seed int, x double")
    out = m.delta_vs_baseline_row(df, row=F.col("seed") == 1, metrics=["x"])
    assert {r.seed: round(r.x_delta, 6) for r in out.collect()} == {1: 0.0, 2: 0.2}
    with pytest.raises(ValueError):
        m.delta_vs_baseline_row(df, row=F.col("seed") == 9, metrics=["x"])


def test_null_and_unlisted_classes_count_as_wrong(spark):
    rows = [("cut", "cut"), ("hold", "hold"), (None, "hold"), ("hold", None), ("other", "other"), (None, None)]
    df = spark.createDataFrame(rows, "actual string, predicted string")
    kw = dict(actual="actual", predicted="predicted")
    assert tuple(m.accuracy(df, **kw).first()) == (0.5, 6)
    report = m.classification_report(df, **kw, labels=DECISION_CLASSES).first()
    assert (report.n, report.accuracy, report.unlisted) == (6, 2 / 6, 4)
    assert [r.correct for r in m.predict_correct_flag(df, **kw).collect()] == [True, True, False, False, True, False]


def test_rows_without_a_date_are_refused(spark):
    df = panel(spark, 60)
    bad = df.limit(1).withColumn("d", F.lit(None).cast(df.schema["d"].dataType)).unionByName(df)
    for build in (
        lambda: m.chronological_split(bad, date="d"),
        lambda: m.forward_cv_folds(bad, date="d", label="decision", classes=DECISION_CLASSES),
        lambda: m.class_complete_prefix(bad, date="d", label="decision", classes=DECISION_CLASSES).collect(),
    ):
        with pytest.raises(Exception, match="has no d"):
            build()
