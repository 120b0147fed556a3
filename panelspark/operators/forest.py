"""Random-forest operators on distributed ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from .metrics import classification_report

# Spark grows trees to depth 30 at most; it stands for "unlimited".
UNLIMITED_DEPTH = 30


def parameter_grid(
    depths=K.GRID_MAX_DEPTH,
    leaves=K.GRID_MIN_LEAF,
    features=K.GRID_MAX_FEATURES,
    weights=K.GRID_CLASS_WEIGHT,
) -> list[dict]:
    """Candidates in search order; the first of equals wins."""
    return [
        {"class_weight": w, "max_depth": d, "max_features": f, "min_samples_leaf": m}
        for w, d, f, m in product(weights, depths, features, leaves)
    ]


def class_counts(df: DataFrame, *, label: str, classes: Sequence[str]) -> dict[str, int]:
    """Rows of each class: one row of conditional counts."""
    counts = df.agg(*[F.count_if(F.col(label) == c).alias(f"c{i}") for i, c in enumerate(classes)]).first()
    return {c: counts[i] for i, c in enumerate(classes)}


def fold_class_counts(
    df: DataFrame, folds: Sequence[Mapping], *, date: str, label: str, classes: Sequence[str]
) -> list[dict[str, int]]:
    """Class counts of the training part of every fold, then of all rows, in one job."""
    at = [F.lit(f["start"]).cast(df.schema[date].dataType) for f in folds]
    parts = [F.col(date) < start for start in at] + [F.lit(True)]
    cells = {(i, c): F.count_if(p & (F.col(label) == c)) for i, p in enumerate(parts) for c in classes}
    row = df.agg(*[v.alias(f"n{k}") for k, v in enumerate(cells.values())]).first()
    out: list[dict[str, int]] = [{} for _ in parts]
    for (i, c), n in zip(cells, row, strict=True):
        out[i][c] = n
    return out


def class_weight_balanced(
    df: DataFrame,
    *,
    label: str,
    classes: Sequence[str],
    out: str = "class_weight",
    counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """Weight ``n / (k * n_c)`` per row, ``k`` being the classes present.

    ``counts`` are the rows of each class if they are known; else they are counted, as
    one row read as scalars, so the rows are not moved.
    """
    if counts is None:
        counts = class_counts(df, label=label, classes=classes)
    present = {c: n for c, n in counts.items() if n}
    n = sum(present.values())
    weight = F.lit(None).cast("double")
    for c, rows in present.items():
        weight = F.when(F.col(label) == c, F.lit(n / (len(present) * rows))).otherwise(weight)
    return df.withColumn(out, weight)


def alphabetical(classes: Sequence[str]) -> list[str]:
    """Model class order; reports use the configured order and map by name."""
    return sorted(classes)


def assemble(
    df: DataFrame, *, features: Sequence[str], label: str, classes: Sequence[str]
) -> DataFrame:
    """Add the vector ``features`` and the numeric ``label_index``.

    The class list is fixed, so no fitting pass over the data is needed.
    """
    index = F.lit(None).cast("double")
    for i, c in enumerate(alphabetical(classes)):
        index = F.when(F.col(label) == c, F.lit(float(i))).otherwise(index)
    numeric = df.select("*", *[F.col(f).cast("double").alias(f"_x_{f}") for f in features])
    vectors = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="features")
    return (
        vectors.transform(numeric)
        .drop(*[f"_x_{f}" for f in features])
        .withColumn("label_index", index)
    )


def forest_fit(
    assembled: DataFrame,
    *,
    label: str,
    classes: Sequence[str],
    params: Mapping | None = None,
    num_trees: int = K.NUM_TREES,
    seed: int = K.RANDOM_STATE,
    counts: Mapping[str, int] | None = None,
) -> RandomForestClassificationModel:
    """Fit a Gini forest on rows prepared by ``assemble``.

    ``counts`` are the rows of each class, if known, for balanced weights.
    """
    params = dict(params or {})
    depth = params.get("max_depth")
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="label_index",
        numTrees=num_trees,
        impurity="gini",
        maxDepth=UNLIMITED_DEPTH if depth is None else depth,
        minInstancesPerNode=params.get("min_samples_leaf", 1),
        featureSubsetStrategy=str(params.get("max_features", "sqrt")),
        seed=seed,
    )
    rows = assembled
    if params.get("class_weight") == "balanced":
        rows = class_weight_balanced(rows, label=label, classes=classes, counts=counts)
        forest = forest.setWeightCol("class_weight")
    return forest.fit(rows)


def forest_predict(
    model: RandomForestClassificationModel,
    assembled: DataFrame,
    *,
    classes: Sequence[str],
    prefix: str = "probability_",
    predicted: str = "predicted",
) -> DataFrame:
    """Predicted class and one probability column per class, mapped by name.

    The first of equally probable classes in model order is predicted.
    """
    order = alphabetical(classes)
    scored = model.transform(assembled).withColumn("_p", vector_to_array("probability"))
    name = F.element_at(F.array(*[F.lit(c) for c in order]), (F.col("prediction") + 1).cast("int"))
    return scored.withColumns(
        {
            predicted: name,
            # A class the model never saw has no slot and probability 0.
            **{
                f"{prefix}{c}": F.coalesce(F.get("_p", F.lit(order.index(c))), F.lit(0.0))
                for c in classes
            },
        }
    ).drop("_p", "rawPrediction", "probability", "prediction", "features", "label_index")


def prediction_table(
    predictions: DataFrame, *, keep: Sequence[str], actual: str, predicted: str, classes: Sequence[str]
) -> DataFrame:
    """Report columns: identity, actual, predicted, correct, probabilities."""
    return predictions.select(
        *keep,
        F.col(actual).alias("actual_decision"),
        F.col(predicted).alias("random_forest_prediction"),
        (F.col(actual) == F.col(predicted)).alias("random_forest_correct"),
        *[F.col(f"probability_{c}").alias(f"random_forest_probability_{c}") for c in classes],
    )


def feature_importance(
    model: RandomForestClassificationModel, spark, *, features: Sequence[str]
) -> DataFrame:
    """Impurity importance per feature with its competition rank.

    One value per feature, so the table is as small as the feature list.
    """
    values = [float(v) for v in model.featureImportances.toArray()]
    rows = [(f, v, 1 + sum(o > v for o in values)) for f, v in zip(features, values, strict=True)]
    return spark.createDataFrame(
        rows, "feature string, random_forest_importance double, random_forest_rank int"
    )


def score(
    predictions: DataFrame, *, actual: str, predicted: str, classes: Sequence[str], macro: str
) -> dict:
    """Metrics of one prediction table as a plain dict (one row)."""
    report = classification_report(
        predictions, actual=actual, predicted=predicted, labels=list(classes), macro=macro
    )
    return report.first().asDict()


def search_table(spark, result: Mapping) -> DataFrame:
    """The candidates of a search, one row each."""
    rows = [
        (
            r["candidate"],
            str(r["params"].get("class_weight")),
            str(r["params"].get("max_depth")),
            str(r["params"].get("max_features")),
            int(r["params"].get("min_samples_leaf", 1)),
            float(r["mean_macro_f1"]),
            r["params"] == result["best_params"],
        )
        for r in result["candidates"]
    ]
    return spark.createDataFrame(
        rows,
        "candidate int, class_weight string, max_depth string, max_features string, "
        "min_samples_leaf int, mean_macro_f1 double, selected boolean",
    )
