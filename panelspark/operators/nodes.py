"""A fitted forest as a table of nodes, and its scores computed from that table.

The table can be queried, joined and kept like any other; scoring it is a second path
to the probabilities, independent of the model object.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..sources.storage import scratch_path
from .forest import UNLIMITED_DEPTH, alphabetical


def forest_nodes(
    model: RandomForestClassificationModel,
    spark,
    *,
    features: Sequence[str],
    classes: Sequence[str],
    path: str | None = None,
) -> DataFrame:
    """One row per node: ``tree, node, feature, threshold, left, right``, the gain of its
    split, the weighted training rows of each class (``rows_<class>``) and ``n_rows``.

    Node 0 is the root; a leaf has no feature, threshold, children or gain.  Rows with a
    value of at most ``threshold`` go left.  The model is saved by its own writer to
    ``path`` (else to the shared folder) and the nodes are read from there.
    """
    path = path or scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    names = F.array(*[F.lit(f) for f in features])
    order = alphabetical(classes)
    inner = node["leftChild"] >= 0
    categorical = F.raise_error(F.lit("a categorical split has no threshold")).cast("double")
    threshold = F.when(node["split"]["numCategories"] >= 0, categorical).otherwise(
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))
    )
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, F.get(names, node["split"]["featureIndex"])).alias("feature"),
        F.when(inner, threshold).alias("threshold"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        F.when(inner, node["gain"]).alias("gain"),
        # A class that the model never saw has no slot.
        *[F.coalesce(F.get(node["impurityStats"], F.lit(order.index(c))), F.lit(0.0)).alias(f"rows_{c}") for c in classes],
        node["rawCount"].alias("n_rows"),
    )


def score_by_nodes(
    assembled: DataFrame,
    nodes: DataFrame,
    *,
    keep: Sequence[str],
    features: Sequence[str],
    classes: Sequence[str],
    prefix: str = "probability_",
    predicted: str = "predicted",
) -> DataFrame:
    """Class and probabilities of every row of ``assembled``, from the node table alone.

    ``keep`` identifies a row.  Each row meets every tree once, by the number of the
    tree, and walks down its nodes; the shares of classes at the leaves are averaged,
    combined in the map tasks.  The first of equally probable classes in alphabetical
    order is predicted.  A tree is one value of its nodes, as in the model itself.
    """
    number = F.element_at(F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))]), F.col("feature"))
    shares = [f"rows_{c}" for c in classes]
    node = F.struct("node", F.coalesce(number, F.lit(-1)).alias("at"), "threshold", "left", "right", *shares)
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    last = nodes.agg(F.max("tree").alias("t")).first()["t"]
    rows = assembled.select(*keep, vector_to_array("features").alias("_x"))
    met = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("tree")).join(trees, "tree")

    def step(at: Column, _: Column) -> Column:
        here = F.get("nodes", at)
        below = F.when(F.get("_x", here["at"]) <= here["threshold"], here["left"]).otherwise(here["right"])
        return F.when(here["left"].isNull(), at).otherwise(below)

    leaf = F.aggregate(F.sequence(F.lit(0), F.lit(UNLIMITED_DEPTH)), F.lit(0), step)

    def share_of(n: Column) -> Column:
        total = sum((n[s] for s in shares[1:]), n[shares[0]])
        return F.struct(*[(n[s] / total).alias(c) for s, c in zip(shares, classes, strict=True)])

    at_leaf = met.select(*keep, let(F.get("nodes", leaf), share_of).alias("_s"))
    scored = at_leaf.groupBy(*keep).agg(*[F.avg(f"_s.{c}").alias(f"{prefix}{c}") for c in classes])
    best = F.greatest(*[F.col(f"{prefix}{c}") for c in classes])
    name = F.lit(None).cast("string")
    for c in reversed(alphabetical(classes)):
        name = F.when(F.col(f"{prefix}{c}") == best, F.lit(c)).otherwise(name)
    return scored.withColumn(predicted, name)


def importance_by_nodes(nodes: DataFrame, *, features: Sequence[str]) -> DataFrame:
    """Impurity importance per feature from the node table: gains times the weighted rows
    of their nodes, as shares of each tree, averaged and made to sum to one."""
    split = nodes.where("feature IS NOT NULL")
    rows = reduce(Column.__add__, [F.col(c) for c in nodes.columns if c.startswith("rows_")])
    by_tree = split.groupBy("tree", "feature").agg(F.sum(F.col("gain") * rows).alias("g"))
    whole = by_tree.groupBy("tree").agg(F.sum("g").alias("total")).where("total > 0")
    shares = by_tree.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("total")).alias("s"))
    total = shares.agg(F.sum("s").alias("all"))
    every = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    # Two tables no longer than the list of features.
    share = F.coalesce(F.col("s") / total.first()["all"], F.lit(0.0))
    return every.join(shares, "feature", "left").select("feature", share.alias("importance"))
