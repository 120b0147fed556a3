"""Classification metrics, rankings, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import CV_SPLITS, RANKING_LIMIT, TEST_FRACTION


def _label_frame(df: DataFrame, labels: Sequence) -> DataFrame:
    rows = [(i, v) for i, v in enumerate(labels)]
    kind = "string" if isinstance(labels[0], str) else "int"
    return df.sparkSession.createDataFrame(rows, f"position int, label {kind}")


def class_counts_zero_filled(
    df: DataFrame, *, label: str, labels: Sequence, out: str = "n"
) -> DataFrame:
    """Count per class of a fixed list, 0 where absent.

    One row of conditional counts, unfolded: no shuffle beyond the partial sums.
    """
    one = df.agg(*[F.count_if(F.col(label) == v).alias(f"_c{i}") for i, v in enumerate(labels)])
    cells = [
        F.struct(F.lit(v).alias(label), F.col(f"_c{i}").alias(out)) for i, v in enumerate(labels)
    ]
    return one.select(F.explode(F.array(*cells)).alias("_x")).select("_x.*")


def confusion_cells(
    df: DataFrame, *, actual: str, predicted: str, labels: Sequence, total: str | None = None
) -> DataFrame:
    """Long matrix ``(actual, predicted, n)``, every cell of ``labels`` present.

    Rows with a NULL or unlisted class are in no cell; ``total`` names a column
    with the number of all rows, so that they can be accounted for.
    """
    pairs = [(a, p) for a in labels for p in labels]
    one = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[
            F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"_c{i}")
            for i, (a, p) in enumerate(pairs)
        ],
    )
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_c{i}").alias("n"))
        for i, (a, p) in enumerate(pairs)
    ]
    extra = [F.col("_total").alias(total)] if total else []
    return one.select(F.explode(F.array(*cells)).alias("_x"), *extra).select("_x.*", *([total] if total else []))


def confusion_matrix(
    df: DataFrame, *, actual: str, predicted: str, labels: Sequence
) -> DataFrame:
    """Wide matrix: one row per actual label, one ``predicted_<label>`` column each."""
    cells = confusion_cells(df, actual=actual, predicted=predicted, labels=labels)
    return cells.groupBy("actual").agg(
        *[
            F.sum(F.when(F.col("predicted") == p, F.col("n"))).alias(f"predicted_{p}")
            for p in labels
        ]
    )


def per_class_prf(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label of a long matrix; 0/0 is 0."""
    n = F.col("n")
    total = [c for c in cells.columns if c == "total"]
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("label"),
                    n.alias("support"),
                    F.lit(0).cast("long").alias("called"),
                    F.when(F.col("actual") == F.col("predicted"), n).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("long").alias("support"),
                    n.alias("called"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        ).alias("_s"),
        *total,
    ).select("_s.*", *total)
    per = sides.groupBy("label").agg(
        F.sum("support").alias("support"),
        F.sum("called").alias("called"),
        F.sum("hits").alias("hits"),
        *[F.max(c).alias(c) for c in total],
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return per.select(
        "label",
        ratio(F.col("hits"), F.col("called")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(F.col("hits") * 2.0, F.col("called") + F.col("support")).alias("f1"),
        "support",
        "called",
        "hits",
        *total,
    )


def classification_report(
    df: DataFrame,
    *,
    actual: str,
    predicted: str,
    labels: Sequence,
    macro: str = "present",
) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro F1 and the row count.

    ``n`` and ``accuracy`` count every row: one with a NULL or unlisted class on
    either side is wrong.  ``unlisted`` is the number of such rows.
    ``macro="present"`` averages F1 over labels that occur on either side,
    ``"fixed"`` over the whole label list with absent labels counting 0.
    """
    if macro not in ("present", "fixed"):
        raise ValueError(f"unknown macro {macro!r}")
    cells = confusion_cells(df, actual=actual, predicted=predicted, labels=labels, total="total")
    per = per_class_prf(cells)
    occurs = (F.col("support") + F.col("called")) > 0
    f1 = F.when(occurs, F.col("f1")) if macro == "present" else F.col("f1")
    return per.agg(
        F.max("total").alias("n"),
        F.try_divide(F.sum("hits"), F.max("total")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"),
        (F.max("total") - F.sum("support")).alias("unlisted"),
    )


def predict_correct_flag(
    df: DataFrame, *, actual: str, predicted: str, out: str = "correct"
) -> DataFrame:
    """A NULL on either side is not correct."""
    return df.withColumn(out, F.coalesce(F.col(actual) == F.col(predicted), F.lit(False)))


def accuracy(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    """Share of correct rows among all rows; a NULL on either side is wrong."""
    hit = F.coalesce((F.col(actual) == F.col(predicted)).cast("int"), F.lit(0))
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def class_recall_table(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    hit = F.coalesce(F.col(actual) == F.col(predicted), F.lit(False))
    return df.groupBy(F.col(actual).alias("label")).agg(
        F.count(F.lit(1)).alias("actual_rows"),
        F.count_if(hit).alias("correct"),
        F.avg(hit.cast("int")).alias("recall"),
    )


def seed_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum per metric."""
    long = df.select(*metrics).unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def delta_vs_baseline_row(
    df: DataFrame, *, row: Column, metrics: Sequence[str], suffix: str = "_delta"
) -> DataFrame:
    """Each row minus the one row selected by ``row``.

    The baseline is read as scalars (one row), so the table itself is not
    shuffled.
    """
    found = df.where(row).select(*metrics).take(2)
    if len(found) != 1:
        raise ValueError(f"expected exactly one baseline row, found {len(found)}")
    return df.withColumns({f"{m}{suffix}": F.col(m) - F.lit(found[0][m]) for m in metrics})


# --- ranking -----------------------------------------------------------------


def _top(df: DataFrame, order: list[Column], k: int, tag: str, name: str, value: str) -> DataFrame:
    # TakeOrderedAndProject keeps k rows per task; the rank is over k rows.
    best = df.orderBy(*order).limit(k).withColumn("influence_group", F.lit(tag))
    w = Window.partitionBy("influence_group").orderBy(*order)
    return best.select(
        "influence_group",
        F.row_number().over(w).alias("rank"),
        F.col(name).alias("feature"),
        F.col(value).alias("importance"),
    )


def topk_most_least(
    df: DataFrame, *, value: str, name: str, k: int = RANKING_LIMIT, positive_only: bool = True
) -> DataFrame:
    """The ``k`` largest (positive only) and ``k`` smallest, names breaking ties."""
    top = df.where(F.col(value) > 0) if positive_only else df
    most = _top(top, [F.desc(value), F.asc(name)], k, "most_influential", name, value)
    least = _top(df, [F.asc(value), F.asc(name)], k, "least_influential", name, value)
    return most.unionByName(least)


def factor_rankings_nested(rankings: DataFrame) -> DataFrame:
    """Rankings as one list per group, in rank order (at most ``k`` entries each)."""
    entry = F.struct("rank", "feature", "importance")
    return rankings.groupBy("influence_group").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )


def topk_chart_rows(df: DataFrame, *, value: str, name: str, k: int) -> DataFrame:
    """Top ``k``, ascending for plotting, with the leader flagged."""
    order = [F.desc(value), F.asc(name)]
    best = df.orderBy(*order).limit(k).withColumn("_g", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    return (
        best.select(name, value, rank.alias("rank"))
        .withColumn("is_leader", F.col("rank") == 1)
        .orderBy(F.asc(value), F.desc(name))
    )


# --- chronological split and folds -------------------------------------------


def _all_days():
    """The whole table of calendar days; see ``_date_counts``."""
    return Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _date_counts(df: DataFrame, *, date: str, label: str | None, classes: Sequence) -> DataFrame:
    """Rows per calendar day with running totals.

    The window has no partition key, but its input is one row per calendar day
    (a few ten thousand at most), aggregated map-side before it moves.  A row
    without a date belongs to no part of a split, so it is refused.
    """
    dated = F.to_date(date)
    no_date = F.raise_error(F.lit(f"a row has no {date}")).cast("date")
    day = F.when(dated.isNull(), no_date).otherwise(dated).alias("day")
    firsts = [
        F.count_if(F.col(label) == c).alias(f"_c{i}") for i, c in enumerate(classes)
    ] if label else []
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("rows"), *firsts)
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(
        "day",
        "rows",
        F.sum("rows").over(w).alias("upto"),
        *[F.sum(f"_c{i}").over(w).alias(f"_seen{i}") for i in range(len(firsts))],
    )


@dataclass(frozen=True)
class Split:
    cutoff: dt.date
    train: DataFrame
    test: DataFrame


def chronological_split(
    df: DataFrame, *, date: str, test_fraction: float = TEST_FRACTION
) -> Split:
    """Newest ``ceil(n * test_fraction)`` rows as holdout, cut at a calendar day.

    Days stay whole, so the newest training day is before the oldest holdout
    day.  With unique days the sizes are exact; otherwise the holdout is the
    smallest set of whole days that reaches the size.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must be between zero and one")
    # One job: one row per calendar day, folded to the three scalars needed.
    days = _date_counts(df, date=date, label=None, classes=())
    n = F.max("upto").over(_all_days())
    keep = n - F.ceil(n * test_fraction)
    found = (
        days.withColumn("_fits", F.col("upto") - F.col("rows") <= keep)
        .agg(F.max(F.when(F.col("_fits"), F.col("day"))).alias("cut"), F.min("day").alias("oldest"))
        .first()
    )
    cut = found.cut
    if cut is None:
        raise ValueError("nothing to split")
    if cut == found.oldest:
        raise ValueError("chronological split is invalid: no whole day is left for training")
    at = F.lit(cut).cast(df.schema[date].dataType)
    return Split(cut, df.where(F.col(date) < at), df.where(F.col(date) >= at))


def class_complete_prefix(
    df: DataFrame, *, date: str, label: str, classes: Sequence
) -> DataFrame:
    """Length of the first prefix of whole days that contains every class."""
    days = _date_counts(df, date=date, label=label, classes=classes)
    done = days
    for i in range(len(classes)):
        done = done.where(F.col(f"_seen{i}") > 0)
    return done.agg(F.min("upto").alias("prefix_rows"), F.min("day").alias("prefix_day"))


def forward_cv_folds(
    df: DataFrame, *, date: str, label: str, classes: Sequence, k: int = CV_SPLITS
) -> list[dict]:
    """Expanding forward folds as date ranges, oldest first.

    Each fold has ``fold``, ``start`` and ``end``: train on days before
    ``start``, validate on days from ``start`` up to but excluding ``end``
    (``None`` for the last).  Sizes follow the row counts; days stay whole.
    """
    # One job: the fold starts follow from the row totals of each calendar day.
    days = _date_counts(df, date=date, label=label, classes=classes)
    seen_all = F.lit(True)
    for i in range(len(classes)):
        seen_all = seen_all & (F.col(f"_seen{i}") > 0)
    sized = days.select(
        "day",
        (F.col("upto") - F.col("rows")).alias("before"),
        F.max("upto").over(_all_days()).alias("n"),
        F.min(F.when(seen_all, F.col("upto"))).over(_all_days()).alias("complete"),
    )
    largest = F.floor((F.col("n") - F.col("complete")) / k)
    sized = sized.withColumn("largest", largest).withColumn(
        "size", F.least(F.floor(F.col("n") / (k + 1)), F.col("largest"))
    )
    # First day whose rows all lie at or after each start position.
    start = lambda i: F.min(
        F.when(F.col("before") >= F.col("n") - (k - i) * F.col("size"), F.col("day"))
    )
    row = sized.agg(
        F.max("complete").alias("complete"),
        F.max("largest").alias("largest"),
        *[start(i).alias(f"s{i}") for i in range(k)],
    ).first()
    if row.complete is None:
        raise ValueError("no chronological prefix contains every class")
    if row.largest < 1:
        raise ValueError("not enough rows for class-complete forward folds")
    starts = [row[f"s{i}"] for i in range(k)]
    if None in starts or len(set(starts)) < k:
        raise ValueError("too few distinct days for the requested folds")
    return [
        {"fold": i + 1, "start": s, "end": starts[i + 1] if i + 1 < k else None}
        for i, s in enumerate(starts)
    ]


def fold_parts(df: DataFrame, fold: dict, *, date: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold, as plain date filters."""
    kind = df.schema[date].dataType
    start = F.lit(fold["start"]).cast(kind)
    held = F.col(date) >= start
    if fold["end"] is not None:
        held = held & (F.col(date) < F.lit(fold["end"]).cast(kind))
    return df.where(F.col(date) < start), df.where(held)


def fold_roles(df: DataFrame, folds: Sequence[dict], *, date: str) -> DataFrame:
    """``df`` once per fold it takes part in, with ``fold`` and ``role``."""
    kind = df.schema[date].dataType
    roles = []
    for f in folds:
        start = F.lit(f["start"]).cast(kind)
        role = F.when(F.col(date) < start, "train")
        if f["end"] is None:
            role = role.otherwise("validate")
        else:
            role = role.when(F.col(date) < F.lit(f["end"]).cast(kind), "validate")
        roles.append(F.struct(F.lit(f["fold"]).alias("fold"), role.alias("role")))
    return (
        df.withColumn("_f", F.explode(F.array(*roles)))
        .where(F.col("_f.role").isNotNull())
        .select("*", "_f.fold", "_f.role")
        .drop("_f")
    )


def partition_date_ranges(df: DataFrame, *, split: Sequence[str], date: str) -> DataFrame:
    return df.groupBy(*split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )
