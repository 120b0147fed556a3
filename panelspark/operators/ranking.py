"""Ranks within groups of any size.

A window partitioned by the group puts a whole group in one task.  Here the rows are
sorted once over all tasks by (group, value, name), each keeps its place in that
order, and a rank is the distance to the first row of the group: one row per task and
one row per group are all that is gathered besides.  The sorted rows are written to
the shared folder, because a lost executor would otherwise sample other borders.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.storage import staged

#: Columns that ranking adds meanwhile.
_OWN = ("_id", "_task", "_size", "_start", "_place", "_tie", "_equal", "_first")
#: Bits of ``monotonically_increasing_id`` below the number of the task.
_ROW_BITS = 33


def _same(names: Sequence[str], others: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"`{a}`").eqNullSafe(F.col(b)) for a, b in zip(names, others, strict=True)])


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_place``, the position of each row in ``order``, from 0.

    The id is given after the sort, so it grows along the order: task number and
    row in the task.  What earlier tasks hold is one row per task.
    """
    if clash := [c for c in df.columns if c in _OWN[:5] or c.startswith("_by")]:
        raise ValueError(f"rename {clash}: ranking uses these names")
    rows = staged(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("_id", _ROW_BITS)
    sizes = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_task", F.coalesce(before, F.lit(0)).alias("_start"))
    # One row per task that sorted: the number of tasks bounds what is broadcast.
    return (
        rows.withColumn("_task", task)
        .join(F.broadcast(starts), "_task")
        .withColumn("_place", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_task", "_start", "_id")
    )


def _with_first(rows: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Add the least place of the rows equal in ``by``; nulls are equal.

    The side with the first places is unique, so a hot key may be split.
    """
    own = [f"_by{i}" for i in range(len(by))]
    first = rows.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, own, strict=True)]).agg(
        F.min("_place").alias(out)
    )
    return rows.join(first, _same(by, own)).drop(*own)


def rank_min_desc(df: DataFrame, *, group: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Competition rank by descending value within a group; NULL values rank last.

    Equal values share the rank of the first of them, whichever tasks hold them.
    NULL group keys form a group.  An empty table stays empty.
    """
    group = list(group)
    # A last, arbitrary key lets equal values be split over tasks.
    order = [*[F.col(f"`{g}`").asc() for g in group], F.desc(value), F.asc("_tie")]
    rows = _placed(df.withColumn("_tie", F.rand(0)), order).drop("_tie")
    rows = _with_first(rows, [*group, value], "_equal")
    rows = _with_first(rows, group, "_first") if group else rows.withColumn("_first", F.lit(0))
    rank = (F.col("_equal") - F.col("_first") + 1).cast("int")
    return rows.withColumn(out, rank).drop("_place", "_equal", "_first")


def sequential_rank(
    df: DataFrame, *, group: Sequence[str], value: str, name: str, out: str = "rank"
) -> DataFrame:
    """1..n by descending value, the name breaking ties; rows equal in both get
    consecutive ranks in an order that is not fixed.  NULLs as in ``rank_min_desc``."""
    group = list(group)
    rows = _placed(df, [*[F.col(f"`{g}`").asc() for g in group], F.desc(value), F.asc(name)])
    rows = _with_first(rows, group, "_first") if group else rows.withColumn("_first", F.lit(0))
    rank = (F.col("_place") - F.col("_first") + 1).cast("int")
    return rows.withColumn(out, rank).drop("_place", "_first")
