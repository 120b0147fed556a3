"""Ordered windows that survive hot keys.

A window partitioned by an entity puts all rows of that entity in one task, and
Spark cannot split a window partition at run time.  Where a key has at most one
row per calendar day that is bounded by the calendar and plain windows are used
(``slices=None``).  Everywhere else there is one plan for every size: rows are
cut into slices of ``(key, period of the order column)``, the window runs inside
each slice, every slice is reduced to one end row (combined in the map tasks),
and the state of the end rows before a slice is joined back to it.  The largest
unit of work is one period of one key, or one key's end rows.  Nothing is counted
or collected while the plan is built, and keys may be NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SLICE = "_slice"
_REST = "_rest"
#: Periods by which rows are cut unless the caller names another one.
AUTO = "auto"
DATE_PERIOD = "quarter"
TIME_PERIOD = "hour"
NUMBER_PERIOD = 1_000_000


def slice_of(df: DataFrame, order: str, slices: str | int) -> Column:
    """The slice of each row: an ordered period of the ``order`` column.

    ``slices`` is a unit of ``date_trunc`` for dates and timestamps, a width for
    numbers, or ``AUTO``.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        unit = slices
        if slices == AUTO:
            unit = DATE_PERIOD if isinstance(kind, T.DateType) else TIME_PERIOD
        if not isinstance(unit, str):
            raise ValueError(f"{order} is cut by a period of time, not {slices!r}")
        return F.date_trunc(unit, F.col(order))
    width = NUMBER_PERIOD if slices == AUTO else slices
    if isinstance(width, str):
        raise ValueError(f"{order} is cut by a width, not {slices!r}")
    return F.floor(F.col(order) / F.lit(width))


def _dealt(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that stand for ``names`` and are never NULL.

    Equal for equal rows, NULLs included, in the order of ``names``.  A join on them is
    a plain one, so it reads rows where a window by them has left them.
    """
    found: dict[str, Column] = {}
    for i, n in enumerate(names):
        kind, value = df.schema[n].dataType, F.col(f"`{n}`")
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            zero = F.lit(0).cast(kind)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            zero = F.lit("1970-01-01").cast(kind)
        else:
            value = F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
            zero = F.lit("")
        found[f"_on{i}_known"] = value.isNotNull()
        found[f"_on{i}"] = F.coalesce(value, zero)
    return df.withColumns(found), list(found)


def running_last(
    df: DataFrame,
    *,
    key: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    strict: bool = False,
    reverse: bool = False,
    slices: str | int | None = AUTO,
) -> DataFrame:
    """Add, per output name, the last non-null value seen so far in ``order``.

    ``strict`` leaves out the current row.  ``reverse`` walks the first order
    column downwards, giving the next value instead of the previous one; further
    order columns break ties and always ascend.
    """
    key, names = list(key), list(values)
    partition, rows = key, df
    if slices is not None:
        rows, partition = _dealt(df.withColumn(SLICE, slice_of(df, order[0], slices)), [*key, SLICE])
    first = F.desc(order[0]) if reverse else F.asc(order[0])
    w = Window.partitionBy(*partition).orderBy(first, *order[1:]).rowsBetween(
        Window.unboundedPreceding, -1 if strict else 0
    )
    local = rows.select(
        "*", *[F.last(values[n], ignorenulls=True).over(w).alias(n) for n in names]
    )
    if slices is None:
        return local

    # The last value of a slice in walking order: further columns always ascend,
    # so of equal first columns the one with the largest rest is last.
    rest = order[1:]
    pick, place = (F.min_by, F.struct(order[0], *[-F.col(c) for c in rest])) if reverse else (
        F.max_by, F.struct(*order)
    )
    ends = rows.groupBy(*partition).agg(
        # NULL ordering values are ignored by max_by / min_by.
        *[pick(values[n], F.when(values[n].isNotNull(), place)).alias(n) for n in names]
    )
    by_key, by_slice = partition[:-2], partition[-2:]
    between = Window.partitionBy(*by_key).orderBy(
        *[F.desc(c) if reverse else F.asc(c) for c in by_slice]
    ).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *partition,
        *[F.last(n, ignorenulls=True).over(between).alias(f"_carry_{n}") for n in names],
    )
    joined = local.join(carry, partition, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(n, f"_carry_{n}").alias(n) for n in names])


def _packed(df: DataFrame, own: Sequence[str]) -> DataFrame:
    """``own`` columns, and all others as one value that is moved as it is."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in own]
    own = [F.col(f"`{c}`") for c in df.columns if c in own]
    # An array of one row: columns of it that a reader does not need are not left out,
    # which would make two shuffles out of one.
    return df.select(*own, F.array(F.struct(*rest, F.lit(True).alias("_there"))).alias(_REST))


def prior_rows(
    df: DataFrame,
    *,
    key: Sequence[str],
    order: str,
    payload: Sequence[str],
    depth: int = 3,
    last: Mapping[str, Column] | None = None,
    last_position: Mapping[str, Column] | None = None,
    ties: Sequence[str] = (),
    slices: str | int | None = AUTO,
) -> DataFrame:
    """State known strictly before each row of an ordered history.

    Adds ``_pos`` (1-based position), ``_prev1.._prev<depth>`` (struct of
    ``payload`` of the n-th earlier row, NULL if there is none), each ``last``
    name (last non-null value of its expression before the row) and each
    ``last_position`` name (position of the last earlier row satisfying its
    condition, 0 if none).  Rows are ordered by ``order``, then ``ties``; both
    with ``key`` must be unique, else the order of equal rows is not fixed.
    """
    key = list(key)
    last = dict(last or {})
    last_position = dict(last_position or {})
    partition, rows = key, df
    if slices is not None:
        # Evaluated on the whole row, before it is packed.
        found = {f"_v_{n}": e for n, e in (last | last_position).items()}
        rows = df.withColumns({SLICE: slice_of(df, order, slices), **found})
        rows, partition = _dealt(rows, [*key, SLICE])
        rows = _packed(rows.drop(SLICE), [order, *ties, *payload, *found, *partition])
        last, last_position = ({n: F.col(f"_v_{n}") for n in d} for d in (last, last_position))
    w = Window.partitionBy(*partition).orderBy(order, *ties)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct(*payload)
    numbered = rows.withColumn("_pos", F.row_number().over(w).cast("long"))
    local = numbered.select(
        "*",
        *[F.lag(row, n).over(w).alias(f"_prev{n}") for n in range(1, depth + 1)],
        *[F.last(e, ignorenulls=True).over(before).alias(n) for n, e in last.items()],
        *[
            F.coalesce(F.max(F.when(c, F.col("_pos"))).over(before), F.lit(0)).alias(n)
            for n, c in last_position.items()
        ],
    )
    if slices is None:
        return local

    tail = [
        F.struct((F.col("_pos") - n).alias("p"), (F.col(f"_prev{n}") if n else row).alias("row"))
        for n in range(depth - 1, -1, -1)
    ]
    end = F.struct(
        F.filter(F.array(*tail), lambda t: t["p"] > 0).alias("tail"),
        *[F.coalesce(e, F.col(n)).alias(n) for n, e in last.items()],
        *[F.when(c, F.col("_pos")).otherwise(F.col(n)).alias(n) for n, c in last_position.items()],
        # The last row as a whole, so that this side reads the very shuffle of the
        # other one: the rows are moved once.
        F.col(_REST),
    )
    ends = (
        local.groupBy(*partition)
        .agg(F.max("_pos").alias("_size"), F.max_by(end, "_pos").alias("_end"))
        .select(
            *partition,
            "_size",
            F.col("_end.tail").alias("_tail"),
            *[F.col(f"_end.{n}").alias(n) for n in last],
            *[F.when(F.col(f"_end.{n}") > 0, F.col(f"_end.{n}")).alias(n) for n in last_position],
        )
    )
    by_slice = Window.partitionBy(*partition[:-2]).orderBy(*partition[-2:])
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    carry = ends.select(
        *partition,
        "_start",
        # Each of the ``depth`` slices before has at least one row: enough.
        F.flatten(
            F.collect_list("_tail").over(by_slice.rowsBetween(-depth, -1))
        ).alias("_before"),
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last],
        *[
            F.max(F.col("_start") + F.col(n)).over(earlier).alias(f"_c_{n}")
            for n in last_position
        ],
    )
    out = local.join(carry, partition, "left")
    fill: dict[str, Column] = {"_start": F.coalesce("_start", F.lit(0))}
    for n in range(1, depth + 1):
        from_carry = F.try_element_at(
            "_before", (F.col("_pos") - F.lit(n + 1)).cast("int")
        )
        fill[f"_prev{n}"] = F.when(F.col("_pos") > n, F.col(f"_prev{n}")).otherwise(
            from_carry["row"]
        )
    for n in last:
        fill[n] = F.coalesce(n, f"_c_{n}")
    for n in last_position:
        fill[n] = F.when(F.col(n) > 0, F.col(n) + F.coalesce("_start", F.lit(0))).otherwise(
            F.coalesce(f"_c_{n}", F.lit(0))
        )
    out = out.withColumns(fill).withColumn("_pos", F.col("_pos") + F.col("_start"))
    rest = F.element_at(_REST, 1)
    return out.select(
        *[rest[c].alias(c) if c not in out.columns else F.col(f"`{c}`") for c in df.columns],
        "_pos",
        *[f"_prev{n}" for n in range(1, depth + 1)],
        *last,
        *last_position,
    )
