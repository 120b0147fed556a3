"""How filters act together: failing ids as relations, joined for every prefix.

Each filter has one stored table of the rows that fail it.  The rows that fail any
filter are taken through the tables one after the other: a left-semi join gives the
rows that a filter fails too, a left-anti join those that pass it.  After the last
table every row is in the cell of its set of failed filters, and a prefix of filters
removes the cells that meet it.  Documents are read once; texts are compared by
digest; what is joined are row numbers.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty

#: The filters that one text decides.
DEFAULT = ["A", "B", "C", "D"]


def text_filters(text: Column) -> list[Column]:
    """Failure conditions; words are runs without ASCII spaces."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    return [
        n_words < 50,
        100 * n_distinct < 65 * n_words,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]


def facts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None, text_col: str) -> DataFrame:
    """One stored row per document: ``row, id, part, digest, fails, good, toxic``."""
    text = text_or_empty(text_col)
    read = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.array(*[F.coalesce(c, F.lit(False)) for c in (filters or {}).values()] or text_filters(text)).alias("fails"),
    )
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"),
    )
    # Row numbers are fixed by writing them, before any join.
    numbered = stage(read.withColumn("row", F.monotonically_increasing_id()), "audit-read")
    marked = numbered.join(marks, F.col("id") == F.col("labelled"), "left").drop("labelled")
    return stage(marked.fillna(0, ["good", "toxic"]), "audit-facts")


def repeats(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller id has; a null id is larger than every other."""
    first = (
        rows.groupBy("digest")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and least is not null")
        .select("digest", "least")
    )
    # Written, so that a text with very many copies can be split by the join.
    first = stage(first, "audit-first")
    later = F.col("id").isNull() | (F.col("id") > F.col("least"))
    return rows.join(first, "digest").where(later).drop("least")


def cells(failing: dict[str, DataFrame]) -> DataFrame:
    """The rows that any of the tables holds, with the names of those that do (``fails``)."""
    own, earlier = [], []
    for table in failing.values():
        # Every row once: from the first table that holds it.
        fresh = reduce(lambda left, t: left.join(t, "row", "left_anti"), earlier, table)
        own.append(fresh.withColumn("fails", F.array().cast("array<string>")))
        earlier.append(table.select("row"))
    at = stage(reduce(DataFrame.unionByName, own), "audit-any")
    for name, table in failing.items():
        ids = table.select("row")
        removed = at.join(ids, "row", "left_semi").withColumn("fails", F.array_append("fails", F.lit(name)))
        at = stage(removed.unionByName(at.join(ids, "row", "left_anti")), "audit-cells")
    return at


def report(totals: DataFrame, failed: DataFrame, names: list[str]) -> DataFrame:
    """Every order and step of each part of ``totals`` (``part, total``) from the sets of
    failed filters: a part has at most 2^n - 1 of them, whatever it holds."""
    counted = failed.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    cell = F.struct("fails", "n", "good", "toxic")
    by_part = counted.groupBy(F.col("part").alias("p")).agg(F.collect_list(cell).alias("cells"))
    orders = F.lit([list(order) for order in permutations(names)])
    steps = (
        totals.join(by_part, F.col("part") == F.col("p"), "left")
        .select("part", "total", "cells", F.explode(orders).alias("order"))
        .select("part", "total", "cells", "order", F.posexplode("order").alias("place", "f"))
        .withColumn("earlier", F.slice("order", F.lit(1), F.col("place")))
    )

    def summed(value: str, *conditions, times=None) -> Column:
        met = F.filter("cells", lambda c: reduce(Column.__and__, [f(c) for f in conditions]))
        weigh = times or (lambda c: F.lit(1))
        total = F.aggregate(met, F.lit(0).cast("long"), lambda s, c: s + c[value] * weigh(c))
        return F.coalesce(total, F.lit(0).cast("long"))

    fails = lambda c: F.array_contains(c["fails"], F.col("f"))
    gone = lambda c: F.arrays_overlap(c["fails"], F.col("earlier"))
    there = lambda c: ~gone(c)
    # Of all orders, the filter is the first of a row's k failed ones in one of k.
    share = lambda c: F.floor(F.lit(factorial(len(names))) / F.size(c["fails"]))
    return steps.select(
        "part",
        F.array_join("order", "").alias("filter_order"),
        (F.col("place") + 1).alias("step"),
        (F.col("total") - summed("n", lambda c: gone(c) | fails(c))).alias("kept"),
        summed("n", fails, there).alias("removed"),
        summed("n", fails, gone).alias("redundant"),
        summed("n", fails, lambda c: F.size(c["fails"]) == 1).alias("unique_fails"),
        summed("good", fails, there).alias("good_lost"),
        summed("toxic", fails, there).alias("toxic_lost"),
        summed("n", fails, times=share).alias("shapley"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column] | None = None,
    text_col: str = "text",
    repeat_filter: str | None = "E",
) -> DataFrame:
    """One row per part (``source``), order of all filters and step of that order.

    ``part, filter_order, step`` and, within the part: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (fail its filter, removed earlier),
    ``unique_fails`` (fail its filter only), ``good_lost`` and ``toxic_lost`` (removed
    by it, labelled so) and ``shapley`` (removed by its filter, summed over all
    orders).  Zeros are included.

    ``filters`` are failure conditions over the columns of ``docs``; null is no
    failure.  The default ones read whole texts of any length, null as empty;
    ``repeat_filter`` fails rows whose text a smaller id has anywhere.  A null source
    is part ''.  Repeated rows count each; equal ids are not smaller than each other,
    a null id is larger than all and has no label.  Several labels of an id hold
    together if any does; null labels do not hold.  Extra columns are not read; an
    empty table gives no rows.  All orders are reported, so more than 6 filters are
    refused with ValueError.
    """
    names = [*(filters or DEFAULT), *([repeat_filter] if repeat_filter else [])]
    if not 0 < len(names) <= 6:
        raise ValueError("every order is reported: 1 to 6 filters")
    rows = facts(docs, labels, filters, text_col)
    keep = ["row", "part", "good", "toxic"]
    failing = {f: rows.where(f"fails[{k}]") for k, f in enumerate(filters or DEFAULT)}
    if repeat_filter:
        failing[repeat_filter] = repeats(rows)
    failing = {f: stage(t.select(*keep), "failing-ids") for f, t in failing.items()}
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    return report(totals, cells(failing), names)
