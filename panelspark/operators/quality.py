"""Fail-loud data rules, evaluated in one aggregation pass.

A ``Rule`` is a boolean column that is true where a row breaks it.  ``expect``
counts every row rule of a table in a single job; each ``Unique`` adds one
``groupBy``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import LABEL_COLUMNS, LEAKAGE_MARKERS
from ..functions.values import close, label_from_bps, to_number


class RuleViolation(ValueError):
    """Raised by ``expect`` and the schema checks."""


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column


@dataclass(frozen=True)
class Unique:
    name: str
    key: Sequence[str]


# --- row rules ---------------------------------------------------------------


def valid_date(c: str, *, fmt: str | None = None) -> Rule:
    """Text (or date) column holds a real, non-null date."""
    parsed = F.try_to_date(F.trim(F.col(c).cast("string")), *([fmt] if fmt else []))
    return Rule(f"valid_date:{c}", parsed.isNull())


def numeric(c: str) -> Rule:
    """Text is empty, missing or a number; anything else breaks the rule."""
    text = F.trim(c)
    return Rule(f"numeric:{c}", text.isNotNull() & (text != "") & to_number(F.col(c)).isNull())


def not_null(c: str) -> Rule:
    return Rule(f"not_null:{c}", F.col(c).isNull())


def not_null_finite(c: str) -> Rule:
    v = F.col(c).cast("double")
    return Rule(f"finite:{c}", v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def not_blank(c: str) -> Rule:
    return Rule(f"not_blank:{c}", F.coalesce(F.trim(c) == "", F.lit(True)))


def in_range(
    c: str, low: float | None = None, high: float | None = None, *, strict_low: bool = False
) -> Rule:
    v = F.col(c)
    broken = F.lit(False)
    if low is not None:
        broken = broken | ((v <= low) if strict_low else (v < low))
    if high is not None:
        broken = broken | (v > high)
    return Rule(f"range:{c}", broken)


def in_domain(c: str, values: Sequence) -> Rule:
    return Rule(f"domain:{c}", ~F.coalesce(F.col(c).isin(*values), F.lit(False)))


def ordered(lower: str, upper: str, *, strict: bool = False, where: Column | None = None) -> Rule:
    lo, up = F.col(lower), F.col(upper)
    broken = (lo >= up) if strict else (lo > up)
    if where is not None:
        broken = where & broken
    return Rule(f"order:{lower}{'<' if strict else '<='}{upper}", broken)


def identity(
    name: str, a: Column, b: Column, *, atol: float = 1e-10, rtol: float = 1e-5, where: Column | None = None
) -> Rule:
    """``a`` equals ``b`` within tolerance; a NULL on either side breaks it."""
    broken = ~F.coalesce(close(a, b, atol=atol, rtol=rtol), F.lit(False))
    return Rule(f"identity:{name}", broken if where is None else where & broken)


def label_consistent(
    *, bps: str = "rate_change_bps", label: str = "decision", change: str = "is_change", hold: str = "hold"
) -> list[Rule]:
    same = F.col(label) == label_from_bps(F.col(bps))
    flag = F.col(change) == (F.col(label) != hold).cast("int")
    return [
        Rule(f"label:{label}", ~F.coalesce(same, F.lit(False))),
        Rule(f"label:{change}", ~F.coalesce(flag, F.lit(False))),
    ]


def change_flag_consistent(*, label: str, change: str, hold: str = "hold") -> Rule:
    flag = F.col(change) == (F.col(label) != hold).cast("int")
    return Rule(f"label:{change}", ~F.coalesce(flag, F.lit(False)))


def not_after(ref: str, event: str) -> Rule:
    return Rule(f"chronology:{ref}<={event}", F.col(ref) > F.col(event))


def strictly_before(a: str, b: str) -> Rule:
    return Rule(f"chronology:{a}<{b}", F.col(a) >= F.col(b))


def max_age(ref: str, event: str, days: int) -> Rule:
    return Rule(f"age:{ref}", F.abs(F.datediff(event, ref)) > days)


def sum_to_one(name: str, columns: Sequence[str], *, atol: float = 1e-10) -> Rule:
    """Shares of a row sum to one."""
    total = reduce(lambda x, y: x + y, [F.col(c) for c in columns])
    return identity(f"sum:{name}", total, F.lit(1.0), atol=atol)


# --- running them ------------------------------------------------------------


def violations(df: DataFrame, rules: Sequence[Rule | Unique]) -> DataFrame:
    """``(rule, violations)`` per rule.  Lazy; row rules share one aggregation."""
    row_rules = [r for r in rules if isinstance(r, Rule)]
    parts = []
    if row_rules:
        totals = df.agg(
            *[
                F.count_if(F.coalesce(r.broken, F.lit(False))).alias(f"_r{i}")
                for i, r in enumerate(row_rules)
            ]
        )
        parts.append(
            totals.select(
                F.explode(
                    F.array(
                        *[
                            F.struct(
                                F.lit(r.name).alias("rule"), F.col(f"_r{i}").alias("violations")
                            )
                            for i, r in enumerate(row_rules)
                        ]
                    )
                ).alias("_v")
            ).select("_v.*")
        )
    for r in rules:
        if isinstance(r, Unique):
            counts = df.groupBy(*r.key).agg(F.count(F.lit(1)).alias("_n"))
            parts.append(
                counts.agg(
                    F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(
                        "violations"
                    )
                ).select(F.lit(r.name).alias("rule"), "violations")
            )
    return reduce(DataFrame.unionByName, parts)


def first_n_bad_rows(df: DataFrame, broken: Column, n: int = 5, *, order: Sequence[str] = ()) -> DataFrame:
    """At most ``n`` offending rows for an error message: the first ones in ``order``,
    else whichever are found first."""
    bad = df.where(F.coalesce(broken, F.lit(False)))
    return (bad.orderBy(*order) if order else bad).limit(n)


def quarantine(
    df: DataFrame, rules: Sequence[Rule | Unique]
) -> tuple[DataFrame, DataFrame]:
    """Split into rows that keep every rule and rows that break one or more.

    Rejected rows carry ``broken_rules``, the names of the rules they break.  A
    ``Unique`` rule rejects every row of a repeated key (NULL keys are equal to
    each other), so good and rejected rows together are always the input.

    The names leave the rule expressions through a one-element explode.  A filter
    on a plain column would be pushed down and copied into the optimizer's
    constraints with every rule inside, which grows exponentially with the
    aliases of a wide panel.
    """
    checks = [F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules if isinstance(r, Rule)]
    marked = df
    for i, r in enumerate(r for r in rules if isinstance(r, Unique)):
        flag = f"_repeated{i}"
        names = [f"_key{i}_{j}" for j in range(len(r.key))]
        repeated = (
            df.groupBy(*[F.col(c).alias(n) for c, n in zip(r.key, names, strict=True)])
            .agg(F.count(F.lit(1)).alias("_n"))
            .where("_n > 1")
            .select(*names, F.lit(True).alias(flag))
        )
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(r.key, names, strict=True)])
        marked = marked.join(repeated, same, "left").drop(*names)
        checks.append(F.when(F.col(flag), F.lit(r.name)))
    names = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    marked = marked.select(*df.columns, F.explode_outer(F.array(names)).alias("broken_rules"))
    good = marked.where(F.size("broken_rules") == 0).drop("broken_rules")
    return good, marked.where(F.size("broken_rules") > 0)


def expect(df: DataFrame, rules: Sequence[Rule | Unique], *, on_violation: str = "raise"):
    """Check ``df``: ``report`` gives the counts, ``quarantine`` a split pair.

    ``raise`` runs the check, raises ``RuleViolation`` with counts and up to five
    sample rows per broken rule, and returns ``df`` if there is none.
    """
    if on_violation == "report":
        return violations(df, rules)
    if on_violation == "quarantine":
        return quarantine(df, rules)
    if on_violation != "raise":
        raise ValueError(f"unknown on_violation {on_violation!r}")
    broken = {r.rule: r.violations for r in violations(df, rules).collect() if r.violations}
    if broken:
        samples = {}
        for r in rules:
            if r.name in broken and isinstance(r, Rule):
                samples[r.name] = [x.asDict() for x in first_n_bad_rows(df, r.broken).collect()]
            elif r.name in broken:
                bad = duplicate_keys(df, key=r.key).limit(5)
                samples[r.name] = [x.asDict() for x in bad.collect()]
        raise RuleViolation(f"rules broken: {broken}; samples: {samples}")
    return df


# --- whole-table checks ------------------------------------------------------


def schema_report(
    df: DataFrame, columns: Sequence[str], *, mode: str = "exact"
) -> dict[str, list[str]]:
    """Missing / unexpected / out-of-order columns; no data is read."""
    missing = sorted(set(columns) - set(df.columns))
    unexpected = sorted(set(df.columns) - set(columns)) if mode != "required" else []
    order = []
    if mode == "ordered" and not missing and not unexpected and df.columns != list(columns):
        order = list(df.columns)
    return {"missing": missing, "unexpected": unexpected, "order": order}


def require_schema(
    df: DataFrame, columns: Sequence[str], *, mode: str = "exact", non_empty: bool = False
) -> DataFrame:
    """Raise unless the columns fit (``exact``, ``required`` or ``ordered``)."""
    report = schema_report(df, columns, mode=mode)
    if any(report.values()):
        raise RuleViolation(f"schema mismatch: {report}")
    if non_empty and df.isEmpty():
        raise RuleViolation("table contains no rows")
    return df


def leakage_column_guard(
    df: DataFrame,
    *,
    features: Sequence[str],
    known_labels: Sequence[str] = LABEL_COLUMNS,
    markers: Sequence[str] = LEAKAGE_MARKERS,
) -> DataFrame:
    """Refuse columns that look derived from the future; no data is read."""
    suspicious = sorted(
        c for c in df.columns if c not in known_labels and any(m in c.lower() for m in markers)
    )
    if suspicious:
        raise RuleViolation(f"unrecognised future-derived columns: {suspicious}")
    leaked = sorted(set(features) & set(known_labels))
    if leaked:
        raise RuleViolation(f"features include target-derived columns: {leaked}")
    return df


def duplicate_keys(df: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.join(repeated, list(key), "left_semi")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, null_count)`` in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "null_count")


def drop_incomplete_rows(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all ``columns`` present, and the null counts as a report."""
    return df.dropna(subset=list(columns)), null_counts(df, columns)


def drop_null_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(required))


def distinct_variation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns hold at most one distinct value, NULL counting as a value.

    Decided from min, max and the null count, so nothing is shuffled by value.
    """
    n = F.count(F.lit(1))

    def flat(c: str) -> Column:
        nulls = F.count_if(F.col(c).isNull())
        return ((nulls == 0) & F.equal_null(F.min(c), F.max(c))) | (nulls == n)

    one = df.agg(*[flat(c).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "no_variation")


def classes_present(
    df: DataFrame, *, split: str, label: str, classes: Sequence[str]
) -> DataFrame:
    """Per split: how many of the required classes occur, and whether all do."""
    seen = [F.max(F.when(F.col(label) == c, 1).otherwise(0)) for c in classes]
    return df.groupBy(split).agg(
        reduce(lambda x, y: x + y, seen).cast("int").alias("classes_present"),
    ).withColumn("complete", F.col("classes_present") == len(classes))


def matrix_totals(counts: DataFrame, *, actual: str, predicted: str, n: str = "n") -> DataFrame:
    """Total and trace of a long confusion matrix."""
    return counts.agg(
        F.sum(n).alias("total"),
        F.coalesce(F.sum(F.when(F.col(actual) == F.col(predicted), F.col(n))), F.lit(0)).alias(
            "trace"
        ),
    )


def shares_sum_to_one(
    df: DataFrame, *, group: Sequence[str], share: str, atol: float = 1e-8
) -> DataFrame:
    """Groups whose shares do not add up to one."""
    totals = df.groupBy(*group).agg(F.sum(share).alias("total"))
    return totals.where(~close(F.col("total"), F.lit(1.0), atol=atol))


def set_mismatch_report(
    expected: DataFrame, actual: DataFrame, *, on: str
) -> DataFrame:
    """Members missing from or unexpected in ``actual``, both ways in one join."""
    e = expected.select(on).distinct().withColumn("_e", F.lit(1))
    a = actual.select(on).distinct().withColumn("_a", F.lit(1))
    both = e.join(a, on, "full_outer")
    return both.where(F.col("_e").isNull() | F.col("_a").isNull()).select(
        on, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("problem")
    )


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def recode_or_violation(c: str, coded: Mapping) -> Rule:
    """A text value without a code breaks the rule."""
    return in_domain(c, list(coded))
