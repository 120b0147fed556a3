"""From raw series and an event calendar to the labelled, checked event panel.

Every table is keyed by ``key`` (one or more entity columns) and dated by
``date``; events are dated by ``meeting_date`` and unique per entity and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions.values import label_by_tolerance
from ..operators import quality as q
from ..operators.asof import Pick, Source, asof_many
from ..operators.calendar import (
    densify,
    forward_fill,
    month_end_last,
    resample_month_end_last,
    splice_coverage,
    splice_inputs,
    splice_series,
    splice_wide,
)
from ..operators.windows import pct_change_complete

STATE_COLUMNS = ("target_lower", "target_upper", "policy_rate", "policy_regime")


def inflation_monthly(index: DataFrame, *, key: Sequence[str], value: str = "value") -> DataFrame:
    """Month-end index level and its complete 12-month percent change."""
    monthly = resample_month_end_last(
        index.select(*key, "date", F.col(value).alias("pce_index")),
        key=key,
        date="date",
        values=["pce_index"],
    )
    return pct_change_complete(
        monthly, key=key, order="date", value="pce_index", periods=12, out="pce_yoy"
    )


def labour_panel(
    unemployment: DataFrame, natural: DataFrame, *, key: Sequence[str], value: str = "value"
) -> DataFrame:
    """Monthly base series with a slower series carried into later months only.

    The base series sets the calendar of each key: slower values outside it are
    left out before anything is carried.
    """
    cols = ("unemployment", "natural_unemployment")
    base = unemployment.select(
        *key, "date", F.col(value).alias(cols[0]), F.lit(None).cast("double").alias(cols[1]),
        F.lit(1).alias("_base"),
    )
    slow = natural.select(
        *key, "date", F.lit(None).cast("double").alias(cols[0]), F.col(value).alias(cols[1]),
        F.lit(None).cast("int").alias("_base"),
    )
    # One row per key and month from both series; the calendar of a key runs
    # from its first to its last base row, which both are rows of this table.
    both = base.unionByName(slow).groupBy(*key, F.last_day("date").alias("date")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in cols],
        F.max("_base").alias("_base"),
    )
    return _within_base(both, key=key, cols=cols)


def _within_base(both: DataFrame, *, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*key)
    base_date = F.when(F.col("_base") == 1, F.col("date"))
    inside = (
        both.withColumn("_lo", F.min(base_date).over(whole))
        .withColumn("_hi", F.max(base_date).over(whole))
        .where(F.col("date").between(F.col("_lo"), F.col("_hi")))
        .select(*key, "date", *cols)
    )
    dense = densify(inside, key=key, date="date", unit="month_end")
    return forward_fill(dense, key=key, order="date", values=[cols[1]])


def monthly_panel(
    policy: DataFrame, inflation: DataFrame, labour: DataFrame, *, key: Sequence[str]
) -> DataFrame:
    """State, inflation and labour on one complete month-end calendar per key.

    Only the state columns are carried forward.  The three inputs are stacked
    and folded, so there is one shuffle by month and one by key.  Two values of one
    input for a key and month are refused when the result is computed.
    """
    cols = [*STATE_COLUMNS, "pce_index", "pce_yoy", "unemployment", "natural_unemployment"]
    state = month_end_last(policy, key=key, date="date", values=list(STATE_COLUMNS))
    stacked = state.unionByName(inflation, allowMissingColumns=True).unionByName(
        labour, allowMissingColumns=True
    )
    kinds = {f.name: f.dataType for f in stacked.schema.fields}

    def only(c: str):
        twice = F.raise_error(F.lit(f"{c}: more than one value for a key and month")).cast(kinds[c])
        return F.when(F.count(c) > 1, twice).otherwise(F.max(c)).alias(c)

    folded = stacked.groupBy(*key, "date").agg(*[only(c) for c in cols])
    dense = densify(folded, key=key, date="date", unit="month_end")
    return forward_fill(dense, key=key, order="date", values=list(STATE_COLUMNS))


def event_alignment(
    monthly: DataFrame, policy: DataFrame, events: DataFrame, *, key: Sequence[str]
) -> DataFrame:
    """Events with the latest macro values and the state before and after.

    Macro values match on or before the event, each series by its own latest
    available month; states match strictly before and strictly after within a
    week.  Events lacking either state are dropped.
    """
    state = {c: f"{c}_before" for c in STATE_COLUMNS}
    after = {c: f"{c}_after" for c in STATE_COLUMNS}
    have = lambda c: F.col(c).isNotNull()
    macro = Source(
        monthly,
        "date",
        [
            Pick(
                {"pce_index": "pce_index", "pce_yoy": "pce_yoy"},
                reference_col="pce_reference_date",
                where=have("pce_yoy"),
            ),
            Pick(
                {"unemployment": "unemployment"},
                reference_col="unemployment_reference_date",
                where=have("unemployment"),
            ),
            Pick(
                {"natural_unemployment": "natural_unemployment"},
                reference_col="natural_unemployment_reference_date",
                where=have("natural_unemployment"),
            ),
        ],
        allow_exact=True,
    )
    days = K.STATE_TOLERANCE_DAYS
    around = Source(
        policy,
        "date",
        [
            Pick(state, reference_col="policy_date_before", tolerance_days=days),
            Pick(after, reference_col="policy_date_after", tolerance_days=days, direction="forward"),
        ],
        allow_exact=False,
    )
    aligned = asof_many(
        events, [macro, around], key=key, left_date="meeting_date", left_unique=True
    )
    return q.drop_null_required(
        aligned,
        [f"{c}_{s}" for s in ("before", "after") for c in ("policy_date", "policy_rate", "policy_regime")],
    )


def clean_panel_rules(key: Sequence[str]) -> list:
    """Everything the event panel must satisfy before features are built."""
    rules: list = [q.Unique("unique:meeting_date", [*key, "meeting_date"])]
    refs = ("pce_reference_date", "unemployment_reference_date", "natural_unemployment_reference_date")
    for c in ("meeting_date", *refs, "policy_date_before", "policy_date_after", "is_scheduled"):
        rules.append(q.not_null(c))
    rules.append(q.not_blank("source_url"))
    levels = [f"{c}_{s}" for s in ("before", "after") for c in ("target_lower", "target_upper", "policy_rate")]
    for c in ("pce_index", "pce_yoy", "unemployment", "natural_unemployment", *levels, "rate_change_bps", "is_change"):
        rules.append(q.not_null_finite(c))
    rules.append(q.in_range("pce_index", 0, strict_low=True))
    for c in ("unemployment", "natural_unemployment", *levels):
        rules.append(q.in_range(c, 0, 100))
    for s in ("before", "after"):
        low, high, mid = (F.col(f"{c}_{s}") for c in ("target_lower", "target_upper", "policy_rate"))
        regime = F.col(f"policy_regime_{s}")
        rules += [
            q.in_domain(f"policy_regime_{s}", K.POLICY_REGIMES),
            q.ordered(f"target_lower_{s}", f"target_upper_{s}"),
            q.identity(f"midpoint_{s}", mid, (low + high) / 2.0),
            q.identity(f"point_bounds_{s}", low, high, where=regime == K.POINT_REGIME),
            q.ordered(
                f"target_lower_{s}", f"target_upper_{s}", strict=True, where=regime == K.RANGE_REGIME
            ),
        ]
    rules.append(
        q.identity(
            "rate_change_bps",
            F.col("rate_change_bps"),
            (F.col("policy_rate_after") - F.col("policy_rate_before")) * 100.0,
            atol=1e-8,
        )
    )
    rules.append(q.in_domain("decision", K.DECISION_CLASSES))
    rules += q.label_consistent()
    rules += [q.not_after(r, "meeting_date") for r in refs]
    rules += [
        q.strictly_before("policy_date_before", "meeting_date"),
        q.strictly_before("meeting_date", "policy_date_after"),
        q.max_age("policy_date_before", "meeting_date", K.STATE_TOLERANCE_DAYS),
        q.max_age("policy_date_after", "meeting_date", K.STATE_TOLERANCE_DAYS),
    ]
    return rules


def series_coverage(
    *,
    point: DataFrame,
    lower: DataFrame,
    upper: DataFrame,
    index: DataFrame,
    unemployment: DataFrame,
    natural: DataFrame,
    key: Sequence[str],
) -> DataFrame:
    """One row per key of the raw series: how they fall short of the panel's needs.

    The splice must have point values and both bounds without a gap between the
    regimes, and on every day bounds in order, in the range regime with a width;
    the index needs 13 months in a row, the labour series a common month.
    """
    rows = splice_inputs(point, lower, upper, key=key, date="date", value="value")
    low, up = F.col("target_lower"), F.col("target_upper")
    daily = splice_wide(rows, key=key).groupBy(*key).agg(
        F.count_if(low.isNull() | up.isNull()).alias("days_without_bounds"),
        F.count_if(low > up).alias("days_lower_above_upper"),
        F.count_if((F.col("policy_regime") == K.RANGE_REGIME) & (low >= up)).alias("range_days_without_width"),
    )
    to_here = Window.partitionBy(*key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    gaps = F.sum(F.col("pce_index").isNull().cast("int")).over(to_here)
    months = (
        inflation_monthly(index, key=key)
        .withColumn("_gap", gaps)
        .groupBy(*key, "_gap")
        .agg(F.count("pce_index").alias("_n"))
        .groupBy(*key)
        .agg((F.max("_n") < 13).alias("under_13_months"))
    )
    both = F.col("unemployment").isNotNull() & F.col("natural_unemployment").isNotNull()
    labour = labour_panel(unemployment, natural, key=key).groupBy(*key).agg(
        (F.count_if(both) == 0).alias("no_labour_overlap")
    )
    out = splice_coverage(rows, key=key)
    for part in (daily, months, labour):
        out = out.join(part, list(key), "left")
    counts = ("days_without_bounds", "days_lower_above_upper", "range_days_without_width")
    # A key without an index or labour row has neither months nor overlap.
    return out.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counts}
        | {c: F.coalesce(c, F.lit(True)) for c in ("under_13_months", "no_labour_overlap")}
    )


def series_coverage_rules() -> list:
    flags = (
        "no_point_values", "no_range_bounds", "point_ends_before_range", "under_13_months", "no_labour_overlap",
    )
    counts = ("days_without_bounds", "days_lower_above_upper", "range_days_without_width")
    return [q.Rule(f"coverage:{c}", F.col(c)) for c in flags] + [
        q.Rule(f"coverage:{c}", F.col(c) > 0) for c in counts
    ]


def build_clean_panel(
    *,
    point: DataFrame,
    lower: DataFrame,
    upper: DataFrame,
    index: DataFrame,
    unemployment: DataFrame,
    natural: DataFrame,
    events: DataFrame,
    key: Sequence[str],
    policy: DataFrame | None = None,
    on_violation: str = "raise",
):
    """Raw keyed series and events to the labelled event panel.

    ``policy`` is the daily splice if it is at hand as a written table; it is
    used by the monthly panel, the alignment and later the rate features, so at
    scale it should be computed once.  ``raise`` checks the coverage of the raw
    series and every rule of the panel and returns it; ``quarantine`` returns good
    and rejected events lazily (``series_coverage`` lists what is wrong with the
    series); ``none`` returns the panel unchecked.
    """
    if on_violation == "raise":
        raw = dict(point=point, lower=lower, upper=upper, index=index, unemployment=unemployment, natural=natural)
        q.expect(series_coverage(**raw, key=key), series_coverage_rules())
    if policy is None:
        policy = splice_series(point, lower, upper, key=key)
    monthly = monthly_panel(
        policy,
        inflation_monthly(index, key=key),
        labour_panel(unemployment, natural, key=key),
        key=key,
    )
    aligned = event_alignment(monthly, policy, events, key=key)
    panel = label_by_tolerance(aligned, before="policy_rate_before", after="policy_rate_after")
    panel = panel.select(*key, *K.CLEAN_COLUMNS)
    if on_violation == "none":
        return panel
    return q.expect(panel, clean_panel_rules(key), on_violation=on_violation)
