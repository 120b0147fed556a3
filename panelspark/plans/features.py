"""Feature groups of the event panel and the final model table."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions.values import close, encode_bool_text, policy_context_features, spread_features
from ..operators import quality as q
from ..operators.asof import Pick, Source, asof_many, asof_reconcile, series_source
from ..operators.calendar import resample_month_end_last
from ..operators.joins import exact_date_lookup
from ..operators.windows import diff_n, history_features, rolling_mean_full
from .macro import inflation_monthly


def _policy_sources(policy: DataFrame) -> list[Source]:
    """The policy series as it stood the asked calendar months before an event."""
    known = F.col("policy_rate").isNotNull()
    return [
        Source(policy, "date", [Pick({"policy_rate": f"_then_{m}"}, where=known)], months_ago=m)
        for m in K.RATE_CHANGE_MONTHS
    ]


def _rate_changes(found: DataFrame) -> DataFrame:
    level = F.col("policy_rate_before")
    changes = {f"rate_chg_{m}m": level - F.col(f"_then_{m}") for m in K.RATE_CHANGE_MONTHS}
    return found.withColumns({"rate_level": level, **changes}).drop(
        *[f"_then_{m}" for m in K.RATE_CHANGE_MONTHS]
    )


def rate_features(panel: DataFrame, policy: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Level in force before the event and its changes over calendar months.

    Events are unique per key and day.
    """
    found = asof_many(panel, _policy_sources(policy), key=key, left_date="meeting_date", left_unique=True)
    return _rate_changes(found)


def rate_and_market_features(
    panel: DataFrame, policy: DataFrame, market: DataFrame, *, key: Sequence[str], series_id: str = "series_id"
) -> DataFrame:
    """``rate_features`` and ``market_features``, all sources in one as-of pass."""
    sources = [*_policy_sources(policy), _market_source(market, key=key, series_id=series_id)]
    found = asof_many(panel, sources, key=key, left_date="meeting_date", left_unique=True)
    return spread_features(_rate_changes(found), level="rate_level", pairs=K.SPREAD_PAIRS)


def rate_reconciliation(panel: DataFrame, policy: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Panel states looked up again in the daily series; see ``asof_reconcile``."""
    return asof_reconcile(
        panel,
        policy,
        key=key,
        date="policy_date_before",
        value="policy_rate_before",
        series_date="date",
        series_value="policy_rate",
    )


def _month_windows(
    monthly: DataFrame, *, key: Sequence[str], value: str, stem: str, changes, means
) -> tuple[DataFrame, list[str]]:
    names = []
    for n in changes:
        out = f"{stem}_chg" if n == 1 else f"{stem}_chg{n}"
        monthly = diff_n(monthly, key=key, order="date", value=value, n=n, out=out)
        names.append(out)
    for n in means:
        out = f"{stem}_ma{n}"
        monthly = rolling_mean_full(monthly, key=key, order="date", value=value, n=n, out=out)
        names.append(out)
    return monthly, names


def inflation_features(
    panel: DataFrame, index: DataFrame, *, key: Sequence[str], value: str = "value"
) -> DataFrame:
    """Momentum and trailing means of the yearly change at the reference month.

    Adds ``inflation_reconciled``: the panel agrees with the raw history.
    """
    monthly = inflation_monthly(index, key=key, value=value)
    monthly, names = _month_windows(
        monthly,
        key=key,
        value="pce_yoy",
        stem="pce_yoy",
        changes=K.INFLATION_CHANGE_MONTHS,
        means=K.INFLATION_MEAN_MONTHS,
    )
    found = exact_date_lookup(
        panel,
        monthly,
        key=key,
        left_date="pce_reference_date",
        right_date="date",
        values={**{n: n for n in names}, "pce_index": "_raw_index", "pce_yoy": "_raw_yoy"},
    )
    agrees = close(F.col("pce_index"), F.col("_raw_index")) & close(F.col("pce_yoy"), F.col("_raw_yoy"))
    return found.withColumn("inflation_reconciled", F.coalesce(agrees, F.lit(False))).drop(
        "_raw_index", "_raw_yoy"
    )


def labour_features(
    panel: DataFrame, unemployment: DataFrame, *, key: Sequence[str], value: str = "value"
) -> DataFrame:
    """Changes and trailing means of the base labour series at the reference month."""
    monthly = resample_month_end_last(
        unemployment.select(*key, "date", F.col(value).alias("_u")), key=key, date="date", values=["_u"]
    )
    monthly, names = _month_windows(
        monthly,
        key=key,
        value="_u",
        stem="unemp",
        changes=K.LABOUR_CHANGE_MONTHS,
        means=K.LABOUR_MEAN_MONTHS,
    )
    found = exact_date_lookup(
        panel,
        monthly,
        key=key,
        left_date="unemployment_reference_date",
        right_date="date",
        values={**{n: n for n in names}, "_u": "_raw_u"},
    )
    agrees = close(F.col("unemployment"), F.col("_raw_u"))
    return found.withColumn("labour_reconciled", F.coalesce(agrees, F.lit(False))).drop("_raw_u")


def _market_source(market: DataFrame, *, key: Sequence[str], series_id: str) -> Source:
    return series_source(market, key=key, series_ids=K.MARKET_COLUMNS, series_id=series_id, allow_exact=False)


def market_features(
    panel: DataFrame, market: DataFrame, *, key: Sequence[str], series_id: str = "series_id"
) -> DataFrame:
    """Latest market values strictly before the event, their dates, and spreads.

    ``market`` is the long series table.  Missing and stale values are kept with
    their reference dates for ``market_rules``.
    """
    source = _market_source(market, key=key, series_id=series_id)
    aligned = asof_many(panel, [source], key=key, left_date="meeting_date", left_unique=True)
    return spread_features(aligned, level="rate_level", pairs=K.SPREAD_PAIRS)


def market_rules(*, max_age_days: int = K.MARKET_MAX_AGE_DAYS) -> list:
    """Every event needs every market series, strictly earlier and not stale."""
    rules = []
    for c in K.MARKET_COLUMNS:
        ref = f"{c}_reference_date"
        rules += [
            q.Rule(f"missing_match:{c}", F.col(ref).isNull()),
            q.strictly_before(ref, "meeting_date"),
            q.Rule(f"stale_match:{c}", F.datediff("meeting_date", ref) > max_age_days),
        ]
    return rules


def reconciliation_rules() -> list:
    return [
        q.Rule("reconcile:inflation", ~F.col("inflation_reconciled")),
        q.Rule("reconcile:labour", ~F.col("labour_reconciled")),
    ]


def project_panel(panel: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Configured columns in configured order."""
    return panel.select(*key, "meeting_date", *K.FEATURE_COLUMNS, *K.TARGET_COLUMNS)


def select_model_columns(panel: DataFrame, *, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Model table without incomplete rows, and the null counts as a report."""
    q.leakage_column_guard(
        panel.drop(*[c for c in panel.columns if c.endswith("_reference_date")]),
        features=K.FEATURE_COLUMNS,
    )
    return q.drop_incomplete_rows(project_panel(panel, key=key), K.FEATURE_COLUMNS)


def feature_panel_rules(key: Sequence[str]) -> list:
    rules: list = [q.Unique("unique:meeting_date", [*key, "meeting_date"]), q.not_null("meeting_date")]
    rules += [q.not_null_finite(c) for c in K.FEATURE_COLUMNS]
    rules += [q.in_range(c, 0, 100) for c in ("rate_level", "unemployment", "natural_unemployment")]
    rules += [q.in_range(c, -20, 30) for c in (*K.MARKET_COLUMNS, *(s for _, s in K.SPREAD_PAIRS))]
    rules.append(q.in_range("abs_inflation_gap", 0))
    rules.append(q.in_domain("decision", K.DECISION_CLASSES))
    rules.append(q.in_domain("is_change", [0, 1]))
    rules.append(q.change_flag_consistent(label="decision", change="is_change"))
    rules.append(q.in_domain("is_scheduled", [0, 1]))
    rules += [q.in_range(c, 0) for c in ("same_direction_streak", "days_since_prior_change")]
    gap = F.abs(F.col("pce_yoy") - K.INFLATION_TARGET_PERCENT)
    rules.append(q.identity("abs_inflation_gap", F.col("abs_inflation_gap"), gap, rtol=1e-10))
    for v, s in K.SPREAD_PAIRS:
        rules.append(q.identity(s, F.col(s), F.col(v) - F.col("rate_level"), rtol=1e-10))
    return rules


def all_features(
    panel: DataFrame,
    *,
    policy: DataFrame,
    index: DataFrame,
    unemployment: DataFrame,
    market: DataFrame,
    key: Sequence[str],
) -> DataFrame:
    """Every feature group on the clean panel, before selection."""
    out = rate_and_market_features(panel, policy, market, key=key)
    out = inflation_features(out, index, key=key)
    out = labour_features(out, unemployment, key=key)
    out = policy_context_features(out)
    # Events are unique per entity and day, so a key is bounded by the calendar.
    return history_features(out, key=key, date="meeting_date", slices=None)


def build_feature_panel(
    panel: DataFrame,
    *,
    policy: DataFrame,
    index: DataFrame,
    unemployment: DataFrame,
    market: DataFrame,
    key: Sequence[str],
    on_violation: str = "raise",
):
    """Clean panel to the model table in its exact column order.

    ``raise`` stops on a missing or stale market value, a reconciliation failure
    or any rule of the final table; events that lack a feature are left out with a
    warning that counts what is missing.  ``quarantine`` returns ``(model table,
    rejected events)``: every event that breaks a source rule or a rule of the
    final table, incomplete ones included, is in the second with the names of the
    rules, so both together are the input.  ``report`` returns the rule counts.
    """
    full = all_features(
        panel, policy=policy, index=index, unemployment=unemployment, market=market, key=key
    )
    source_rules = [*market_rules(), *reconciliation_rules()]
    every_rule = [*source_rules, *feature_panel_rules(key)]
    if on_violation == "report":
        return q.violations(full, every_rule)
    if on_violation == "quarantine":
        good, bad = q.quarantine(full, every_rule)
        return project_panel(good, key=key), bad
    q.expect(full, source_rules)
    model, report = select_model_columns(full, key=key)
    lacking = {r.column_name: r.null_count for r in report.where("null_count > 0").collect()}
    if lacking:
        warnings.warn(f"incomplete events left out; missing values: {lacking}", stacklevel=2)
    q.require_schema(
        model, [*key, "meeting_date", *K.FEATURE_COLUMNS, *K.TARGET_COLUMNS], mode="ordered"
    )
    return q.expect(model, feature_panel_rules(key))


def scheduled_flag(df: DataFrame, *, column: str = "is_scheduled") -> DataFrame:
    return df.withColumn(column, encode_bool_text(F.col(column)))
