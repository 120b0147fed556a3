"""Scalar helpers: tolerance checks, labels, recodes and derived columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .constants import (
    DECISION_CLASSES,
    DIRECTION,
    INFLATION_TARGET_PERCENT,
    LABOUR_WEIGHT,
    RATE_CHANGE_TOLERANCE_BPS,
    SPREAD_PAIRS,
)


def close(a: Column, b: Column, *, atol: float = 1e-10, rtol: float = 1e-5) -> Column:
    """True where ``a`` agrees with ``b`` within ``atol + rtol * |b|``."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def to_number(c: Column) -> Column:
    """Text to DOUBLE; anything that is not a number, ``nan`` included, is NULL."""
    return nan_to_null(F.trim(c).try_cast("double"))


def label_from_bps(
    bps: Column,
    *,
    tol: float = RATE_CHANGE_TOLERANCE_BPS,
    labels: Sequence[str] = DECISION_CLASSES,
) -> Column:
    cut, hold, hike = labels
    return F.when(bps > tol, hike).when(bps < -tol, cut).otherwise(hold)


def label_by_tolerance(
    df: DataFrame,
    *,
    before: str,
    after: str,
    scale: float = 100.0,
    tol: float = RATE_CHANGE_TOLERANCE_BPS,
    labels: Sequence[str] = DECISION_CLASSES,
) -> DataFrame:
    """Add ``rate_change_bps``, ``decision`` and ``is_change``."""
    bps = (F.col(after) - F.col(before)) * scale
    decision = label_from_bps(F.col("rate_change_bps"), tol=tol, labels=labels)
    return (
        df.withColumn("rate_change_bps", bps)
        .withColumn("decision", decision)
        .withColumn("is_change", (F.col("decision") != labels[1]).cast("int"))
    )


def encode_direction(label: Column, codes: Mapping[str, int] = DIRECTION) -> Column:
    """Label to signed int; an unknown label is NULL."""
    out = F.lit(None).cast("int")
    for name, code in codes.items():
        out = F.when(label == name, F.lit(code)).otherwise(out)
    return out


def encode_bool_text(c: Column) -> Column:
    """``true/false/1/0`` in any case, or a boolean, to 1/0; else NULL."""
    text = F.lower(c.cast("string"))
    return F.when(text.isin("true", "1"), 1).when(text.isin("false", "0"), 0)


def spread_features(
    df: DataFrame, *, level: str, pairs: Iterable[tuple[str, str]] = SPREAD_PAIRS
) -> DataFrame:
    """Add ``out = value - level`` for each ``(value, out)`` pair."""
    return df.withColumns({out: F.col(v) - F.col(level) for v, out in pairs})


def policy_context_features(
    df: DataFrame,
    *,
    rate: str = "rate_level",
    inflation: str = "pce_yoy",
    inflation_mean: str = "pce_yoy_ma3",
    unemployment: str = "unemployment",
    natural: str = "natural_unemployment",
    target: float = INFLATION_TARGET_PERCENT,
    labour_weight: float = LABOUR_WEIGHT,
) -> DataFrame:
    gap = F.col(inflation) - target
    labour = F.col(natural) - F.col(unemployment)
    return df.withColumns(
        {
            "real_rate_proxy": F.col(rate) - F.col(inflation),
            "inflation_gap": gap,
            "labour_gap": labour,
            "hawk_dove_score": gap + F.lit(labour_weight) * labour,
            "abs_inflation_gap": F.abs(gap),
            "policy_tightness": F.col(rate) - F.col(inflation_mean),
        }
    )
