"""The driver tables as keyed series, events, histories and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators.windows import history_features
from ..sources.storage import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


def _shipped(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(table(spark, sf_dir, "supplier"), lines.l_suppkey == F.col("s_suppkey"))


def series(spark, sf_dir) -> DataFrame:
    """Daily value per nation, unique on (k, d)."""
    return (
        _shipped(spark, sf_dir)
        .groupBy(F.col("s_nationkey").alias("k"), F.col("l_shipdate").cast("date").alias("d"))
        .agg(F.sum(_money("l_extendedprice")).cast("double").alias("v"))
    )


def sparse_series(spark, sf_dir) -> DataFrame:
    """The daily series with small values missing."""
    return series(spark, sf_dir).withColumn("v", F.when(F.col("v") > 20000, F.col("v")))


def order_events(spark, sf_dir) -> DataFrame:
    """Orders by nation; several per nation and day."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("event_id"),
        F.col("c_nationkey").alias("k"),
        F.col("o_orderdate").cast("date").alias("d"),
        "o_totalprice",
    )


def customer_history(spark, sf_dir) -> DataFrame:
    """One event per customer and day, the largest order key standing."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
        .agg(F.max_by("o_totalprice", "o_orderkey").alias("v"))
    )


def decisions(spark, sf_dir) -> DataFrame:
    """Labelled events per user, unique on (k, ts)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("k"),
        "ts",
        "value",
        F.when(kind == "purchase", "hike").when(kind == "error", "cut").otherwise("hold").alias("decision"),
        F.when(kind.isin("purchase", "error"), 1).otherwise(0).alias("is_change"),
        F.when(kind == "purchase", 1).when(kind == "error", -1).otherwise(0).alias("dir"),
    )


def class_pairs(spark, sf_dir) -> DataFrame:
    """Actual and predicted class per labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").alias("actual"),
        F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("predicted"),
    )


HISTORY_FEATURES = (
    "prior_decision",
    "prior_is_change",
    "prior2_is_change",
    "prior3_change_count",
    "prior3_direction",
    "prior_rate_change_bps",
    "same_direction_streak",
    "days_since_prior_meeting",
    "days_since_prior_change",
)


def decision_features(spark, sf_dir) -> DataFrame:
    """History features of the decisions, with label and time."""
    return history_features(
        decisions(spark, sf_dir),
        key=["k"],
        date="ts",
        size="value",
        scheduled=None,
    )


def measures(spark, sf_dir) -> DataFrame:
    """Per nation and day: the measures behind the composite pipelines."""
    scaled = lambda f, c: (f(F.col(c).cast("decimal(9,2)")) * 100).cast("double")
    return (
        _shipped(spark, sf_dir)
        .groupBy(F.col("s_nationkey").alias("k"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            (F.min("l_quantity") / 4).alias("qlo"),
            (F.max("l_quantity") / 4).alias("qhi"),
            F.sum(_money("l_extendedprice")).cast("double").alias("price"),
            scaled(F.max, "l_tax").alias("tax_hi"),
            scaled(F.min, "l_tax").alias("tax_lo"),
            scaled(F.max, "l_discount").alias("disc_hi"),
            scaled(F.min, "l_discount").alias("disc_lo"),
        )
    )


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Later stages read it several times, each pruned to its own columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def daily_events(spark, sf_dir) -> DataFrame:
    """One event per nation and day."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(F.col("c_nationkey").alias("k"), F.col("o_orderdate").cast("date").alias("meeting_date"))
        .agg(
            F.max("o_orderkey").alias("event_id"),
            (F.max_by("o_orderpriority", "o_orderkey") != "1-URGENT").alias("is_scheduled"),
        )
        .withColumn(
            "source_url",
            F.concat(F.lit("https://example.org/orders/"), F.col("event_id").cast("string")),
        )
    )


def macro_inputs(meas: DataFrame) -> dict[str, DataFrame]:
    """Point, bounds, index, labour and market series out of the measures."""
    one = lambda df, c: df.select("k", "date", F.col(c).alias("value"))
    ranged = meas.where((F.col("date") >= F.lit("1998-01-01").cast("date")) & (F.col("qlo") < F.col("qhi")))
    quarter = meas.where(F.month("date").isin(1, 4, 7, 10))
    formula = {
        "treasury_3m_pct": F.col("disc_hi"),
        "treasury_6m_pct": F.col("disc_lo"),
        "treasury_1y_pct": F.col("tax_hi"),
        "treasury_2y_pct": F.col("tax_lo"),
        "treasury_5y_pct": (F.col("disc_hi") + F.col("tax_hi")) / 2,
        "treasury_10y_pct": (F.col("disc_lo") + F.col("tax_lo")) / 2,
        "curve_10y_minus_2y_pct": F.col("disc_hi") - F.col("tax_lo"),
        "curve_10y_minus_3m_pct": F.col("disc_lo") - F.col("tax_hi"),
    }
    cells = [F.struct(F.lit(s).alias("series_id"), v.alias("value")) for s, v in formula.items()]
    market = meas.select("k", "date", F.explode(F.array(*cells)).alias("_c")).select("k", "date", "_c.*")
    return {
        "point": one(meas, "qhi"),
        "lower": one(ranged, "qlo"),
        "upper": one(ranged, "qhi"),
        "index": one(meas, "price"),
        "unemployment": one(meas, "tax_hi"),
        "natural": one(quarter, "disc_hi"),
        "market": market,
    }


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Dates as ISO text and, if asked, doubles rounded: the form that is compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif digits is not None and isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)
