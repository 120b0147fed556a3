"""Distributed ranks against plain window functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window, functions as F

from panelspark.operators import ranking as rk

ROWS = "g string, value double, name string"


def by_window(df, rank, *order):
    return df.withColumn("rank", rank.over(Window.partitionBy("g").orderBy(*order)))


def both(df):
    return (
        (rk.rank_min_desc(df, group=["g"], value="value"), by_window(df, F.rank(), F.desc("value"))),
        (
            rk.sequential_rank(df, group=["g"], value="value", name="name"),
            by_window(df, F.row_number(), F.desc("value"), F.asc("name")),
        ),
    )


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.5, float("nan"), -3.0])),
        ),
        max_size=30,
    )
)
def test_ranks_equal_those_of_windows(spark, pairs):
    df = spark.createDataFrame([(g, v, f"n{i}") for i, (g, v) in enumerate(pairs)], ROWS).repartition(3)
    for own, window in both(df):
        assert rows(own) == rows(window)


def test_one_group_is_spread_over_all_tasks(spark):
    # Two thirds of the rows share one value: borders between tasks fall inside it.
    df = spark.range(200_000).select(
        F.lit("all").alias("g"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(7.0).alias("value"),
        F.format_string("%06d", "id").alias("name"),
    )
    for own, window in both(df):
        assert own.exceptAll(window).count() == 0 and own.count() == 200_000
    # A table this small would be joined to one task again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = df.orderBy(F.asc("g"), F.desc("value"), F.asc("name")).groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in tasks.collect()]
        for own, window in both(df):
            assert own.exceptAll(window).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 100_000


def test_no_window_over_the_rows(spark):
    df = spark.createDataFrame([("a", 1.0, "x")], ROWS)
    for own, _ in both(df):
        text = own._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in text.splitlines() if "Window" in line and "windowspec" in line]
        assert windows and all("_size" in line for line in windows)


def test_whole_table_as_one_group_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0)], "_task int, _start double")
    out = rk.rank_min_desc(df.toDF("a.b", "v"), group=[], value="v")
    assert {r["a.b"]: r["rank"] for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError, match="_task"):
        rk.rank_min_desc(df, group=[], value="_start")
