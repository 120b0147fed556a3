"""Physical plans: what must not appear at scale."""

import pytest
from pyspark.sql import functions as F

from panelspark.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


CORE = [
    "asof_backward", "asof_forward_strict_tol", "asof_multi", "asof_calendar_offset", "resample_month_end_last",
    "forward_fill", "pct_change_complete", "diff_n", "rolling_mean_full", "splice_series", "history_features",
    "prior_streak", "labour_panel", "monthly_panel", "event_alignment", "exact_date_lookup", "duplicate_keys",
]


@pytest.mark.parametrize("name", CORE)
def test_no_pairing_single_task_or_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in text, node


def test_history_moves_its_rows_once(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        text = plan(QUERIES["history_features"](spark, SF))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # The rows by slice; end rows by key and back by slice.  The other side reads the
    # first shuffle again, and the join reads the rows where the window left them.
    nodes = [line.split("+- ", 1)[-1].split(":- ", 1)[-1] for line in text.splitlines()]
    assert sum(n.startswith("Exchange ") for n in nodes) == 3
    assert sum(n.startswith("ReusedExchange ") for n in nodes) == 1
    assert text.count("FileScan") == 1 and "partial_max_by(" in text and "BroadcastExchange" not in text


def test_only_needed_columns_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["filter_observation_start"](spark, SF))
    assert "PushedFilters" in text and "GreaterThanOrEqual(o_orderdate" in text
    scan = QUERIES["rank_min_desc"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in scan and "l_shipdate" not in scan


def test_month_windows_share_the_key_shuffle(spark):
    from panelspark.operators import calendar as cal, windows as w
    from panelspark.catalog import fixtures as fx

    months = cal.resample_month_end_last(fx.series(spark, SF), key=["k"], date="d", values=["v"])
    base = plan(months).count("Exchange")
    out = months
    for n in (1, 3):
        out = w.diff_n(out, key=["k"], order="d", value="v", n=n, out=f"c{n}")
    out = w.rolling_mean_full(out, key=["k"], order="d", value="v", n=6, out="ma6")
    assert plan(out.select(F.col("*"))).count("Exchange") == base


def test_one_to_one_is_asserted_in_the_join(spark):
    from panelspark.operators.joins import exact_date_lookup, left_join_one_to_one

    rows = lambda *keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v int")
    one, two = rows("a", "b", None), rows("a", "c", "c").withColumnRenamed("v", "w")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(left_join_one_to_one(one, two, on=["k"], check="plan"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning") == 2
    good = left_join_one_to_one(one, two.where("w < 2"), on=["k"], check="plan").collect()
    assert sorted((r.k or "", r.v, r.w) for r in good) == [("", 2, None), ("a", 0, 0), ("b", 1, None)]
    for left, right, side, key in ((one, two, "right", '"c"'), (rows("b", None, None), two.limit(0), "left", "null")):
        with pytest.raises(Exception, match=rf"unique:{side}: more than one row for .*{key}"):
            left_join_one_to_one(left, right, on=["k"], check="plan").collect()
    dated = lambda df: df.withColumn("d", F.lit("2024-01-01").cast("date"))
    with pytest.raises(Exception, match="unique:lookup"):
        exact_date_lookup(
            dated(one), dated(two), key=["k"], left_date="d", right_date="d", values={"w": "x"}
        ).collect()
