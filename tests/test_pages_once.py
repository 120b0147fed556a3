"""Pages are read on all cores, once per query, and their rows without a search per cell."""

import datetime as dt

import pytest

from panelspark.catalog import extraction as ex
from panelspark.operators import pages as pg


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = [
        (i, i % 5, "OFP"[i % 3], 1.0, dt.datetime(1996 + i % 5, 1 + i % 12, 2 + i % 20), ("1-URGENT", "3-MEDIUM", "5-LOW")[i % 3 - 1])
        for i in range(1, 60)
    ]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_pages_of_one_file_are_rendered_on_all_cores(spark, orders):
    cores = spark.sparkContext.defaultParallelism
    for made in (ex.recent_pages, ex.archive_pages):
        assert made(spark, orders).rdd.getNumPartitions() == cores


@pytest.mark.parametrize("name, stage", [("event_calendar_merge", "merged_events"), ("event_calendar_rejects", "merged_events"), ("event_date_faults", "dated_events")])
def test_checks_pass_over_written_events_not_over_pages(spark, orders, name, stage):
    from panelspark.catalog import QUERIES

    files = QUERIES[name](spark, orders).inputFiles()
    assert files and all(f"/{stage}-" in f for f in files)


def test_cells_are_found_without_searching_an_array_per_row(spark):
    html = (
        "<table><tr><th>a</th><th>a</th><th>a_2</th><th></tr><tr><td>1<td>2</td><td>3 &amp; &#52;</td></tr>"
        "<tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</table><TABLE><tr><td>open"
    )
    found = pg.page_table_preview(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert "array_position" not in found._jdf.queryExecution().optimizedPlan().toString()
    first, second, third = found.first().table_previews
    # Of two columns of one name the last stands; a cell that is left open ends at the next tag.
    assert first[0] == {"a": "1", "a_2": "3 & 4", "column_4": None}
    assert first[1] == {"a": "x in y", "a_2": None, "column_4": None}
    assert first[2] == {"a": "in", "a_2": None, "column_4": None}
    assert second == [{"column_1": "in"}]
    assert third == [{"column_1": "open"}]
