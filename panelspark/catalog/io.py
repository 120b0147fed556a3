"""Sources and sinks, as round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pages import PAGE_RECORD_COLUMNS, page_records
from ..operators.quality import Unique, not_null, not_null_finite
from ..sources import readers as rd
from ..sources import writers as wr
from ..sources.storage import scratch_path
from . import fixtures as fx
from .extraction import _ERROR, _LANG, _element, _limit, stored_pages
from .fixtures import plain
from .registry import query, with_views

_DAILY = """(SELECT CAST(l_shipdate AS DATE) AS date, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY 1)"""
_DAILY_TEXT = f"SELECT CAST(date AS VARCHAR) AS date, value FROM {_DAILY}"


def _daily(spark, sf):
    """One series for the whole table, unique per day."""
    return (
        fx.table(spark, sf, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    )


@query("read_series_csv", _DAILY_TEXT)
def read_series_csv(spark, sf):
    path = scratch_path(spark, "series_csv")
    wr.write_panel(_daily(spark, sf), path)
    return plain(rd.read_series_csv(spark, path))


@query(
    "read_series_json",
    f"SELECT CAST(date AS VARCHAR) AS date, CASE WHEN value > 100000 THEN value END AS value FROM {_DAILY}",
)
def read_series_json(spark, sf):
    """Documents of one month each; small values are written as the missing mark."""
    text = F.when(F.col("value") > 100000, F.col("value").cast("string")).otherwise(".")
    docs = (
        _daily(spark, sf)
        .groupBy(F.trunc("date", "month").alias("month"))
        .agg(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), text.alias("value"))).alias("observations"))
    )
    path = scratch_path(spark, "series_json")
    docs.select("observations").write.json(path)
    return plain(rd.read_series_json(spark, path, multi_line=False))


_CATALOG = {"target_rate": "l_quantity", "unemployment": "l_tax", "treasury_1y_pct": "l_discount"}
_SERIES_UNION = " UNION ALL ".join(
    f"SELECT CAST(l_shipdate AS DATE) AS date, '{n}' AS logical_name, CAST(max(CAST({c} AS DECIMAL(9,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1"
    for n, c in _CATALOG.items()
)


def _catalog_folder(spark, sf) -> str:
    """Files of three declared series, one folder per series."""
    top = lambda c: F.max(F.col(c).cast("decimal(9,2)")).cast("double")
    daily = (
        fx.table(spark, sf, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(*[top(c).alias(n) for n, c in _CATALOG.items()])
    )
    path = scratch_path(spark, "series_catalog")
    wr.write_panel(
        daily.unpivot(["date"], list(_CATALOG), "logical_name", "value"),
        path,
        partition_by=["logical_name"],
    )
    return path


@query(
    "read_series_catalog",
    f"""SELECT u.logical_name, c.series_id, c.frequency, c.role, CAST(u.date AS VARCHAR) AS date, u.value
    FROM ({_SERIES_UNION}) u JOIN (VALUES ('target_rate', 'DFEDTAR', 'daily', 'policy'),
      ('unemployment', 'UNRATE', 'monthly', 'labour'), ('treasury_1y_pct', 'DGS1', 'daily', 'market'))
      c(logical_name, series_id, frequency, role) ON u.logical_name = c.logical_name""",
)
def read_series_catalog(spark, sf):
    return plain(rd.read_series_catalog(spark, _catalog_folder(spark, sf)))


# The declared series and one that is not, with unreadable dates and values and repeats.
_FAULTY_SERIES = f"""(SELECT CASE logical_name WHEN 'treasury_1y_pct' THEN 'not_declared' ELSE logical_name END AS logical_name,
  CASE WHEN day(date) = 13 THEN 'not-a-date' ELSE CAST(date AS VARCHAR) END AS date,
  CASE WHEN day(date) = 14 THEN 'abc' END AS bad_value, day(date) AS dom FROM ({_SERIES_UNION}))"""


@query(
    "read_series_catalog_rejects",
    f"""WITH f AS (SELECT * FROM {_FAULTY_SERIES} UNION ALL SELECT * FROM {_FAULTY_SERIES} WHERE dom = 28)
    SELECT 'valid_date:date' AS rule, count(*) FILTER (WHERE dom = 13) AS violations FROM f UNION ALL
    SELECT 'numeric:value', count(bad_value) FROM f UNION ALL
    SELECT 'declared:logical_name', count(*) FILTER (WHERE logical_name = 'not_declared') FROM f UNION ALL
    SELECT 'unique:date', CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM
      (SELECT count(*) AS n FROM f GROUP BY logical_name, date)""",
)
def read_series_catalog_rejects(spark, sf):
    """Rejected rows of a folder of series files with faults, counted by broken rule."""
    dom = F.dayofmonth("date")
    long = rd.read_series_catalog(spark, _catalog_folder(spark, sf)).select("logical_name", "date", "value")
    faulty = long.unionByName(long.where(dom == 28)).select(
        F.when(F.col("logical_name") == "treasury_1y_pct", "not_declared")
        .otherwise(F.col("logical_name"))
        .alias("logical_name"),
        F.when(dom == 13, "not-a-date").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(dom == 14, "abc").otherwise(F.col("value").cast("string")).alias("value"),
    )
    path = scratch_path(spark, "faulty_series")
    wr.write_panel(faulty, path, partition_by=["logical_name"])
    _, bad = rd.read_series_catalog(spark, path, on_violation="quarantine")
    return _by_rule(bad)


@query(
    "verify_outputs_exist",
    f"""SELECT count(*) AS series, count(*) FILTER (WHERE rows = 0) AS missing, CAST(sum(rows) AS BIGINT) AS rows,
    CAST(min(lo) AS VARCHAR) AS first_date, CAST(max(hi) AS VARCHAR) AS last_date FROM (
      SELECT logical_name, count(*) AS rows, min(date) AS lo, max(date) AS hi FROM ({_SERIES_UNION}) GROUP BY 1
      UNION ALL SELECT 'series_' || i, 0, NULL, NULL FROM range(19) t(i))""",
)
def verify_outputs_exist(spark, sf):
    long = rd.read_series_catalog(spark, _catalog_folder(spark, sf))
    report = rd.verify_outputs_exist(long, rd.series_catalog(spark))
    return plain(
        report.agg(
            F.count(F.lit(1)).alias("series"),
            F.count_if(F.col("rows") == 0).alias("missing"),
            F.sum("rows").alias("rows"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
    )


@query(
    "read_event_calendar",
    with_views("ev", "SELECT CAST(meeting_date AS VARCHAR) AS meeting_date, is_scheduled, source_url FROM ev"),
)
def read_event_calendar(spark, sf):
    path = scratch_path(spark, "calendar")
    wr.write_panel(
        fx.daily_events(spark, sf).select("k", "meeting_date", "is_scheduled", "source_url"), path
    )
    return plain(rd.read_event_calendar(spark, path, key=["k"]).drop("k"))


# The same calendar with unreadable dates, unknown flags, blank urls and repeats.
_FAULTY_EVENTS = """(SELECT k, CASE WHEN day(meeting_date) = 13 THEN 'nope' ELSE CAST(meeting_date AS VARCHAR) END AS meeting_date,
  CASE WHEN day(meeting_date) = 14 THEN 'maybe' END AS is_scheduled,
  CASE WHEN day(meeting_date) = 15 THEN ' ' ELSE source_url END AS source_url, day(meeting_date) AS dom FROM ev)"""


@query(
    "read_event_calendar_rejects",
    with_views(
        "ev",
        f"""SELECT * FROM (WITH f AS (SELECT * FROM {_FAULTY_EVENTS} UNION ALL SELECT * FROM {_FAULTY_EVENTS} WHERE dom = 28)
        SELECT 'valid_date:meeting_date' AS rule, count(*) FILTER (WHERE dom = 13) AS violations FROM f UNION ALL
        SELECT 'domain:is_scheduled', count(*) FILTER (WHERE dom = 14) FROM f UNION ALL
        SELECT 'not_blank:source_url', count(*) FILTER (WHERE trim(source_url) = '') FROM f UNION ALL
        SELECT 'unique:meeting_date', CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM
          (SELECT count(*) AS n FROM f GROUP BY k, meeting_date))""",
    ),
)
def read_event_calendar_rejects(spark, sf):
    """Rejected rows of a calendar file with faults, counted by broken rule."""
    dom = F.dayofmonth("meeting_date")
    events = fx.daily_events(spark, sf).select("k", "meeting_date", "is_scheduled", "source_url")
    faulty = events.unionByName(events.where(dom == 28)).select(
        "k",
        F.when(dom == 13, "nope").otherwise(F.col("meeting_date").cast("string")).alias("meeting_date"),
        F.when(dom == 14, "maybe").otherwise(F.col("is_scheduled").cast("string")).alias("is_scheduled"),
        F.when(dom == 15, " ").otherwise(F.col("source_url")).alias("source_url"),
    )
    path = scratch_path(spark, "faulty_calendar")
    wr.write_panel(faulty, path)
    _, bad = rd.read_event_calendar(spark, path, key=["k"], on_violation="quarantine")
    return _by_rule(bad)


def _by_rule(bad):
    return (
        bad.select(F.explode("broken_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    )


@query(
    "read_panel",
    with_views("h", "SELECT k, CAST(d AS VARCHAR) AS d, v FROM h"),
)
def read_panel(spark, sf):
    path = scratch_path(spark, "panel")
    wr.write_panel(fx.customer_history(spark, sf), path, fmt="parquet")
    rules = [Unique("unique:k,d", ["k", "d"]), not_null("d"), not_null_finite("v")]
    return plain(rd.read_panel(spark, path, rules))


@query(
    "write_panel",
    with_views("h", "SELECT CAST(k AS VARCHAR) AS k, CAST(d AS VARCHAR) AS d, v, year(d) AS year FROM h"),
)
def write_panel(spark, sf):
    """CSV partitioned by year, read back as text: dates are ISO."""
    path = scratch_path(spark, "panel_csv")
    panel = fx.customer_history(spark, sf).withColumn("year", F.year("d").cast("long"))
    wr.write_panel(panel, path, partition_by=["year"])
    text = spark.read.option("header", True).schema("k string, d string, v string, year long").csv(path)
    return text.withColumn("v", F.col("v").cast("double"))


@query(
    "filter_observation_start",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'""",
)
def filter_observation_start(spark, sf):
    orders = fx.table(spark, sf, "orders")
    return rd.filter_observation_start(orders, "1999-01-01", date="o_orderdate").select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


_RECORDS = f"""(SELECT 'page_' || page_id AS source_id, {_LANG} AS category, url, {_ERROR} AS error,
  CASE WHEN url LIKE '%#%' THEN 404 WHEN url LIKE '%?%' THEN NULL ELSE 200 END AS status_code,
  CASE WHEN {_ERROR} IS NULL THEN nullif({_limit('t', 300)}, '') END AS title,
  CASE WHEN {_ERROR} IS NULL AND h <> '' THEN 1 ELSE 0 END AS heading_count, 0 AS table_count
  FROM (SELECT *, {_element('title')} AS t, {_element('h1')} AS h FROM pages) WHERE {_LANG} <> '')"""


def _records(spark, sf):
    """Records of all pages: those that keep the contract, and the rejected ones."""
    return wr.validate_page_records(page_records(stored_pages(spark, sf)), on_violation="quarantine")


@query(
    "page_record_rejects",
    f"SELECT 'page_' || page_id AS source_id, url FROM pages WHERE coalesce(trim({_LANG}), '') = ''",
)
def page_record_rejects(spark, sf):
    """Records that are not written because a text field is blank."""
    return _records(spark, sf)[1].select("source_id", "url")


@query(
    "write_nested_jsonl",
    f"SELECT source_id, category, url, error, status_code, title, heading_count, table_count FROM {_RECORDS}",
)
def write_nested_jsonl(spark, sf):
    records = _records(spark, sf)[0]
    path = scratch_path(spark, "records")
    wr.write_nested_jsonl(records, path)
    back = spark.read.schema(records.schema).json(path).select(*PAGE_RECORD_COLUMNS)
    return back.select(
        "source_id",
        "category",
        "url",
        "error",
        "status_code",
        "title",
        F.size("headings").alias("heading_count"),
        F.size("table_previews").alias("table_count"),
    )


@query(
    "write_coverage_summary",
    f"SELECT source_id, category, url, error, status_code, heading_count, table_count FROM {_RECORDS}",
)
def write_coverage_summary(spark, sf):
    path = scratch_path(spark, "summary")
    wr.write_coverage_summary(_records(spark, sf)[0], path)
    schema = (
        "source_id string, category string, url string, fetched_at_utc string, status_code int, "
        "title string, heading_count int, table_count int, error string"
    )
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.drop("fetched_at_utc", "title")
