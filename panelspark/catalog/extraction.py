"""Records and event calendars from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dates import parse_decision_date
from ..operators import pages as pg
from ..operators.quality import quarantine, violations
from ..sources.records import landed_faults, validate_landed
from ..sources.writers import page_record_rules
from . import fixtures as fx
from .fixtures import plain
from .registry import query, with_views

# White space as the SQL side spells it, and the two entities of the pages.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def _limit(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN rtrim(substring({x}, 1, {n - 1})) || '…' ELSE {x} END"


def _decoded(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


def _element(tag: str) -> str:
    inner = f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"
    return _collapse(_decoded(f"regexp_replace({inner}, '<[^>]*>', ' ', 'g')"))


@query(
    "page_title",
    f"SELECT page_id, nullif({_limit('t', 300)}, '') AS title FROM (SELECT page_id, {_element('title')} AS t FROM pages)",
)
def page_title(spark, sf):
    return pg.page_title(fx.table(spark, sf, "pages")).select("page_id", "title")


@query(
    "page_headings",
    f"""SELECT page_id, CASE WHEN t = '' THEN 0 ELSE 1 END AS headings, coalesce(nullif({_limit('t', 300)}, ''), '') AS text
    FROM (SELECT page_id, {_element('h1')} AS t FROM pages)""",
)
def page_headings(spark, sf):
    found = pg.page_headings(fx.table(spark, sf, "pages"))
    return found.select(
        "page_id", F.size("headings").alias("headings"), F.array_join("headings", "|").alias("text")
    )


def _order_tables(spark, sf):
    """One page per order: a table with a header and one without."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    html = F.concat(
        F.lit("<table><tr><th>status</th><th>priority</th><th>status</th><th></th></tr><tr><td>"),
        status,
        F.lit("</td><td> <b>"),
        priority,
        F.lit("</b><br>x</td><td>"),
        F.col("o_custkey").cast("string"),
        F.lit("</td></tr><tr><td></td></tr></table><p>&amp;</p><table class='t'><tr><td>"),
        F.col("o_orderkey").cast("string"),
        F.lit("</td><td>a &amp; b</td></tr></table><table></table>"),
    )
    return _rows_to_render(spark, sf).select(
        F.col("o_orderkey").alias("page_id"), F.lit("").alias("url"), html.alias("html")
    )


def _rows_to_render(spark, sf):
    """Orders over all cores: a file of small rows becomes pages that take long to read."""
    return fx.table(spark, sf, "orders").repartition(spark.sparkContext.defaultParallelism)


_CELLS = """SELECT o_orderkey AS page_id, v.t AS table_no, v.r AS row_no, v.n AS name,
  CASE v.i WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority || ' x' WHEN 3 THEN CAST(o_custkey AS VARCHAR)
    WHEN 4 THEN CAST(o_orderkey AS VARCHAR) WHEN 5 THEN 'a & b' END AS value
  FROM orders CROSS JOIN (VALUES (0, 0, 'status', 1), (0, 0, 'priority', 2), (0, 0, 'status_2', 3), (0, 0, 'column_4', 0),
    (0, 1, 'status', 0), (0, 1, 'priority', 0), (0, 1, 'status_2', 0), (0, 1, 'column_4', 0),
    (1, 0, 'column_1', 4), (1, 0, 'column_2', 5)) v(t, r, n, i)"""


@query("page_table_preview", _CELLS)
def page_table_preview(spark, sf):
    found = pg.page_table_preview(_order_tables(spark, sf))
    # The outer form keeps the optimizer from computing the array again in a filter.
    tables = found.select("page_id", F.posexplode_outer("table_previews").alias("table_no", "_t"))
    rows = tables.where("table_no IS NOT NULL").select(
        "page_id", "table_no", F.posexplode("_t").alias("row_no", "_r")
    )
    return rows.select("page_id", "table_no", "row_no", F.explode("_r").alias("name", "value"))


@query("page_table_preview_raw", "SELECT page_id, 0 AS tables FROM pages WHERE NOT regexp_matches(html, '(?i)<table')")
def page_table_preview_raw(spark, sf):
    """The given pages themselves, which hold no tables."""
    found = pg.page_table_preview(fx.table(spark, sf, "pages"))
    return found.select("page_id", F.size("table_previews").alias("tables"))


@query(
    "normalize_text",
    f"""SELECT doc_id, {_limit('t', 500)} AS short, md5(t) AS whole FROM (SELECT doc_id, {_collapse('text')} AS t FROM documents)""",
)
def normalize_text(spark, sf):
    docs = fx.table(spark, sf, "documents")
    whole = tx.collapse_whitespace(F.col("text"))
    return docs.select(
        "doc_id", tx.normalize_text(F.col("text"), 500).alias("short"), F.md5(whole).alias("whole")
    )


_URLS = """(SELECT page_id, unnest([url, replace(url, 'http', 'ftp'), replace(url, '://', '://u:p@'), url || chr(10),
  regexp_replace(url, '//[^/]*', '//'), upper(url), regexp_replace(url, '//([^/]*)', '//\\1:8080')]) AS url,
  unnest(range(7)) AS variant FROM pages)"""


def _url_variants(spark, sf):
    url = F.col("url")
    made = [
        url,
        F.replace(url, F.lit("http"), F.lit("ftp")),
        F.replace(url, F.lit("://"), F.lit("://u:p@")),
        F.concat(url, F.lit("\n")),
        F.regexp_replace(url, "//[^/]*", "//"),
        F.upper(url),
        F.regexp_replace(url, "//([^/]*)", "//$1:8080"),
    ]
    return fx.table(spark, sf, "pages").select(
        "page_id", F.posexplode(F.array(*made)).alias("variant", "url")
    )


@query(
    "url_format_valid",
    f"SELECT page_id, CAST(variant AS INTEGER) AS variant, variant IN (0, 5, 6) AS valid FROM {_URLS}",
)
def url_format_valid(spark, sf):
    return _url_variants(spark, sf).select(
        "page_id", "variant", tx.url_format_valid(F.col("url")).alias("valid")
    )


_LANG = "regexp_extract(url, '/([a-z]{2})/', 1)"


def stored_pages(spark, sf):
    """Pages as landed: with a source id, a category, a status and a content type."""
    url = F.col("url")
    return fx.table(spark, sf, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("source_id"),
        F.regexp_extract(url, "/([a-z]{2})/", 1).alias("category"),
        "url",
        F.lit("2024-01-01T00:00:00+00:00").alias("fetched_at_utc"),
        F.when(url.contains("#"), 404).when(url.contains("?"), None).otherwise(200).alias("status_code"),
        F.when(url.startswith("https"), "text/html; charset=utf-8")
        .when(url.contains("/en/"), "")
        .otherwise("Application/JSON")
        .alias("content_type"),
        "html",
    )


_ERROR = """CASE WHEN url LIKE '%#%' THEN 'HTTP status 404' WHEN url LIKE '%?%' THEN 'no response'
  WHEN url LIKE 'https%' OR url LIKE '%/en/%' THEN NULL ELSE 'expected HTML but received application/json' END"""


@query(
    "validate_source",
    f"""SELECT 'page_' || page_id AS source_id, trim({_LANG}) AS category, url,
    CASE WHEN {_LANG} = '' THEN 'blank category' WHEN variant IN (1, 4) THEN 'invalid url' END AS source_error
    FROM (SELECT page_id, variant, trim(url, ' ' || chr(10)) AS url FROM {_URLS})""",
)
def validate_source(spark, sf):
    sources = _url_variants(spark, sf).select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("source_id"),
        F.concat(F.lit(" "), F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("category"),
        "url",
    )
    return pg.validate_source(sources)


@query(
    "source_ids_unique",
    """SELECT host AS source_id, count(*) AS n FROM (SELECT regexp_extract(url, '//([^/]*)', 1) AS host FROM pages)
    GROUP BY 1 HAVING count(*) > 1""",
)
def source_ids_unique(spark, sf):
    host = F.regexp_extract("url", "//([^/]*)", 1)
    return pg.duplicate_source_ids(fx.table(spark, sf, "pages").select(host.alias("source_id")))


@query("content_gate", f"SELECT 'page_' || page_id AS source_id, {_ERROR} AS error FROM pages")
def content_gate(spark, sf):
    return pg.content_gate(stored_pages(spark, sf)).select("source_id", "error")


@query(
    "page_records",
    f"""SELECT 'page_' || page_id AS source_id, {_ERROR} AS error,
    CASE WHEN {_ERROR} IS NULL THEN nullif({_limit('t', 300)}, '') END AS title,
    CASE WHEN {_ERROR} IS NULL AND h <> '' THEN 1 ELSE 0 END AS heading_count, 0 AS table_count
    FROM (SELECT *, {_element('title')} AS t, {_element('h1')} AS h FROM pages)""",
)
def page_records(spark, sf):
    summary = pg.coverage_summary(pg.page_records(stored_pages(spark, sf)))
    return summary.select("source_id", "error", "title", "heading_count", "table_count")


@query(
    "coverage_report",
    f"""SELECT count(*) FILTER (WHERE error IS NULL) AS succeeded, count(*) FILTER (WHERE error IS NOT NULL) AS failed
    FROM (SELECT {_ERROR} AS error FROM pages)""",
)
def coverage_report(spark, sf):
    return pg.coverage_report(pg.content_gate(stored_pages(spark, sf)))


@query(
    "failed_sources",
    f"SELECT * FROM (SELECT 'page_' || page_id AS source_id, {_ERROR} AS error FROM pages) WHERE error IS NOT NULL",
)
def failed_sources(spark, sf):
    return pg.failed_sources(pg.content_gate(stored_pages(spark, sf)))


@query(
    "validate_page_records",
    f"""SELECT 'not_blank:source_id' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL
    SELECT 'not_blank:category', (SELECT count(*) FROM pages WHERE {_LANG} = '') UNION ALL
    SELECT 'not_blank:url', 0 UNION ALL SELECT 'not_blank:fetched_at_utc', 0""",
)
def validate_page_records(spark, sf):
    return violations(pg.page_records(stored_pages(spark, sf)), page_record_rules())


# --- calendars rendered from the orders ----------------------------------------


def _dated(spark, sf):
    """Orders with the parts of a two-day display range ending on the order date."""
    end = F.col("o_orderdate").cast("date")
    start = F.date_sub(end, 1)
    same = F.month(start) == F.month(end)
    return _rows_to_render(spark, sf).select(
        F.col("o_orderkey").alias("page_id"),
        "o_orderpriority",
        "o_orderstatus",
        F.year(start).alias("year"),
        F.when(same, F.date_format(end, "MMMM"))
        .otherwise(F.concat_ws("/", F.date_format(start, "MMM"), F.date_format(end, "MMM")))
        .alias("month_text"),
        F.concat_ws("-", F.dayofmonth(start).cast("string"), F.dayofmonth(end).cast("string")).alias(
            "date_text"
        ),
        F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string")).alias("url"),
    )


@query(
    "parse_decision_date",
    "SELECT o_orderkey AS page_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date FROM orders",
)
def parse_decision_date_query(spark, sf):
    parsed = parse_decision_date(F.col("year"), F.col("month_text"), F.col("date_text"))
    return plain(_dated(spark, sf).select("page_id", parsed.alias("event_date")))


def recent_pages(spark, sf):
    note = (
        F.when(F.col("o_orderpriority") == "1-URGENT", " (unscheduled)")
        .when(F.col("o_orderstatus") == "P", " (notation vote)")
        .otherwise("*")
    )
    html = F.concat(
        F.lit('<html><body><div class="panel panel-default"><div class="panel-heading"><h4><a>'),
        F.col("year").cast("string"),
        F.lit(' FOMC Meetings</a></h4></div><div class="row fomc-meeting"><div class="fomc-meeting__month"><b>'),
        F.col("month_text"),
        F.lit('</b></div><div class="fomc-meeting__date">'),
        F.col("date_text"),
        note,
        F.lit("</div><div>x</div></div></div><p>unscheduled notation vote</p></body></html>"),
    )
    return _dated(spark, sf).select("url", "year", html.alias("html"))


_RECENT = """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date, o_orderpriority <> '1-URGENT' AS is_scheduled,
  'https://example.org/' || o_orderkey AS source_url, year(CAST(o_orderdate AS DATE) - 1) AS year FROM orders
  WHERE o_orderpriority = '1-URGENT' OR o_orderstatus <> 'P'"""


@query("events_from_recent_pages", f"SELECT event_date, is_scheduled, source_url FROM ({_RECENT})")
def events_from_recent_pages(spark, sf):
    return plain(pg.events_from_recent_pages(recent_pages(spark, sf)))


def archive_pages(spark, sf):
    urgent, call = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P"
    link = F.when(F.col("o_orderpriority") == "5-LOW", "<p><a href='s'> <i>Statement</i> </a></p>").otherwise(
        "<p><a href='m'>Minutes</a></p>"
    )
    html = F.concat(
        F.lit("<h5 class='x'>"),
        F.col("month_text"),
        F.lit(" "),
        F.col("date_text"),
        F.when(urgent, " (unscheduled)").otherwise(""),
        F.when(call, " Conference Call - ").otherwise(" Meeting - "),
        F.col("year").cast("string"),
        F.lit("</h5>"),
        link,
        F.lit("<h5>Contents</h5><a>Statement</a>"),
    )
    return _dated(spark, sf).select("url", "year", html.alias("html"))


_ARCHIVE = """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date,
  o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' AS is_scheduled, 'https://example.org/' || o_orderkey AS source_url,
  year(CAST(o_orderdate AS DATE) - 1) AS year FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '5-LOW'"""


@query("events_from_archive_pages", f"SELECT event_date, is_scheduled, source_url FROM ({_ARCHIVE})")
def events_from_archive_pages(spark, sf):
    return plain(pg.events_from_archive_pages(archive_pages(spark, sf)))


@query(
    "event_calendar_merge",
    f"""SELECT event_date, is_scheduled, source_url FROM (
      SELECT * FROM ({_RECENT}) WHERE year >= 1999 UNION ALL SELECT * FROM ({_ARCHIVE}) WHERE year BETWEEN 1996 AND 1998)
    WHERE year(CAST(event_date AS DATE)) BETWEEN 1996 AND 2000 AND year <= 2000""",
)
def event_calendar_merge(spark, sf):
    """All events, those that the rules accept and those that they reject."""
    good, rejected = _merged_calendar(spark, sf)
    return plain(good.unionByName(rejected.drop("broken_rules")))


def _merged_calendar(spark, sf):
    recent = recent_pages(spark, sf).where("year >= 1999")
    return pg.event_calendar_merge(
        pg.events_from_recent_pages(recent, start_year=1996, end_year=2000),
        archive_pages(spark, sf),
        pg.recent_years(recent),
        start_year=1996,
        end_year=2000,
        on_violation="quarantine",
    )


@query(
    "event_calendar_rejects",
    f"""SELECT event_date, is_scheduled, source_url, 'unique:event_date' AS broken FROM (
      SELECT *, count(*) OVER (PARTITION BY event_date) AS n FROM (
        SELECT * FROM ({_RECENT}) WHERE year >= 1999 UNION ALL SELECT * FROM ({_ARCHIVE}) WHERE year BETWEEN 1996 AND 1998)
      WHERE year(CAST(event_date AS DATE)) BETWEEN 1996 AND 2000 AND year <= 2000) WHERE n > 1""",
)
def event_calendar_rejects(spark, sf):
    """Events of a calendar that a repeated date keeps out of it."""
    rejected = _merged_calendar(spark, sf)[1]
    return plain(rejected).withColumn("broken", F.array_join("broken_rules", "|")).drop("broken_rules")


# Faults that are put into the pages, by the order that a page is made from.
_FAULTY_MONTH, _FAULTY_DAY = "o_orderkey % 7 = 3", "o_orderkey % 11 = 5"


@query(
    "event_date_faults",
    f"""SELECT source_url, event_date, CASE WHEN event_date IS NULL THEN 'readable:event_date' ELSE '' END AS fault FROM (
      SELECT 'https://example.org/' || o_orderkey AS source_url,
        CASE WHEN {_FAULTY_MONTH} OR {_FAULTY_DAY} THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS event_date
      FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus <> 'P')""",
)
def event_date_faults(spark, sf):
    """Calendars with unknown months and without days: each such event is named."""
    keyed = F.regexp_extract("url", r"/(\d+)$", 1).cast("long")
    month = r"(fomc-meeting__month\"><b>)[^<]*"
    day = r"(fomc-meeting__date\">)[\d-]+"
    html = F.when(keyed % 7 == 3, F.regexp_replace("html", month, "$1Smarch")).otherwise(F.col("html"))
    html = F.when(keyed % 11 == 5, F.regexp_replace(html, day, "$1")).otherwise(html)
    events = pg.events_from_recent_pages(recent_pages(spark, sf).withColumn("html", html))
    # Good and rejected events are two passes: over the events, not over the pages.
    events = fx.materialise(events, "dated_events")
    # The readable rule alone: dates repeat among the orders.
    good, bad = quarantine(events, pg.event_date_rules()[:1])
    both = good.withColumn("fault", F.lit("")).unionByName(
        bad.withColumn("fault", F.array_join("broken_rules", "|")).drop("broken_rules")
    )
    return plain(both.select("source_url", "event_date", "fault"))


# --- landed records with faults of every kind ------------------------------------

#: What is put into the record of each page, by its number.
_RECORD_FAULTS = (
    "",
    "missing title",
    "unexpected extra",
    "neither integer nor null: status_code",
    "neither integer nor null: status_code",
    "neither integer nor null: status_code",
    "not a list of text: headings",
    "not a list of text: headings",
    "not a list: table_previews",
    "not text: category",
    "neither text nor null: error",
    "not valid JSON",
    "not valid JSON",
    "not an object",
    "not text: url",
)


def landed_lines(spark, sf):
    """One JSON line per page, most with one fault."""
    n = F.col("page_id") % len(_RECORD_FAULTS)
    text = F.regexp_replace(F.to_json(F.struct(F.col("url").alias("x"))), r'^\{"x":|\}$', "")
    fields = [
        F.concat(F.lit('"source_id":"page_'), F.col("page_id").cast("string"), F.lit('"')),
        F.when(n == 9, F.lit('"category":" \\t"')).otherwise(F.lit('"category":"c"')),
        F.when(n == 14, F.lit('"url":null')).otherwise(F.concat(F.lit('"url":'), text)),
        F.lit('"fetched_at_utc":"2024-01-01T00:00:00+00:00"'),
        F.when(n == 3, F.lit('"status_code":"200"'))
        .when(n == 4, F.lit('"status_code":true'))
        .when(n == 5, F.lit('"status_code":200.5'))
        .when(n == 12, F.lit('"status_code":NaN'))
        .otherwise(F.when(F.col("page_id") % 2 == 0, F.lit('"status_code":null')).otherwise(F.lit('"status_code":200'))),
        F.when(n != 1, F.lit('"title":null')),
        F.when(n == 6, F.lit('"headings":"x"')).when(n == 7, F.lit('"headings":["x",null]')).otherwise(F.lit('"headings":["x"]')),
        F.when(n == 8, F.lit('"table_previews":{"a":1}')).otherwise(F.lit('"table_previews":[[{"a":null}]]')),
        F.when(n == 10, F.lit('"error":5')).otherwise(F.lit('"error":null')),
        F.when(n == 2, F.lit('"extra":[1]')),
    ]
    record = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    line = F.when(n == 11, F.regexp_replace(record, r"\}$", "")).when(n == 13, F.concat(F.lit("["), record, F.lit("]")))
    return fx.table(spark, sf, "pages").select("page_id", line.otherwise(record).alias("value"))


_FAULT_ROWS = ", ".join(f"({i}, '{f}')" for i, f in enumerate(_RECORD_FAULTS))


@query(
    "landed_record_faults",
    f"""SELECT fault, count(*) AS records FROM pages JOIN (VALUES {_FAULT_ROWS}) v(i, fault)
    ON page_id % {len(_RECORD_FAULTS)} = i WHERE fault <> '' GROUP BY 1""",
)
def landed_record_faults(spark, sf):
    return landed_faults(landed_lines(spark, sf))


@query(
    "landed_records_accepted",
    f"SELECT page_id FROM pages WHERE page_id % {len(_RECORD_FAULTS)} = 0",
)
def landed_records_accepted(spark, sf):
    return validate_landed(landed_lines(spark, sf), on_violation="quarantine")[0].select("page_id")


# --- tables within tables -----------------------------------------------------------


_NESTED = """SELECT o_orderkey AS page_id, v.t AS table_no, v.r AS row_no, v.n AS name,
  CASE v.i WHEN 1 THEN o_orderstatus WHEN 2 THEN 'in ' || o_custkey || ' ' || o_orderpriority
    WHEN 3 THEN CAST(o_custkey AS VARCHAR) WHEN 4 THEN o_orderpriority WHEN 5 THEN 'last' WHEN 6 THEN 'in' END AS value
  FROM orders CROSS JOIN (VALUES (0, 0, 'column_1', 1), (0, 0, 'column_2', 2), (0, 0, 'column_3', 5),
    (0, 1, 'column_1', 6), (0, 1, 'column_2', 0), (0, 1, 'column_3', 0),
    (0, 2, 'column_1', 3), (0, 2, 'column_2', 4), (0, 2, 'column_3', 0),
    (1, 0, 'in', 3), (1, 0, 'column_2', 4)) v(t, r, n, i)"""


@query("page_table_nested", _NESTED)
def page_table_nested(spark, sf):
    """A table in a cell, with cells and rows left open: rows of the inner table follow
    in the outer one, as they stand in the document, and are its own as well."""
    html = F.concat(
        F.lit("<table><tr><td>"),
        F.col("o_orderstatus"),
        F.lit("<td><table><tr><th>in</th></tr><tr><td>"),
        F.col("o_custkey").cast("string"),
        F.lit("<td>"),
        F.col("o_orderpriority"),
        F.lit("</table></td><td>last</tr></table>"),
    )
    pages = _rows_to_render(spark, sf).select(F.col("o_orderkey").alias("page_id"), html.alias("html"))
    found = pg.page_table_preview(pages).select("page_id", F.posexplode_outer("table_previews").alias("table_no", "_t"))
    rows = found.where("table_no IS NOT NULL").select("page_id", "table_no", F.posexplode("_t").alias("row_no", "_r"))
    return rows.select("page_id", "table_no", "row_no", F.explode("_r").alias("name", "value"))
