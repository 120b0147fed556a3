"""Page records and event calendars from hand-made pages."""

import datetime as dt
import html

import pytest
from pyspark.sql import functions as F

from panelspark.functions import text as tx
from panelspark.functions.dates import parse_decision_date
from panelspark.operators import pages as pg
from panelspark.operators.quality import RuleViolation

D = dt.date


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "raw",
    ["a&amp;b", "&amp", "x&ampfoo;y", "&copy 2020", "&#233;&#xe9;&#128;&#0;", "&notit;", "plain", "&bogus; &",
     "&#99999999999;", "&#x1F600;", "&hearts;&ngE;", "&amp;quot;", "&#x000041;", "a & b &lt;i&gt;"],
)
def test_entities_as_the_standard_library_reads_them(spark, raw):
    assert value(spark, tx.unescape_html(F.lit(raw))) == html.unescape(raw)


@pytest.mark.parametrize("raw, want", [("ab   cdef", "ab c…"), ("abc  ", "abc"), ("abcd ef", "abcd…"), ("ab  c", "ab c")])
def test_normalize(spark, raw, want):
    assert value(spark, tx.normalize_text(F.lit(raw), 5)) == want


@pytest.mark.parametrize(
    "url, ok",
    [("http://a.b/", True), ("HTTPS://a.b:80/x?q", True), ("ftp://a.b", False), ("http://", False),
     ("http://u:p@a.b/", False), ("http://a.b/\n", False), ("http://:80/", False), ("http:// /", False), ("", False)],
)
def test_url(spark, url, ok):
    assert value(spark, tx.url_format_valid(F.lit(url))) is ok


@pytest.mark.parametrize(
    "year, month, days, want",
    [(2008, "January", "29-30", D(2008, 1, 30)), (2013, "April/May", "30-1", D(2013, 5, 1)),
     (2012, "Dec/Jan", "31-1", D(2013, 1, 1)), (2010, "Smarch", "3", None), (2010, "Sept", "31", None),
     (2011, "January", "31 - February 1", D(2011, 2, 1)), (2011, "March", "", None)],
)
def test_decision_date(spark, year, month, days, want):
    assert value(spark, parse_decision_date(F.lit(year), F.lit(month), F.lit(days))) == want


PAGE = """<html><head><title> A <b>B</b>
 &amp; C</title></head><!-- <h1>no</h1> --><script>var x="<h1>no</h1>"</script>
<h1>One<i>two</i></h1><h2 class="x">Two</h2><h1>One two</h1><h3> </h3><h4>x</h4>
<table><tr><th>A</th><th>A</th><th></th></tr><tr><td>1</td><td> 2 </td></tr>
<tr><td></td><td>b<br>c</td><td>z</td></tr></table><table></table><table><tr><td>q</td></tr></table></html>"""


def test_page_record(spark):
    df = spark.createDataFrame([(1, "u", PAGE)], "page_id int, url string, html string")
    row = pg.page_table_preview(pg.page_headings(pg.page_title(df))).first()
    assert row.title == "A B & C"
    assert row.headings == ["One two", "Two"]
    assert row.table_previews == [
        [{"A": "1", "A_2": "2", "column_3": None}, {"A": None, "A_2": "b c", "column_3": "z"}],
        [{"column_1": "q"}],
    ]


def test_preview_limits_and_colliding_headers(spark):
    head = "<tr><th>A</th><th>A</th><th>A_2</th></tr>"
    body = "".join(f"<tr><td>{i}</td><td>x</td><td>y</td></tr>" for i in range(9))
    wide = "<table><tr>" + "".join(f"<td>{i}</td>" for i in range(20)) + "</tr></table>"
    df = spark.createDataFrame([("<table>" + head + body + "</table>" + wide * 8,)], "html string")
    tables = pg.page_table_preview(df).first().table_previews
    assert len(tables) == 5 and len(tables[0]) == 5
    assert tables[0][0] == {"A": "0", "A_2": "y"}
    assert len(tables[1][0]) == 12


def test_long_title_and_heading_cap(spark):
    text = "<title>" + "x" * 400 + "</title>" + "".join(f"<h2>h{i}</h2>" for i in range(60))
    df = spark.createDataFrame([(text,)], "html string")
    row = pg.page_headings(pg.page_title(df)).first()
    assert len(row.title) == 300 and row.title.endswith("…")
    assert len(row.headings) == 40


def test_failed_pages_keep_a_row(spark):
    df = spark.createDataFrame(
        [("a", 200, "text/html"), ("b", 500, "text/html"), ("c", 200, "application/pdf"), ("d", 200, ""), ("e", None, None)],
        "source_id string, status_code int, content_type string",
    )
    got = {r.source_id: r.error for r in pg.content_gate(df).collect()}
    assert got["a"] is None and got["d"] is None
    assert all(got[x] for x in "bce") and len(got) == 5


RECENT = """<div class="panel panel-default"><div class="panel-heading"><h4><a>2026 FOMC Meetings</a></h4></div>
<div class="row fomc-meeting"><div class="fomc-meeting__month col"><strong>January</strong></div><div class="fomc-meeting__date">27-28*</div></div>
<div class="fomc-meeting--shaded row fomc-meeting"><div class="fomc-meeting__month">Apr/May</div><div class="fomc-meeting__date">30-1</div><div>x</div></div>
<div class="fomc-meeting"><div class="fomc-meeting__month">March</div><div class="fomc-meeting__date">3 (unscheduled)</div></div>
<div class="fomc-meeting"><div class="fomc-meeting__month">March</div><div class="fomc-meeting__date">9 (notation vote)</div></div>
</div> notation vote unscheduled <div class="panel panel-default"><h4>2025 FOMC Meetings</h4>
<div class="fomc-meeting"><div class="fomc-meeting__month">December</div><div class="fomc-meeting__date">9-10</div></div></div>"""
ARCHIVE = """<h5>January 29-30 Meeting - 2008</h5><a href="x">Minutes</a><h5>March 10 (unscheduled) Meeting - 2008</h5>
<h5>January 9 Conference Call - 2008</h5><a>Other</a><h5>January 21 Conference Call - 2008</h5><p><a>Statement</a></p>
<h5>Contents</h5><h5>April/May 30-1 Meeting - 2008</h5><h5>June 3 Meeting - 2007</h5>"""


def events(df):
    return sorted((r.event_date, r.is_scheduled) for r in df.collect())


def test_recent_and_archive_calendars(spark):
    recent = spark.createDataFrame([("u", RECENT)], "url string, html string")
    got = events(pg.events_from_recent_pages(recent))
    assert got == [(D(2025, 12, 10), True), (D(2026, 1, 28), True), (D(2026, 3, 3), False), (D(2026, 5, 1), True)]
    old = spark.createDataFrame([("h", 2008, ARCHIVE), ("h", 2025, ARCHIVE)], "url string, year int, html string")
    got = events(pg.events_from_archive_pages(old.where("year = 2008")))
    assert got == [(D(2008, 1, 21), False), (D(2008, 1, 30), True), (D(2008, 3, 10), False), (D(2008, 5, 1), True)]
    merged = pg.event_calendar_merge(
        pg.events_from_recent_pages(recent, start_year=2008, end_year=2025), old, pg.recent_years(recent),
        start_year=2008, end_year=2025,
    )
    assert len(events(merged)) == 5


def test_unreadable_and_repeated_dates_are_shown(spark):
    bad = "<h5>Foo-bar Meeting - 2008</h5><h5>June 3 Meeting - 2008</h5><h5>June 2-3 Meeting - 2008</h5><h5>July 8 Meeting - 2008</h5>"
    old = spark.createDataFrame([("h", 2008, bad)], "url string, year int, html string")
    none = pg.events_from_recent_pages(spark.createDataFrame([], "url string, html string"))
    kw = dict(start_year=2008, end_year=2008)
    years = spark.createDataFrame([], "year int")
    good, rejected = pg.event_calendar_merge(none, old, years, **kw, on_violation="quarantine")
    assert [r.event_date for r in good.collect()] == [D(2008, 7, 8)]
    assert sorted((r.event_date or D(1, 1, 1), r.broken_rules) for r in rejected.collect()) == [
        (D(1, 1, 1), ["readable:event_date"]),
        (D(2008, 6, 3), ["unique:event_date"]),
        (D(2008, 6, 3), ["unique:event_date"]),
    ]
    with pytest.raises(RuleViolation):
        pg.event_calendar_merge(none, old, years, **kw, on_violation="raise")


def test_limits_are_parameters_and_totals_are_shown(spark):
    table = "<table><tr><th>a</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    df = spark.createDataFrame([("<h1>x</h1><h2>y</h2>" + table * 7,), (None,)], "html string")
    out = pg.page_totals(pg.page_table_preview(df, max_tables=2, max_rows=1)).collect()
    assert [(r.headings_found, r.tables_found) for r in out] == [(2, 7), (0, 0)]
    assert [[len(t) for t in (r.table_previews or [])] for r in out] == [[1, 1], []]
