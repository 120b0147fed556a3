"""Records from tables of raw pages, as column expressions over ``html``.

Markup is read with regular expressions: well-formed elements in any order and
nesting of inline tags are handled.  Tables are read from the sequence of their tags,
with a depth, so that a table within a cell is a table of its own and its cells are not
those of the row around it; cells and rows may be left unclosed.  Input columns:
``page_id, url, html``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.dates import parse_decision_date
from ..functions.text import (
    drop_non_text,
    empty_to_null,
    let,
    limit_text,
    markup_to_text,
    source_url_valid,
    strip_whitespace,
)
from ..sources.storage import staged
from .quality import Rule, Unique, expect

# Fixed patterns of the elements read.
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_HEADING = r"(?is)<h[123]\b[^>]*>(.*?)</h[123]\s*>"
_TABLE = r"(?i)<table\b[^>]*>"
_TABLE_TAG = r"(?i)</?(?:table|tr|t[dh])\b[^>]*>"
# The same tags with the start of their names, and what each of them is: T and t open
# and close a table, R and r a row; C and H open a cell, c closes one.
_TABLE_TAG_NAME = r"(?i)<(/?t(?:a(?=ble\b)|[rdh]\b))[^>]*>"
_TAG_KINDS = {"ta": "T", "/ta": "t", "tr": "R", "/tr": "r", "td": "C", "th": "H", "/td": "c", "/th": "c"}


def title_of(html: Column) -> Column:
    # A title is plain text, so tags inside it are dropped only as separators.
    raw = F.regexp_extract(drop_non_text(html), _TITLE, 1)
    return empty_to_null(limit_text(markup_to_text(raw), K.MAX_TITLE_CHARS))


def headings_of(html: Column, cap: int = K.MAX_HEADINGS) -> Column:
    raw = F.regexp_extract_all(drop_non_text(html), F.lit(_HEADING), F.lit(1))
    texts = F.transform(raw, lambda h: limit_text(markup_to_text(h), K.MAX_HEADING_CHARS))
    return F.slice(F.array_distinct(F.filter(texts, lambda t: t != "")), 1, cap)


def page_title(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """Add ``title``: first title text, normalised and limited, NULL if empty."""
    return pages.withColumn("title", title_of(F.col(html)))


def page_headings(pages: DataFrame, *, html: str = "html", cap: int = K.MAX_HEADINGS) -> DataFrame:
    """Add ``headings``: distinct h1-h3 texts in document order."""
    return pages.withColumn("headings", headings_of(F.col(html), cap))


def _header_names(header: Column, count: Column) -> Column:
    """Column names: header text or ``column_n``; repeats get ``_2``, ``_3``, ..."""
    base = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.coalesce(
            empty_to_null(F.try_element_at(header, i)),
            F.concat(F.lit("column_"), i.cast("string")),
        ),
    )

    def number(names: Column) -> Column:
        def numbered(name: Column, i: Column) -> Column:
            seen = F.size(F.filter(F.slice(names, 1, i + 1), lambda x: x == name))
            return F.when(seen > 1, F.concat_ws("_", name, seen.cast("string"))).otherwise(name)

        return F.transform(names, numbered)

    return let(base, number)


def _record(names: Column, cells: Column) -> Column:
    """One row as a map; short rows give NULLs.

    A suffixed name may equal another header text; the last column wins.
    """

    def record(unique: Column) -> Column:
        def value(name: Column, i: Column) -> Column:
            last = F.array_max(F.transform(names, lambda n, j: F.when(n == name, j + 1)))
            at = F.when(F.size(unique) == F.size(names), i + 1).otherwise(last)
            return empty_to_null(limit_text(F.try_element_at(cells, at), K.MAX_CELL_CHARS))

        return F.map_from_arrays(unique, F.transform(unique, value))

    return let(F.array_distinct(names), record)


def _preview(rows: Column, max_rows: int, max_columns: int) -> Column:
    """Records of one table given as ``array<struct<th, cells>>``; may be empty."""
    has_header = F.coalesce(F.try_element_at(rows, F.lit(1))["th"], F.lit(False))
    no_cells = F.array().cast("array<string>")
    parts = F.struct(
        F.when(
            has_header,
            F.transform(
                F.element_at(rows, 1)["cells"], lambda c: limit_text(c, K.MAX_HEADING_CHARS)
            ),
        )
        .otherwise(no_cells)
        .alias("header"),
        F.slice(rows, F.when(has_header, 2).otherwise(1), max_rows).alias("data"),
    )

    def named(p: Column) -> Column:
        widest = F.aggregate(
            p["data"], F.size(p["header"]), lambda n, r: F.greatest(n, F.size(r["cells"]))
        )
        count = F.least(widest, F.lit(max_columns))
        names = let(
            count, lambda n: F.when(n > 0, _header_names(p["header"], n)).otherwise(no_cells)
        )
        return F.struct(names.alias("names"), p["data"].alias("data"))

    def build(p: Column) -> Column:
        empty = F.array().cast("array<map<string,string>>")
        records = F.transform(p["data"], lambda r: _record(p["names"], r["cells"]))
        return F.when(F.size(p["names"]) > 0, records).otherwise(empty)

    return let(let(parts, named), build)


def page_totals(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """Add ``headings_found`` and ``tables_found``: how many there are before any limit."""
    text = drop_non_text(F.col(html))
    found = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    return pages.withColumns({"headings_found": found(_HEADING), "tables_found": found(_TABLE)})


def page_table_preview(
    pages: DataFrame,
    *,
    html: str = "html",
    max_tables: int = K.MAX_TABLES,
    max_rows: int = K.MAX_TABLE_ROWS,
    max_columns: int = K.MAX_TABLE_COLUMNS,
) -> DataFrame:
    """Add ``table_previews``: the leading rows of the first few tables.

    The limits are those of the published records; ``page_totals`` says how many
    tables a page has.  A header row is used if the first row has a header cell; short rows give
    NULLs; tables without cells or without data rows are left out.
    """
    def read(document: Column) -> Column:
        tokens = F.struct(
            F.transform(F.regexp_extract_all(document, F.lit(_TABLE_TAG_NAME), F.lit(1)), _tag_kind).alias("kinds"),
            F.split(document, _TABLE_TAG, -1).alias("texts"),
        )
        return let(tokens, lambda t: let(_marked(t), lambda m: _tables(m, max_tables, max_rows, max_columns)))

    tables = let(drop_non_text(F.col(html)), read)
    previews = F.transform(tables, lambda t: _preview(t, max_rows, max_columns))
    return pages.withColumn("table_previews", F.filter(previews, lambda p: F.size(p) > 0))


def _tag_kind(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in _TAG_KINDS.items() for x in pair])
    return F.element_at(kinds, F.lower(name))


def _marked(tokens: Column) -> Column:
    """Tags and texts with the places (from 1) where tables and rows open or end."""
    kinds = tokens["kinds"]

    def places(*which: str) -> Column:
        return F.array_compact(F.transform(kinds, lambda k, i: F.when(k.isin(*which), i + 1)))

    def table_tag(kind: Column, i: Column) -> Column:
        by = F.when(kind == "T", 1).otherwise(-1)
        return F.when(kind.isin("T", "t"), F.struct((i + 1).alias("at"), by.alias("by")))

    past = F.size(kinds) + 1

    def rows(ends: Column) -> Column:
        def row(at: Column, i: Column) -> Column:
            end = F.coalesce(F.get(ends, i + 1), past)
            return F.when(F.element_at(kinds, at) == "R", F.struct(at.alias("at"), end.alias("end")))

        return F.array_compact(F.transform(ends, row))

    return F.struct(
        kinds.alias("kinds"),
        tokens["texts"].alias("texts"),
        F.array_compact(F.transform(kinds, table_tag)).alias("tables"),
        places("T").alias("opens"),
        # A row without a table in it ends at the next one of these.
        let(places("R", "r", "t"), rows).alias("rows"),
        past.alias("past"),
    )


def _tables(m: Column, max_tables: int, max_rows: int, max_columns: int) -> Column:
    """The first tables in document order, each ``array<struct<th, cells>>``: the rows
    in it, those of tables within it too, with their own cells."""

    def table_end(open_at: Column) -> Column:
        def step(s: Column, tag: Column) -> Column:
            # A table that is never closed ends with the document.
            moved = F.struct(
                (s["depth"] + tag["by"]).alias("depth"),
                F.when(s["depth"] + tag["by"] == 0, tag["at"]).otherwise(s["end"]).alias("end"),
            )
            return F.when(s["depth"] > 0, moved).otherwise(s)

        start = F.struct(F.lit(1).alias("depth"), m["past"].alias("end"))
        after = F.filter(m["tables"], lambda t: t["at"] > open_at)
        return F.aggregate(after, start, step, lambda s: s["end"])

    def table(open_at: Column) -> Column:
        def rows(end: Column) -> Column:
            own = F.filter(m["rows"], lambda r: (r["at"] > open_at) & (r["at"] < end))
            return F.transform(F.slice(own, 1, max_rows + 1), lambda r: _row(m, r, end, max_columns))

        return let(table_end(open_at), rows)

    return F.transform(F.slice(m["opens"], 1, max_tables), table)


def _row(m: Column, row: Column, table_end: Column, max_columns: int) -> Column:
    """Whether a row has a header cell, and the texts of its cells."""
    at, plain_end = row["at"], row["end"]

    def texts(cells: Column) -> Column:
        # The text after a tag is one place further on than the tag.
        inside = lambda c: F.array_join(F.slice(m["texts"], c["open"] + 1, c["end"] - c["open"]), " ")
        return F.struct(
            F.exists(cells, lambda c: c["th"]).alias("th"),
            F.transform(cells, lambda c: markup_to_text(inside(c))).alias("cells"),
        )

    nested = F.exists(m["opens"], lambda o: (o > at) & (o < plain_end))
    cells = F.when(nested, _cells_around_tables(m, at, table_end, max_columns)).otherwise(
        _cells_between(m, at, plain_end, max_columns)
    )
    return let(cells, texts)


def _cells_between(m: Column, row: Column, end: Column, max_columns: int) -> Column:
    """Cells of a row without a table in it: each ends at the very next tag."""

    def cell(kind: Column, i: Column) -> Column:
        at = row + i + 1
        return F.when(
            kind.isin("C", "H"),
            F.struct(at.alias("open"), (at + 1).alias("end"), (kind == "H").alias("th")),
        )

    kinds = F.slice(m["kinds"], row + 1, end - row - 1)
    return F.slice(F.array_compact(F.transform(kinds, cell)), 1, max_columns)


def _cells_around_tables(m: Column, row: Column, table_end: Column, max_columns: int) -> Column:
    """Cells of a row with tables in it, read tag by tag with the depth."""

    def step(s: Column, kind: Column) -> Column:
        here = ~s["done"] & (s["depth"] == 0)
        at = s["at"] + 1
        ends = here & kind.isin("R", "r", "t", "C", "H", "c")
        closed = ends & (s["open"] > 0) & (F.size(s["cells"]) < max_columns)
        cell = F.struct(s["open"].alias("open"), at.alias("end"), s["th"].alias("th"))
        begins = here & kind.isin("C", "H")
        return F.struct(
            at.alias("at"),
            (s["depth"] + F.when(s["done"], 0).when(kind == "T", 1).when(~here & (kind == "t"), -1).otherwise(0)).alias("depth"),
            (s["done"] | (here & kind.isin("R", "r", "t"))).alias("done"),
            F.when(begins, at).when(ends, 0).otherwise(s["open"]).alias("open"),
            F.when(begins, kind == "H").otherwise(s["th"]).alias("th"),
            F.when(closed, F.concat(s["cells"], F.array(cell))).otherwise(s["cells"]).alias("cells"),
        )

    none = F.array().cast("array<struct<open:int,end:int,th:boolean>>")
    start = F.struct(
        row.cast("int").alias("at"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("done"),
        F.lit(0).alias("open"),
        F.lit(False).alias("th"),
        none.alias("cells"),
    )

    def finish(s: Column) -> Column:
        # A cell that is never closed ends with the document.
        open_cell = F.struct(s["open"].alias("open"), m["past"].alias("end"), s["th"].alias("th"))
        whole = (s["open"] == 0) | (F.size(s["cells"]) >= max_columns)
        return F.when(whole, s["cells"]).otherwise(F.concat(s["cells"], F.array(open_cell)))

    last = F.least(table_end, m["past"] - 1)
    return F.aggregate(F.slice(m["kinds"], row + 1, F.greatest(last - row, F.lit(0))), start, step, finish)


def validate_source(
    df: DataFrame, *, source_id: str = "source_id", category: str = "category", url: str = "url"
) -> DataFrame:
    """Trim the three fields and add ``source_error`` (NULL if the source is valid)."""
    trimmed = df.withColumns({c: strip_whitespace(F.col(c)) for c in (source_id, category, url)})
    error = F.lit(None).cast("string")
    error = F.when(~source_url_valid(F.col(url)), "invalid url").otherwise(error)
    for c in (url, category, source_id):
        error = F.when(F.coalesce(F.col(c) == "", F.lit(True)), f"blank {c}").otherwise(error)
    return trimmed.withColumn("source_error", error)


def duplicate_source_ids(df: DataFrame, *, source_id: str = "source_id") -> DataFrame:
    """Source ids that occur more than once."""
    return df.groupBy(source_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def content_gate(
    df: DataFrame, *, status: str = "status_code", content_type: str = "content_type"
) -> DataFrame:
    """Add ``error`` for a failed status or a non-HTML type; no row is dropped."""
    kind = F.lower(F.coalesce(F.col(content_type), F.lit("")))
    failed = F.col(status) >= 400
    error = (
        F.when(F.col(status).isNull(), "no response")
        .when(failed, F.concat(F.lit("HTTP status "), F.col(status).cast("string")))
        .when((kind != "") & ~kind.contains("html"), F.concat(F.lit("expected HTML but received "), kind))
    )
    return df.withColumn("error", error)


def page_records(pages: DataFrame) -> DataFrame:
    """Full page record; failed pages keep a row with their error and no content.

    Input: ``source_id, category, url, fetched_at_utc, status_code, content_type, html``.
    """
    gated = content_gate(pages)
    full = page_table_preview(page_headings(page_title(gated)))
    ok = F.col("error").isNull()
    return full.select(
        "source_id",
        "category",
        "url",
        "fetched_at_utc",
        "status_code",
        F.when(ok, F.col("title")).alias("title"),
        F.when(ok, F.col("headings")).otherwise(F.array().cast("array<string>")).alias("headings"),
        F.when(ok, F.col("table_previews"))
        .otherwise(F.array().cast("array<array<map<string,string>>>"))
        .alias("table_previews"),
        "error",
    )


PAGE_RECORD_COLUMNS = (
    "source_id",
    "category",
    "url",
    "fetched_at_utc",
    "status_code",
    "title",
    "headings",
    "table_previews",
    "error",
)


def coverage_report(records: DataFrame) -> DataFrame:
    """Succeeded and failed counts; ``failed_sources`` lists the failures."""
    return records.agg(
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def failed_sources(records: DataFrame) -> DataFrame:
    return records.where(F.col("error").isNotNull()).select("source_id", "error")


def coverage_summary(records: DataFrame) -> DataFrame:
    """Flat summary: the scalars with heading and table counts."""
    return records.select(
        "source_id",
        "category",
        "url",
        "fetched_at_utc",
        "status_code",
        "title",
        F.size("headings").alias("heading_count"),
        F.size("table_previews").alias("table_count"),
        "error",
    )


# --- event calendars ---------------------------------------------------------


def _class_div(name: str) -> str:
    """Opening div tag carrying the given class token."""
    return (
        r"(?is)<div\b(?=[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?%s(?:\s[^\"']*)?[\"'])[^>]*>" % name
    )


def _balanced_div(inner: Column) -> Column:
    """``inner`` up to the end tag of the div that was opened just before it."""
    # After the space in front, a piece that starts with a bracket starts with a div tag.
    pieces = F.split(F.concat(F.lit(" "), inner), r"(?i)(?=<(?:div\b|/div\s*>))", -1)

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.startswith("</"), -1).when(piece.startswith("<"), 1).otherwise(0)
        return F.when(
            acc["depth"] > 0, let(depth, lambda d: F.struct(d.alias("depth"), (acc["n"] + (d > 0).cast("int")).alias("n")))
        ).otherwise(acc)

    def text(p: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
        live = F.aggregate(p, start, step, lambda acc: acc["n"])
        return F.array_join(F.slice(p, 1, live), "")

    return let(let(pieces, text), lambda t: t.substr(F.lit(2), F.length(t)))


def _after_each(html: Column, opening: str) -> Column:
    """Text following each occurrence of an opening tag, up to the next one."""
    return F.filter(F.split(html, opening, -1), lambda _, i: i > 0)


def _inner_of_class(html: Column, name: str) -> Column:
    """Text of the first element with the given class, inline children included."""
    pattern = (
        r"(?is)<(\w+)\b(?=[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?%s(?:\s[^\"']*)?[\"'])[^>]*>"
        r".*?</\1\s*>" % name
    )
    # The outer tags come off the match, so that the page is searched once.
    inner = lambda e: F.regexp_extract(e, r"(?s)^[^>]*>(.*)</\w+\s*>$", 1)
    return let(F.regexp_extract(html, pattern, 0), lambda e: F.when(e != "", markup_to_text(inner(e))))


_PANEL_OPEN = (
    r"(?is)<div\b(?=[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?panel(?:\s[^\"']*)?[\"'])"
    r"(?=[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?panel-default(?:\s[^\"']*)?[\"'])[^>]*>"
)
_H4 = r"(?is)<h4\b[^>]*>(.*?)</h4\s*>"


def _year_panels(pages: DataFrame, body) -> DataFrame:
    """``(source_url, year, body)`` per yearly panel.

    All markup is read inside one array expression and exploded afterwards, so
    that later filters work on plain columns.  The outer form of explode is used
    because for the inner one the optimizer adds a filter on the array, which
    would read the markup again.
    """

    def panel(tail: Column) -> Column:
        def read(inner: Column) -> Column:
            heading = markup_to_text(F.regexp_extract(inner, _H4, 1))
            return F.struct(
                F.regexp_extract(heading, K.PANEL_TITLE, 1).alias("year"), body(inner).alias("body")
            )

        return let(_balanced_div(tail), read)

    panels = F.transform(_after_each(drop_non_text(F.col("html")), _PANEL_OPEN), panel)
    return (
        pages.select(F.col("url").alias("source_url"), F.explode_outer(panels).alias("_p"))
        .where(F.col("_p").isNotNull() & (F.col("_p.year") != ""))
        .select("source_url", F.col("_p.year").cast("int").alias("year"), F.col("_p.body").alias("body"))
    )


def recent_years(pages: DataFrame) -> DataFrame:
    """Years that have a panel, also when the panel lists no event."""
    return _year_panels(pages, lambda inner: F.lit(None).cast("string")).select("year").distinct()


def _meeting_rows(panel: Column) -> Column:
    def row(inner: Column) -> Column:
        return F.struct(
            _inner_of_class(inner, "fomc-meeting__month").alias("month"),
            _inner_of_class(inner, "fomc-meeting__date").alias("date"),
            F.lower(markup_to_text(inner)).alias("text"),
        )

    tails = _after_each(panel, _class_div("fomc-meeting"))
    return F.transform(tails, lambda t: let(_balanced_div(t), row))


def events_from_recent_pages(
    pages: DataFrame, *, start_year: int | None = None, end_year: int | None = None
) -> DataFrame:
    """Events from pages with one panel per year; columns ``url, html``.

    Rows that are notation votes are skipped.  ``event_date`` is NULL where the
    date cannot be read (check it with ``event_date_rules``).
    """
    panels = _year_panels(pages, _meeting_rows)
    if start_year is not None:
        panels = panels.where(F.col("year") >= start_year)
    if end_year is not None:
        panels = panels.where(F.col("year") <= end_year)
    rows = panels.select("source_url", "year", F.explode_outer("body").alias("_r")).where(
        F.col("_r.month").isNotNull()
        & F.col("_r.date").isNotNull()
        & ~F.col("_r.text").contains("notation vote")
    )
    days = F.trim(F.regexp_replace("_r.date", r"\([^)]*\)|\*", ""))
    return rows.select(
        parse_decision_date(F.col("year"), F.col("_r.month"), days).alias("event_date"),
        (~F.col("_r.text").contains("unscheduled")).alias("is_scheduled"),
        "source_url",
    )


def events_from_archive_pages(pages: DataFrame) -> DataFrame:
    """Events from yearly archive pages; columns ``url, year, html``.

    Headings read "<date> Meeting - <year>" or "<date> Conference Call - <year>".
    A call counts only if a link named "Statement" follows before the next
    heading.  ``event_date`` is NULL where a heading cannot be read.
    """
    anchor = r"(?is)<a\b[^>]*>(.*?)</a\s*>"

    def section(part: Column) -> Column:
        links = F.regexp_extract_all(part, F.lit(anchor), F.lit(1))
        return F.struct(
            markup_to_text(F.regexp_extract(part, r"(?is)^(.*?)</h5\s*>", 1)).alias("heading"),
            F.exists(links, lambda a: F.lower(markup_to_text(a)) == "statement").alias("statement"),
        )

    sections = F.transform(
        _after_each(drop_non_text(F.col("html")), r"(?i)<h5\b[^>]*>"), section
    )
    parts = pages.select(
        F.col("url").alias("source_url"), "year", F.explode_outer(sections).alias("_s")
    ).where(F.col("_s").isNotNull())
    group = lambda i: F.regexp_extract("_s.heading", K.ARCHIVE_HEADING, i)
    read = parts.select(
        "source_url",
        "year",
        group(1).alias("_raw"),
        F.lower(group(2)).alias("_kind"),
        group(3).alias("_year"),
        F.col("_s.statement").alias("_statement"),
    ).where(
        (F.col("_year") == F.col("year").cast("string"))
        & ((F.col("_kind") == "meeting") | F.col("_statement"))
    )
    clean = F.trim(F.regexp_replace("_raw", r"\([^)]*\)", ""))
    shape = r"^([A-Za-z]+(?:/[A-Za-z]+)?)\s+(.+)$"
    return read.select(
        parse_decision_date(
            F.col("year"), F.regexp_extract(clean, shape, 1), F.regexp_extract(clean, shape, 2)
        ).alias("event_date"),
        ((F.col("_kind") == "meeting") & ~F.lower("_raw").contains("unscheduled")).alias(
            "is_scheduled"
        ),
        "source_url",
    )


def event_date_rules() -> list:
    """Every event has a date that could be read, and no date stands twice."""
    return [
        Rule("readable:event_date", F.col("event_date").isNull()),
        Unique("unique:event_date", ["event_date"]),
    ]


def event_calendar_merge(
    recent: DataFrame,
    archive_pages: DataFrame,
    years_seen: DataFrame,
    *,
    start_year: int,
    end_year: int,
    on_violation: str = "raise",
):
    """Both layouts as one calendar; archive pages of years seen are not read.

    Events with a date outside the years are left out; events whose date could
    not be read stay, with a NULL date.  ``on_violation`` checks
    ``event_date_rules``: ``raise`` stops, ``quarantine`` returns good and
    rejected events, ``report`` the counts, ``none`` returns all events unchecked.
    Events to check are written once, as the checks pass over them several times and
    each pass would read the pages again.
    """
    # A handful of years, so the pages themselves are not moved to meet them.
    years = F.broadcast(years_seen.select("year").distinct())
    unseen = archive_pages.where(F.col("year").between(start_year, end_year)).join(
        years, "year", "left_anti"
    )
    merged = recent.unionByName(events_from_archive_pages(unseen))
    if on_violation != "none":
        merged = staged(merged, "merged_events")
    year = F.year("event_date")
    inside = merged.where(year.isNull() | year.between(start_year, end_year))
    if on_violation == "none":
        return inside
    return expect(inside, event_date_rules(), on_violation=on_violation)
