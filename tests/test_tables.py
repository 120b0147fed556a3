"""Tables within tables, unclosed cells and rows, against a tree built by hand."""

import random
import time
from html.parser import HTMLParser

from panelspark.operators import pages as pg


class Tree(HTMLParser):
    """Tables, rows and cells as a browser nests them: an opened cell closes the one
    before it in the same table, an opened row closes row and cell."""

    def __init__(self):
        super().__init__()
        self.stack = [{"kind": "root", "kids": [], "text": []}]
        self.tables, self.rows = [], []

    def close(self, *kinds):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k]["kind"] in kinds:
                del self.stack[k:]
                return
            if self.stack[k]["kind"] == "table":
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "th"):
            self.close("td", "th")
        elif tag == "tr":
            self.close("tr")
        if tag in ("table", "tr", "td", "th"):
            # Text of a place counts for all that are open around it.
            node = {"kind": tag, "kids": [], "text": []}
            self.stack[-1]["kids"].append(node)
            for table in (x for x in self.stack if x["kind"] == "table"):
                if tag == "tr":
                    table.setdefault("rows", []).append(node)
            self.stack.append(node)
            if tag == "table":
                node["rows"] = []
                self.tables.append(node)

    def handle_endtag(self, tag):
        if tag == "table":
            while len(self.stack) > 1 and self.stack.pop()["kind"] != "table":
                pass
        elif tag in ("td", "th", "tr"):
            self.close(*(("td", "th") if tag != "tr" else ("tr",)))

    def handle_data(self, data):
        for node in self.stack:
            node["text"].append(data)


def by_hand(html):
    tree = Tree()
    tree.feed(html)
    out = []
    for table in tree.tables[:5]:
        rows = table["rows"][:6]
        cells = [[k for k in r["kids"] if k["kind"] in ("td", "th")] for r in rows]
        header = bool(cells) and any(c["kind"] == "th" for c in cells[0])
        text = lambda c: " ".join(" ".join(c["text"]).split())
        data = cells[1:] if header else cells[:5]
        width = min(12, max([len(cells[0]) if header else 0, *map(len, data)], default=0))
        if not width or not data:
            continue
        names, seen = [], {}
        for i in range(width):
            base = text(cells[0][i]) if header and i < len(cells[0]) and text(cells[0][i]) else f"column_{i + 1}"
            seen[base] = seen.get(base, 0) + 1
            names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
        out.append([{n: (text(c[i]) or None) if i < len(c) else None for i, n in enumerate(names)} for c in data])
    return out


def preview(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return {r.i: r.table_previews for r in pg.page_table_preview(df).collect()}


def random_table(rnd, depth):
    rows = []
    for _ in range(rnd.randint(0, 7)):
        cells = []
        for _ in range(rnd.randint(0, 4)):
            tag = rnd.choice(["td", "td", "th"])
            inner = rnd.choice(["", "a", " b ", "<b>c</b> d", "e"])
            if depth and rnd.random() < 0.25:
                inner += " x " + random_table(rnd, depth - 1) + " y "
            cells.append(f"<{tag} class='q'>{inner}" + ("" if rnd.random() < 0.3 else f"</{tag}>"))
        rows.append("<TR>" + rnd.choice(["", " "]).join(cells) + ("" if rnd.random() < 0.3 else "</tr >"))
    return "<table id=1><tbody>" + "".join(rows) + "</tbody></table>"


def test_nested_and_unclosed_tables(spark):
    rnd = random.Random(4)
    pages = ["<p>z</p>" + "".join(random_table(rnd, 2) for _ in range(rnd.randint(0, 3))) + "end" for _ in range(250)]
    pages.append("<table><tr><td>open<td>cells<tr><td>of an unclosed table")
    got = preview(spark, pages)
    for i, page in enumerate(pages):
        assert got[i] == by_hand(page), page


def test_a_table_in_a_cell_is_not_mixed_with_the_row_around_it(spark):
    inner = "<table><tr><th>in</th></tr><tr><td>1</td></tr></table>"
    page = f"<table><tr><td>a</td><td>b {inner} c</td><td>d</td></tr></table>"
    outer, own = preview(spark, [page])[0]
    assert outer[0] == {"column_1": "a", "column_2": "b in 1 c", "column_3": "d"}
    assert own == [{"in": "1"}]


def test_a_very_long_page_takes_linear_time(spark):
    rows = "<tr>" + "<td>cell</td>" * 5 + "</tr>"
    nested = "<table>" + rows * 20 + "</table>"
    times = []
    for n in (2_000, 8_000):
        page = "<table>" + rows * n + "<tr><td>" + nested + "</td></tr></table>" + nested * 3
        start = time.perf_counter()
        tables = preview(spark, [page])[0]
        times.append(time.perf_counter() - start)
        assert len(tables) == 5 and tables[0][0] == {f"column_{i}": "cell" for i in range(1, 6)}
    assert times[1] < 8 * times[0] + 5
