"""Lexical search against brute force; the graph of shared sums."""

import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import lexical
from panelspark.llm.common import table
from panelspark.llm.queries import op12_lexical_search

from .conftest import ODD

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, rank string, score string, doc_id string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(rows, items, top=50):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_all, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in docs:
            m = 100 - 50 + (50 * c.total() * n_all) // total
            s = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in own
                if c[t]
            )
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:top])]
    return Counter(out)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in df.collect())


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in items], ITEMS)


QUESTIONS = [
    (1, "one two three"), (2, "Same text ONE"), (2, "six"), (3, None), (4, ""), (None, "word xx same"),
    (5, "É tabs 😀"), (6, "unknown"), (7, "id id id"), (8, "word " * 60_000 + "x" * 300_000),
]


def test_odd_rows_and_items(spark, make_docs):
    got = found(lexical.search(make_docs(ODD), item_frame(spark, QUESTIONS)))
    assert got == by_hand([r[:2] for r in ODD], QUESTIONS)
    assert {r[0] for r in got} >= {1, 2, 5, 8, None}


def test_empty_tables(spark, make_docs):
    assert lexical.search(make_docs([]), item_frame(spark, QUESTIONS)).count() == 0
    assert lexical.search(make_docs(ODD), item_frame(spark, [])).count() == 0
    assert lexical.search(make_docs([(1, None), (2, "!")]), item_frame(spark, QUESTIONS)).count() == 0


def test_several_blocks_and_waves_and_small_batches(spark, make_docs, monkeypatch):
    rnd = random.Random(3)
    words = [f"t{i}" for i in range(40)]
    rows = [(i % 90, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(120)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(23)]
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 30)
    monkeypatch.setattr(lexical, "WAVE_BLOCKS", 2)
    monkeypatch.setattr(lexical, "CELLS", 200)
    got = found(lexical.search(make_docs(rows), item_frame(spark, items), top=7))
    assert got == by_hand(rows, items, top=7)


def test_the_given_tables(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert found(op12_lexical_search(spark, SF)) == by_hand(rows, items)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=9), min_size=1, max_size=12))
def test_every_term_reaches_its_items_once(sets):
    graph = lexical.mine([(k, {str(t).encode() for t in s}) for k, s in enumerate(sets)])
    parts = [Counter(leaf) for leaf in graph.leaves] + [None] * (graph.n_parts - len(graph.leaves))
    for new, a, b in graph.levels:
        for n, x, y in zip(new, a, b, strict=True):
            assert parts[n] is None
            parts[n] = parts[x] + parts[y]
    for s, top in zip(sets, graph.tops, strict=True):
        assert sum((parts[p] for p in top), Counter()) == Counter(str(t).encode() for t in s)


def test_shared_sums_are_computed_once():
    # 20 items of 10 common terms, 10 of them with 10 more, and a term of their own.
    common, more = [b"c%d" % i for i in range(10)], [b"m%d" % i for i in range(10)]
    items = [(k, {*common, *(more if k % 2 else []), b"own%d" % k}) for k in range(20)]
    graph = lexical.mine(items)
    assert len(graph.leaves) == 22  # the two shared sets are one leaf each
    additions = sum(len(new) for new, _, _ in graph.levels) + sum(len(top) - 1 for top in graph.tops)
    assert additions == 21  # the two shared sets are added once, not by ten items
