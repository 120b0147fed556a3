"""Filter audit against brute force over rows and orders."""

import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import audit
from panelspark.llm.common import table
from panelspark.llm.queries import op11_filter_audit

from .conftest import ODD

SF = "/root/testdata/sf0.001"
COLUMNS = [
    "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
]
LABELS = "doc_id long, quality int, toxic int, kept string"


def failed(text, doc_id, ids):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    known = [i for i in ids if i is not None]
    if known and (doc_id is None or min(known) < doc_id):
        out.add("E")
    return out


def by_hand(rows, labels):
    """``rows``: (doc_id, text, source); ``labels``: (doc_id, quality, toxic)."""
    ids = {}
    for doc_id, text, _ in rows:
        ids.setdefault(text or "", []).append(doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for doc_id, text, source in rows:
        parts.setdefault(source or "", []).append((failed(text or "", doc_id, ids[text or ""]), doc_id))
    out = []
    for part, docs in parts.items():
        lines, shapley = [], Counter()
        for order in permutations("ABCDE"):
            alive = docs
            for k, f in enumerate(order):
                lost = [d for d in alive if f in d[0]]
                alive = [d for d in alive if f not in d[0]]
                shapley[f] += len(lost)
                lines.append((
                    part, "".join(order), k + 1, len(alive), len(lost),
                    sum(f in d[0] for d in docs) - len(lost), sum(d[0] == {f} for d in docs),
                    sum(d[1] in good for d in lost), sum(d[1] in toxic for d in lost), f,
                ))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return Counter(out)


def found(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LABELS)


ROWS = [(r[0], r[1], r[2] if len(r) > 2 else "a") for r in ODD]
MARKS = [(1, 1, 0), (3, 0, 1), (4, 1, 1), (4, None, None), (8, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)]


def test_odd_rows(spark, make_docs):
    assert found(audit.audit(make_docs(ODD), labelled(spark, MARKS))) == by_hand(ROWS, MARKS)


def test_every_filter_and_words_by_ascii_spaces_only(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, long), (2, long), (7, long, "b"), (3, "UP " * 60), (4, long + " 5%"), (5, "a b c " * 60),
        (6, "\t".join(f"w{i}" for i in range(50))), (8, "É" * 90), (9, "#", None), (10, "#"),
    ]
    full = [(r[0], r[1], r[2] if len(r) > 2 else "a") for r in rows]
    assert found(audit.audit(make_docs(rows), labelled(spark, MARKS))) == by_hand(full, MARKS)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(0, 5)),
            st.sampled_from([None, "", "A#", "a b", "x " * 60, "% " + " ".join(map(str, range(70)))]),
            st.sampled_from([None, "a", "b"]),
        ),
        max_size=12,
    )
)
def test_any_rows(spark, make_docs, rows):
    assert found(audit.audit(make_docs(rows), labelled(spark, MARKS))) == by_hand(rows, MARKS)


def test_empty_tables(spark, make_docs):
    assert audit.audit(make_docs([]), labelled(spark, MARKS)).count() == 0
    assert found(audit.audit(make_docs(ODD), labelled(spark, []))) == by_hand(ROWS, [])


def test_the_given_documents(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    marks = [tuple(r) for r in table(spark, SF, "labels").select("doc_id", "quality", "toxic").collect()]
    assert found(op11_filter_audit(spark, SF)) == by_hand(rows, marks)


def test_own_filters_and_their_number(spark, make_docs):
    docs = make_docs([(1, "aa"), (2, "b"), (3, None)])
    short = {"short": F.length("text") < 2, "b": F.col("text") == "b"}
    out = audit.audit(docs, labelled(spark, []), filters=short, repeat_filter=None).collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in out} == {
        ("shortb", 1, 2, 1, 0, 1), ("shortb", 2, 2, 0, 1, 1), ("bshort", 1, 2, 1, 0, 1), ("bshort", 2, 2, 0, 1, 1),
    }
    with pytest.raises(ValueError, match="1 to 6"):
        audit.audit(docs, labelled(spark, []), filters={str(i): F.lit(True) for i in range(6)})


def test_semi_and_anti_joins_of_stored_ids(spark, make_docs):
    docs, marks = make_docs(ODD), labelled(spark, MARKS)
    rows = audit.facts(docs, marks, None, "text")
    keep = ["row", "part", "good", "toxic"]
    failing = {f: rows.where(f"fails[{k}]").select(*keep) for k, f in enumerate("ABCD")}
    cells = audit.cells(failing).collect()
    assert len(cells) == len({r.row for r in cells})
    want = {r.row: [f for k, f in enumerate("ABCD") if r.fails[k]] for r in rows.collect()}
    assert {r.row: r.fails for r in cells} == {k: v for k, v in want.items() if v}
