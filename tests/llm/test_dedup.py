"""Exact and near deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import exact, neardup
from panelspark.llm.common import table

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = ids.index(keep)
        out += [(i, keep, len(ids), k == first, sha) for k, i in enumerate(ids)]
    return Counter(out)


def rows_of(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_odd_rows(make_docs):
    assert rows_of(exact.exact_groups(make_docs(ODD))) == by_hand(ODD)


def test_exact_empty(make_docs):
    assert exact.exact_groups(make_docs([])).count() == 0
    assert exact.keep_one(make_docs([])).count() == 0


def test_exact_bytes_are_checked_when_digests_collide(make_docs):
    weak = lambda text: (F.length(text) % 3).cast("string")
    assert rows_of(exact.exact_groups(make_docs(ODD), digest=weak)) == by_hand(ODD)


def test_exact_state_takes_later_arrivals(spark, make_docs, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    one = make_docs([(1, "a"), (5, "b")]).select(F.col("text").alias("digest"), "doc_id", F.lit(0).cast("long").alias("locator"))
    one.write.parquet(path)
    stream = spark.readStream.schema(one.schema).parquet(path)
    exact.digest_state(stream, state)
    two = make_docs([(9, "a")]).select(F.col("text").alias("digest"), "doc_id", F.lit(0).cast("long").alias("locator"))
    two.write.mode("append").parquet(path)
    got = exact.digest_state(spark.readStream.schema(one.schema).parquet(path), state).collect()
    assert {(r.digest, r.keep.doc_id, r.n) for r in got} == {("a", 9, 2), ("b", 5, 1)}


def test_exact_keep_one_keeps_columns(make_docs):
    docs = make_docs(ODD)
    out = exact.keep_one(docs)
    assert out.columns == docs.columns
    want = Counter((k[0], k[4]) for k, n in by_hand(ODD).items() for _ in range(n) if k[3])
    got = Counter((r.doc_id, hashlib.sha256(lowered(r.text).encode()).hexdigest()) for r in out.collect())
    assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(0, 4), max_size=40),
    st.lists(st.integers(0, 4), max_size=40),
    st.integers(0, 45),
)
def test_edit_distance_by_hand(a, b, most):
    want = distance(a, b)
    got = neardup.edit_distance(np.array(a, dtype=np.int32), np.array(b, dtype=np.int32), most)
    assert got == (want if want <= most else None)


def test_edit_distance_long_texts():
    rng = random.Random(3)
    a = [rng.randrange(50) for _ in range(900)]
    b = list(a)
    for _ in range(60):
        at = rng.randrange(len(b))
        kind = rng.randrange(3)
        if kind == 0:
            b[at] = -1
        elif kind == 1:
            del b[at]
        else:
            b.insert(at, -2)
    got = neardup.edit_distance(np.array(a), np.array(b), 100)
    assert got == distance(a, b)


def test_sketches_know_order_and_occurrence():
    a, b = np.arange(40, dtype=np.int32), np.arange(40, 80, dtype=np.int32)
    same = neardup.order_min_hash([np.concatenate([a, b]), np.concatenate([a, b]), np.concatenate([b, a])])
    assert (same[0] == same[1]).all()
    agree = (same[0] == same[2]).mean()
    assert 0 < agree < 0.9  # the same k-mers but for four, half of the pairs in another order
    once, twice = neardup.labelled_kmers([a])[0], neardup.labelled_kmers([np.concatenate([a, a])])[0]
    assert set(once) <= set(twice) and len(set(twice)) == len(twice)


def test_components_by_hand(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = neardup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for x in linked}
    assert len(got) == len(linked)


def words(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def test_near_classes_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    tokens = [words(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = tokens[i], tokens[j]
            longer = max(len(a), len(b))
            if min(len(a), len(b)) < 0.8 * longer:
                continue
            if longer - sum((Counter(a) & Counter(b)).values()) > 0.2 * longer:
                continue
            if distance(a, b) <= int(0.2 * longer + 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = defaultdict(list)
    for i, r in enumerate(rows):
        want[find(i)].append(r.doc_id)
    want = {i: min(ids) for ids in want.values() for i in ids}
    found = neardup.near_classes(docs)
    assert {r.doc_id: r.class_id for r in found.collect()} == want
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert kept == set(want.values())


def test_near_odd_rows(make_docs):
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50", "other").replace("w7 ", "")
    docs = make_docs([*ODD, (20, base), (21, near.upper()), (22, "no " + base + " words")])
    got = neardup.near_classes(docs).collect()
    assert len(got) == len(ODD) + 3
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.class_id)
    assert of[20] == of[21] == of[22] == {20}
    assert of[4] == of[5] == of[6] == {4}
    assert of[2] == of[3] == {2}  # a null text is empty
    assert of[10] == {10}
    assert sum(r.kept for r in got) == len({r.class_id for r in got if r.doc_id is not None} ) + 1
    assert neardup.keep_one(docs).columns == docs.columns


def test_near_empty(make_docs):
    assert neardup.near_classes(make_docs([])).count() == 0


def test_near_many_copies_and_a_common_passage(make_docs):
    rng = random.Random(9)
    passage = " ".join(f"common{i}" for i in range(60))
    rows = []
    for i in range(150):  # unlike texts around one passage
        rows.append((i, passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))))
    base = [f"g{i}" for i in range(120)]
    for i in range(200, 260):  # a group of near copies
        some = list(base)
        some[rng.randrange(120)] = f"z{i}"
        rows.append((i, passage + " " + " ".join(some)))
    got = {r.doc_id: r.class_id for r in neardup.near_classes(make_docs(rows)).collect()}
    assert all(got[i] == i for i in range(150))
    assert {got[i] for i in range(200, 260)} == {200}


def test_near_pairs_that_share_a_bucket_are_all_compared(make_docs):
    rng = random.Random(11)
    fresh = lambda: f"u{rng.randrange(10**9)}"

    def edited(words, places):
        return [fresh() if i in places else w for i, w in enumerate(words)]

    passage = [f"common{i}" for i in range(60)]
    texts = []
    for _ in range(40):  # a text around the passage, and copies of it
        base = passage + [fresh() for _ in range(60)]
        texts += [base, edited(base, rng.sample(range(120), 12)), edited(base, rng.sample(range(120), 12))]
        # A family that drifts: each is like the next only.
        drift = edited(base, range(60, 80))
        texts += [drift, edited(drift, range(80, 100)), edited(drift, range(80, 115))]
    got = neardup.near_classes(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()
    class_of = {r.doc_id: r.class_id for r in got}
    number = {w: i for i, w in enumerate({w for t in texts for w in t})}
    texts = [np.array([number[w] for w in t], dtype=np.int32) for t in texts]
    spark = make_docs([]).sparkSession
    named = {i: w for w, i in number.items()}
    hashed = spark.createDataFrame([(i, w) for i, w in named.items()], "i int, w string").select("i", F.hash("w").alias("h"))
    hash_of = {r.i: r.h for r in hashed.collect()}
    sketches = neardup.order_min_hash([np.array([hash_of[w] for w in t.tolist()], dtype=np.int32) for t in texts])
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similar(texts[i], texts[j])]
    met = [(i, j) for i, j in alike if (sketches[i] == sketches[j]).any()]
    assert len(met) > 100
    assert all(class_of[i] == class_of[j] for i, j in met)
    root = list(range(len(texts)))
    for _ in root:
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    assert all(root[i] == root[c] for i, c in class_of.items())  # and none is joined without a link


@pytest.mark.parametrize("size", [1, 2, 4, 5])
def test_short_texts(make_docs, size):
    text = " ".join("abcde"[:size])
    got = neardup.near_classes(make_docs([(1, text), (2, text.upper()), (3, "else " + text)])).collect()
    of = {r.doc_id: r.class_id for r in got}
    assert of[1] == of[2] == 1
