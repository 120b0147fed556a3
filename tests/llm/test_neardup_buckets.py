"""Members of open buckets: bounds that lose no pair, dealing of large buckets, recall."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import neardup
from panelspark.llm.common import Stages

INTS = "a long, b long"


def group_of(texts, root=None, side=None, keys=None, key=0):
    counted = [neardup.word_counts(np.array(t, dtype=np.int32)) for t in texts]
    return {
        "node": np.arange(len(texts)),
        "n": np.array([len(t) for t in texts]),
        "root": np.arange(len(texts)) if root is None else np.array(root),
        "side": np.zeros(len(texts), dtype=int) if side is None else np.array(side),
        "counts": np.array([c for c, _ in counted], dtype=object),
        "excess": np.array([e for _, e in counted]),
        "key": np.full(len(texts), key),
        "keys": np.array([np.array(k) for k in keys or [[key]] * len(texts)] + [None], dtype=object)[:-1],
    }


def proposed(*args, **kw):
    found = neardup.may_be_alike(group_of(*args, **kw), 0.8)
    return {(int(a), int(b)) for x, y, _ in found for a, b in np.broadcast(x, y)}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=90), min_size=2, max_size=12), st.randoms())
def test_bounds_lose_no_pair_alike(texts, rnd):
    # Near copies of some, and very long repeats whose counts pass 255.
    for t in list(texts)[:4]:
        copy = list(t)
        copy[rnd.randrange(len(copy))] = 11
        texts += [copy, t * 70, copy * 70]
    alike = {
        (i, j)
        for j, b in enumerate(texts)
        for i, a in enumerate(texts[:j])
        if neardup.similar(np.array(a, dtype=np.int32), np.array(b, dtype=np.int32))
    }
    assert alike <= proposed(texts)


def test_classes_and_sides_are_kept_apart():
    text = list(range(40))
    assert proposed([text] * 4) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
    assert proposed([text] * 4, root=[0, 0, 2, 2]) == {(0, 2), (0, 3), (1, 2), (1, 3)}
    assert proposed([text] * 4, side=[1, 1, 2, 2]) == {(0, 2), (0, 3), (1, 2), (1, 3)}


def test_a_pair_is_compared_in_the_first_bucket_it_shares():
    text, keys = list(range(40)), [[-5, 3, 9], [3, 9], [-5, 9], [9]]
    assert proposed([text] * 4, keys=keys, key=-5) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
    assert proposed([text] * 4, keys=keys, key=9) == {(0, 3), (1, 2), (1, 3), (2, 3)}


def unlike_around_a_passage(n, rng):
    """60 words of one passage and 60 drawn from 400, as in prose; some near copies."""
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [f"common{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        base = passage + [rng.choice(vocabulary) for _ in range(60)]
        texts.append(base)
        if rng.random() < 0.2:
            copy = list(base)
            for at in rng.sample(range(120), 6):
                copy[at] = rng.choice(vocabulary)
            texts.append(copy)
    return texts


def brute_classes(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    number = {w: i for i, w in enumerate({w for t in texts for w in t})}
    coded = [np.array([number[w] for w in t], dtype=np.int32) for t in texts]
    for j in range(len(coded)):
        for i in range(j):
            if neardup.similar(coded[i], coded[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("members", [2048, 16])
def test_unlike_texts_around_a_passage_are_hardly_aligned(make_docs, monkeypatch, members):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    aligned = []
    real = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: aligned.append(pairs.count()) or real(pairs, *a))
    counts = {}
    for n in (100, 200):
        texts = unlike_around_a_passage(n, random.Random(n))
        aligned.clear()
        got = neardup.near_classes(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()
        assert {r.doc_id: r.class_id for r in got} == dict(enumerate(brute_classes(texts)))
        counts[n] = sum(aligned)
    # In proportion to the texts, not to their pairs (5,000 and 20,000).
    assert counts[200] < 3 * counts[100] and counts[200] < 2500


def test_large_buckets_are_dealt_whole(spark, monkeypatch):
    rng = random.Random(3)
    sizes = [rng.choice([20, 25, 30, 31, 60, 75, 76]) for _ in range(120)]
    texts = [[rng.randrange(12) for _ in range(n)] for n in sizes]
    rows = [(7, len(texts), i, len(t), i % 40, t) for i, t in enumerate(texts)]
    schema = "key long, size long, node long, n int, root long, words array<int>"
    df = spark.createDataFrame(rows, schema)
    words = df.select("node", "words")
    found = {}
    for members in (1000, 10):
        monkeypatch.setattr(neardup, "MEMBERS", members)
        pairs = neardup._across(df.drop("words"), words, Stages(spark), 0.8)
        got = [tuple(r) for r in pairs.collect()]
        got = [(a, b) for a, b, _ in got]
        assert len(got) == len(set(got))
        found[members] = set(got)
    assert found[1000] == found[10] and len(found[10]) > 100


@pytest.mark.parametrize("similarity", [0.95, 0.9, 0.85, 0.82, 0.805])
def test_recall_by_similarity(similarity):
    """Edits spread evenly over texts of 200 words: the share of pairs with a common sketch."""
    rng = np.random.default_rng(int(similarity * 1000))
    texts = []
    for _ in range(200):
        a = rng.integers(0, 1 << 30, 200).astype(np.int32)
        b = a.copy()
        at = rng.choice(200, size=round(200 * (1 - similarity)), replace=False)
        b[at] = rng.integers(1 << 30, (1 << 31) - 1, len(at))
        texts += [a, b]
    sketches = neardup.order_min_hash(texts)
    met = (sketches[0::2] == sketches[1::2]).any(axis=1).mean()
    assert met >= (0.9 if similarity > 0.81 else 0.85)


def test_stage_tables_are_deleted(spark, make_docs, tmp_path, monkeypatch):
    from panelspark.llm import common

    paths = []
    monkeypatch.setattr(
        common, "scratch_path", lambda s, name: paths.append(str(tmp_path / f"{len(paths)}-{name}")) or paths[-1]
    )
    texts = unlike_around_a_passage(30, random.Random(1))
    out = neardup.near_classes(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)]))
    left = defaultdict(int)
    for p in tmp_path.iterdir():
        left[p.name.split("-", 1)[1]] += 1
    assert not {"tokens", "words", "words-met", "met", "nodes", "pairs", "pairs-left", "open-members"} & set(left)
    assert out.count() == len(texts)
