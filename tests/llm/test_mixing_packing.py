"""Mixing, sharding and packing against their definitions."""

import itertools
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import mixing, packing, sharding
from panelspark.llm.common import table

from .conftest import ODD

SF = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def test_targets_stop_at_three_times_the_size():
    sizes = {"a": 10, "b": 100, "c": 890}
    target = mixing.capped_targets(sizes, {"a": 5, "b": 2, "c": 1})
    assert target == {"a": 30.0, "b": 300.0, "c": 670.0}
    assert mixing.capped_targets({"a": 0, "b": 5}, {"a": 5, "b": 1}) == {"a": 0.0, "b": 5.0}
    assert mixing.capped_targets({}, {}) == {}


def cheapest(supply, quota, repeats=3):
    """Least repetition cost of any whole-word routing, by trying all."""
    links = [(p, s) for p in supply for s in p]
    best = None
    for flow in itertools.product(*[range(repeats * supply[p] + 1) for p, _ in links]):
        got, out = Counter(), Counter()
        for (p, s), f in zip(links, flow, strict=True):
            got[s] += f
            out[p] += f
        if any(got[s] > quota[s] for s in got) or any(out[p] > repeats * supply[p] for p in out):
            continue
        cost = 0
        for p, n in out.items():
            for k in range(repeats):
                cost += k * k * min(max(n - k * supply[p], 0), supply[p])
        key = (-sum(flow), cost)
        best = key if best is None else min(best, key)
    return best


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2), st.integers(0, 2), st.integers(0, 2), st.integers(0, 5), st.integers(0, 5))
def test_flow_is_cheapest(a, b, ab, qa, qb):
    supply, quota = {("a",): a, ("b",): b, ("a", "b"): ab}, {"a": qa, "b": qb}
    flow = mixing.route(supply, quota)
    out = {p: sum(f.values()) for p, f in flow.items()}
    cost = sum(k * k * min(max(n - k * supply[p], 0), supply[p]) for p, n in out.items() for k in range(3))
    assert (-sum(out.values()), cost) == cheapest(supply, quota)


def test_mix_of_overlapping_sources(make_docs):
    docs = make_docs([(i, "w " * 10) for i in range(60)])
    third = F.array(
        F.when(F.col("doc_id") % 3 != 1, "a"), F.when(F.col("doc_id") % 3 != 0, "b")
    )
    got = mixing.mix(docs, {"a": 1, "b": 1}, source=F.filter(third, lambda x: x.isNotNull())).collect()
    # 200 words in each of a, b, ab: sources of 400 words share 800; 600 exist.
    assert sum(r.taken for r in got) == 800
    assert max(r.copies for r in got) == 2


def check_mix(rows, got):
    """``rows``: (doc_id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.capped_targets(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    source_of = defaultdict(set)
    for i, t, s in rows:
        source_of[i, size(t)].add(s)
    taken = Counter()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        match = [s for s in source_of[r.doc_id, r["size"]] if sizes[s] == r.source_size and abs(target[s] - r.target) < 1e-6]
        assert match
        taken[match[0]] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_mix_odd_rows(make_docs):
    rows = [(*r, "a")[:3] for r in ODD]
    check_mix(rows, mixing.mix(make_docs(ODD)).collect())


def test_mix_of_documents_and_reruns(spark):
    docs = table(spark, SF, "documents")
    got = mixing.mix(docs).collect()
    check_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_mix_repeated_rows_share_a_partial_round(make_docs):
    docs = make_docs([(1, "a b c", "s")] * 40 + [(2, "x " * 200, "t")])
    got = mixing.mix(docs, {"s": 1, "t": 5}).collect()
    assert abs(sum(r.taken for r in got if r.doc_id == 1) - got[0].target * 0 - 53) <= 3


def test_apply_mix_repeats_rows(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in want.items() if n})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_goes_on_past_a_document_that_does_not_fit(make_docs, seed):
    rows = [(0, "x " * 1000, "s")] + [(i, "a b c", "s") for i in range(1, 301)]
    rows += [(i, "w " * 10, "t") for i in range(400, 590)]
    got = mixing.mix(make_docs(rows), {"s": 450, "t": 3350}, seed=seed).collect()
    assert abs(sum(r.taken for r in got if r.doc_id < 400) - 450) <= 3  # a small document's size
    assert abs(sum(r.taken for r in got if r.doc_id >= 400) - 3350) <= 10


def test_mix_empty(make_docs):
    assert mixing.mix(make_docs([])).count() == 0


def check_shards(rows, got, shards=8):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return [loads[s] for s in range(shards)]


def test_shards_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    loads = check_shards([(r.doc_id, r.text) for r in docs.collect()], sharding.assign(docs).collect())
    assert max(loads) <= 1.01 * min(loads)


def test_shards_of_odd_rows(make_docs):
    check_shards([r[:2] for r in ODD], sharding.assign(make_docs(ODD)).collect())
    assert sharding.assign(make_docs([])).count() == 0


def test_map_edits_are_few(spark):
    rng = random.Random(2)
    loads = [(i, 1000 + rng.randrange(50)) for i in range(512)]
    frame = spark.createDataFrame(loads, "slot int, bytes long")
    first = sharding.rebalance(sharding.first_map(spark, 4, 512), frame, 4)
    same = sharding.rebalance(first, frame, 4)
    old = {r.slot: r.shard for r in first.collect()}
    assert {r.slot: r.shard for r in same.collect()} == old
    assert {r.version for r in same.collect()} == {2}
    grown = {r.slot: r.shard for r in sharding.rebalance(first, frame, 5).collect()}
    moved = [s for s in old if grown[s] != old[s]]
    assert all(grown[s] == 4 for s in moved) or len(moved) < 0.25 * len(old)
    sums = Counter()
    for s, n in loads:
        sums[grown[s]] += n
    assert max(sums.values()) < 1.02 * min(sums.values())


def best_fit_by_hand(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
            b[0] -= n
            b[1].append(n)
        else:
            bins.append([capacity - n, [n]])
    return Counter(tuple(b[1]) for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 64))
def test_plan_equals_one_by_one(lengths, capacity):
    bins = defaultdict(list)
    for length, first, last, bin_, per_bin, offset in packing.best_fit_plan(Counter(lengths), capacity):
        for r in range(first, last + 1):
            bins[bin_ + (r - first) // per_bin].append((offset + (r - first) % per_bin * length, length))
    got = Counter()
    for items in bins.values():
        items.sort()
        at = 0
        for offset, n in items:
            assert offset == at
            at += n
        assert at <= capacity
        got[tuple(n for _, n in items)] += 1
    assert got == best_fit_by_hand(lengths, capacity)


def check_packing(rows, got, capacity=2048):
    own = Tokenizer.from_file(TOKENS)
    want = Counter()
    for i, t in rows:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, (start, n) in enumerate(packing.piece_starts(len(ids), capacity)):
            want[i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    lengths = [r.length for r in got]
    assert len(bins) == sum(best_fit_by_hand(lengths, capacity).values())


def test_pack_documents(spark):
    docs = table(spark, SF, "documents")
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, TOKENS).collect())


def test_pack_odd_rows(make_docs):
    rows = [*ODD, (30, "a <|endoftext|> b"), (31, "tail\n\n  \n")]
    check_packing([r[:2] for r in rows], packing.pack(make_docs(rows), TOKENS).collect())
    assert packing.pack(make_docs([]), TOKENS).count() == 0


@pytest.mark.parametrize("length", [1, 2047, 2048, 2049, 4096, 5000])
def test_pieces_cover_a_document(length):
    pieces = packing.piece_starts(length)
    assert [s for s, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]]
    assert sum(n for _, n in pieces) == length
    assert all(n == 2048 for _, n in pieces[1:])


def test_groups_that_do_not_overlap_are_routed_alone():
    rng = random.Random(2)
    supply, quota = {}, {}
    for g in range(30):
        names = [f"{g}.{i}" for i in range(rng.randint(1, 3))]
        quota |= {s: rng.randint(0, 90) for s in names}
        for k in range(1, len(names) + 1):
            supply[tuple(names[:k])] = rng.randint(1, 40)
    whole = mixing._route_group(list(supply), list(quota), supply, quota, mixing.MAX_REPEATS)
    apart = mixing.route(supply, quota)
    assert list(apart) == list(supply)

    def cost(flow):
        words = sum(sum(f.values()) for f in flow.values())
        paid = 0
        for p, f in flow.items():
            rounds, rest = divmod(sum(f.values()), supply[p])
            paid += supply[p] * sum(k * k for k in range(rounds)) + rest * rounds * rounds
        return words, paid

    assert cost(apart) == cost(whole)
    many = {(f"s{i}",): 10 for i in range(20_000)}
    start = time.perf_counter()
    found = mixing.route(many, {f"s{i}": 25 for i in range(20_000)})
    assert time.perf_counter() - start < 5 and all(f == {p[0]: 25} for p, f in found.items())
