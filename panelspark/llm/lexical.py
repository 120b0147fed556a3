"""Ranked lexical search of many items at once, with shared partial sums.

A document's score for an item is a sum over the item's terms.  Items share terms, so
the sums share parts: terms that occur in the same items are one leaf, and two parts
that stand together in several items are joined to a new part, the most shared first.
The parts form a directed acyclic graph.  A document's accumulator of a part is
computed once, leaves from the document's terms, every other one by one addition, and
an item adds up the few parts that are left to it.

Documents never meet items row by row: items come in blocks, the graph of a block is
sent to the tasks (its size is bounded by the block), and each task keeps the best
documents of each item.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

TOP = 50
#: Items of a block, and terms of all its items; an item with more is a block alone.
BLOCK_ITEMS = 256
BLOCK_TERMS = 16_384
#: Blocks for which the documents are read once.
WAVE_BLOCKS = 16
#: Parts into which the candidates of an item are dealt before the last ranking.
SPREAD = 64
#: Accumulators held at once by a task.
CELLS = 2_000_000
#: Bytes that belong to no term become spaces, A-Z become a-z.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters and characters past U+007F, with only A-Z
    lower-cased, in UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split(b" ")


@dataclass(frozen=True)
class Graph:
    """Shared parts of a block of items.  Parts below ``len(leaves)`` are leaves."""

    items: list  # item ids
    leaves: list[list[bytes]]  # terms of each leaf; every term is in one leaf
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (part, left, right)
    n_parts: int
    tops: list[np.ndarray]  # parts whose sum is the score of each item


def mine(items: list[tuple]) -> Graph:
    """The graph of ``(item id, terms)``.

    Pairs of parts are counted within this block only, by the bits of the items that
    hold both.
    """
    holders: dict[bytes, int] = {}
    for k, (_, terms) in enumerate(items):
        for term in terms:
            holders[term] = holders.get(term, 0) | 1 << k
    by_items: dict[int, list[bytes]] = {}
    for term in sorted(holders):
        by_items.setdefault(holders[term], []).append(term)
    masks = list(by_items)
    leaves = list(by_items.values())
    depth = [0] * len(masks)
    shared = [p for p, m in enumerate(masks) if m.bit_count() > 1]
    heap = [
        (-n, a, b)
        for i, a in enumerate(shared)
        for b in shared[i + 1 :]
        if (n := (masks[a] & masks[b]).bit_count()) > 1
    ]
    heapq.heapify(heap)
    made: list[tuple[int, int, int]] = []
    while heap:
        n, a, b = heapq.heappop(heap)
        both = masks[a] & masks[b]
        if both.bit_count() != -n:
            if both.bit_count() > 1:
                heapq.heappush(heap, (-both.bit_count(), a, b))
            continue
        new = len(masks)
        masks.append(both)
        masks[a] &= ~both
        masks[b] &= ~both
        depth.append(1 + max(depth[a], depth[b]))
        made.append((new, a, b))
        shared = [p for p in shared if masks[p].bit_count() > 1]
        for p in shared:
            if (n := (masks[p] & both).bit_count()) > 1:
                heapq.heappush(heap, (-n, p, new))
        shared.append(new)
    levels = [
        tuple(np.array(x) for x in zip(*rows, strict=True))
        for d in range(1, 1 + max(depth, default=0))
        if (rows := [m for m in made if depth[m[0]] == d])
    ]
    tops = [
        np.array([p for p, m in enumerate(masks) if m >> k & 1], dtype=np.int64)
        for k in range(len(items))
    ]
    return Graph([i for i, _ in items], leaves, levels, len(masks), tops)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Blocks of ``(item id, set of terms)``; repeated ids are one item with all their
    terms.  Rows come one partition at a time, ordered by id."""
    block: list[tuple] = []
    held = 0
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy("i")
    grouped = groupby(rows.toLocalIterator(), key=lambda r: r["i"])
    for item, same in grouped:
        terms = {t for r in same for t in terms_of(r["t"]) if t}
        if block and (len(block) == BLOCK_ITEMS or held + len(terms) > BLOCK_TERMS):
            yield block
            block, held = [], 0
        block.append((item, terms))
        held += len(terms)
    if block:
        yield block


def postings(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term: its size and how often
    it has each of the numbered terms.  Their count is bounded by the wave."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column("text"):
                found = Counter(terms_of(text.as_py()))
                found.pop(b"", None)
                sizes.append(found.total())
                known = found.keys() & number.keys()
                terms.append([number[t] for t in known])
                tfs.append([found[t] for t in known])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(terms, type=pa.list_(pa.int32())),
                    pa.array(tfs, type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n long, terms array<int>, tfs array<long>"
    return slim.mapInArrow(run, schema).where("n > 0")


def accumulate(graph: Graph, doc: np.ndarray, leaf: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of ``n_docs`` documents (columns) for the items of a block (rows), from
    the value of each term of each document."""
    parts = np.zeros((graph.n_parts, n_docs), dtype=np.int64)
    np.add.at(parts.reshape(-1), leaf * n_docs + doc, value)
    for new, a, b in graph.levels:
        parts[new] = parts[a] + parts[b]
    return np.array([parts[top].sum(axis=0) for top in graph.tops])


def best(
    written: DataFrame, graphs: list[Graph], weight: np.ndarray, places: list[np.ndarray], n_all: int, total: int, top: int
) -> DataFrame:
    """The ``top`` documents of each item in each task: ``block, item, doc_id, score``.

    ``weight`` is by term, ``places`` has the leaf of each term in each graph, or -1.
    """
    sent = written.sparkSession.sparkContext.broadcast((graphs, weight, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, weight, places = sent.value
        step = max(1, CELLS // max(g.n_parts for g in graphs))
        kept = {}
        for batch in batches:
            for part in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                ids, lists = part.column("doc_id"), part.column("terms")
                null = np.array(ids.is_null())
                ids = np.array(ids.fill_null(0))
                term = np.array(lists.flatten(), dtype=np.int64)
                tf = np.array(part.column("tfs").flatten(), dtype=np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.array(lists.value_lengths(), dtype=np.int64))
                n = np.array(part.column("n"), dtype=np.int64)
                m = 100 - 50 + (50 * n * n_all) // total
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                for b, (graph, place) in enumerate(zip(graphs, places, strict=True)):
                    leaf = place[term]
                    own = leaf >= 0
                    scores = accumulate(graph, doc[own], leaf[own], value[own], part.num_rows)
                    for k, row in enumerate(scores):
                        old = kept.get((b, k))
                        least = old[0][-1] if old is not None and len(old[0]) == top else 1
                        hit = np.flatnonzero(row >= least)
                        if not len(hit):
                            continue
                        new = row[hit], null[hit], ids[hit]
                        if old is not None:
                            new = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                        order = np.lexsort((new[2], new[1], -new[0]))[:top]
                        kept[b, k] = tuple(x[order] for x in new)
        for (b, k), (score, null, ids) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(score), b, dtype=np.int32)),
                    pa.array(np.full(len(score), k, dtype=np.int32)),
                    pa.array(ids, mask=null),
                    pa.array(score),
                ],
                names=["block", "item", "doc_id", "score"],
            )

    return written.select("doc_id", "n", "terms", "tfs").mapInArrow(
        run, "block int, item int, doc_id long, score long"
    )


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item over all tasks, with their ranks; no task gets more
    than a part of an item's rows before all but ``top`` of them are gone."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    of_part, of_item = (
        F.row_number().over(Window.partitionBy("block", "item", *more).orderBy(*order)) for more in (["part"], [])
    )
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    first = dealt.withColumn("rank", of_part).where(F.col("rank") <= top)
    return first.withColumn("rank", of_item).where(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document adds weight *
    (10^9 tf div (1000 tf + 20 m)) for each term of the item it has, m = 50 + 50 n N
    div L.  Statistics cover all documents.  Equal scores are ranked by ascending id,
    null ids last; documents with score 0 are not returned, so items without a known
    term (null or empty texts) have no rows.  Repeated document rows are documents of
    their own; rows of one item id, null too, are one item with the terms of all.
    Whole texts of any length are read; a null text has no term.  Other columns are
    not read.  An empty table on either side gives no rows.

    The documents' terms that any item of a wave has are written once; statistics and
    scores are read from there.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    blocks = item_blocks(items, item_id_col, item_text_col)
    totals = None
    while graphs := [mine(b) for b in islice(blocks, WAVE_BLOCKS)]:
        vocabulary = sorted({t for g in graphs for leaf in g.leaves for t in leaf})
        number = {t: k for k, t in enumerate(vocabulary)}
        written = stage(postings(docs, number, id_col, text_col), "postings")
        if totals is None:
            totals = written.agg(F.count("n").alias("docs"), F.sum("n").alias("terms")).first()
        if not totals["docs"] or not vocabulary:
            continue
        holding = written.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("t").alias("df"))
        ratio = (2 * F.lit(totals["docs"]) + 2) / (2 * F.col("df") + 1)
        weight = np.zeros(len(vocabulary), dtype=np.int64)
        for row in holding.select("t", F.floor(1000 * F.log(ratio)).alias("w")).toLocalIterator():
            weight[row["t"]] = row["w"]
        places = []
        for g in graphs:
            place = np.full(len(vocabulary), -1)
            for leaf, terms in enumerate(g.leaves):
                place[[number[t] for t in terms]] = leaf
            places.append(place)
        names = spark.createDataFrame(
            [(b, k, i) for b, g in enumerate(graphs) for k, i in enumerate(g.items)],
            f"block int, item int, item_id {id_type}",
        )
        rows = ranked(best(written, graphs, weight, places, totals["docs"], totals["terms"], top), top)
        named = rows.join(F.broadcast(names), ["block", "item"])
        out = out.unionByName(named.select("item_id", "rank", "doc_id", "score"))
    return out
