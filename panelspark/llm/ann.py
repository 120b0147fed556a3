"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt to shards of bounded size.  Each shard gets a graph: a greedy
search from its entry point proposes the neighbours of a new vector, and relaxed
distance pruning keeps those that no closer one covers, so that edges stay
diverse.  Queries run a beam search in every shard, in blocks; the best of all
shards win.  Inner products become distances by one more coordinate that brings
all vectors of a shard to the same norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Vectors of a shard, about.
SHARD_ROWS = 8_192
#: Edges of a vertex, beam of build and of queries, relaxation of the pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 40, 64, 96, 1.2
#: Vectors that are inserted, or queries that are searched, at once.
BATCH = 512
#: Beam entries that are expanded in one step.
WIDTH = 4


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero, not empty."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """A directed graph over the rows of ``points`` (squared distances)."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA):
        self.x = np.ascontiguousarray(points, dtype=np.float64)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.degree, self.alpha2 = degree, alpha * alpha
        self.edges = np.full((len(self.x), degree), -1, dtype=np.int32)
        self.entry = int(np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1))) if len(self.x) else 0

    def distances(self, queries: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """From each query to its row of ``ids`` (negative: infinite)."""
        dots = np.matmul(self.x[ids], queries[:, :, None])[:, :, 0]
        return np.where(ids < 0, np.inf, np.maximum(norms[:, None] + self.norm[ids] - 2 * dots, 0))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query at the end: ids and distances, nearest first."""
        n, norms = len(queries), np.einsum("ij,ij->i", queries, queries)
        ids = np.full((n, beam), -1, dtype=np.int32)
        ids[:, 0] = self.entry
        far = self.distances(queries, norms, ids)
        done = ids < 0
        seen = np.zeros((n, len(self.x)), dtype=bool)
        seen[:, self.entry] = True
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], np.inf, far[live])
            pick = np.argpartition(open_, WIDTH - 1, axis=1)[:, :WIDTH]
            ok = np.isfinite(np.take_along_axis(open_, pick, 1))
            go = ok.any(axis=1)
            live, pick, ok = live[go], pick[go], ok[go]
            if not len(live):
                break
            at = live[:, None]
            done[at, pick] = True
            near = self.edges[ids[at, pick]]
            near[~ok] = -1
            near = near.reshape(len(live), -1)
            # Each vertex once per query: neither seen before nor twice in this step.
            order = np.argsort(near, axis=1, kind="stable")
            sorted_ = np.take_along_axis(near, order, 1)
            twice = np.zeros_like(sorted_, dtype=bool)
            twice[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
            near = np.where(twice | (sorted_ < 0) | seen[at, sorted_], -1, sorted_)
            new_rows, new_cols = np.nonzero(near >= 0)
            seen[live[new_rows], near[new_rows, new_cols]] = True
            d = np.full(near.shape, np.inf)
            hit = near[new_rows, new_cols]
            dots = np.einsum("ij,ij->i", self.x[hit], queries[live[new_rows]])
            d[new_rows, new_cols] = np.maximum(norms[live[new_rows]] + self.norm[hit] - 2 * dots, 0)
            all_d = np.concatenate([far[live], d], axis=1)
            all_i = np.concatenate([ids[live], near], axis=1)
            all_e = np.concatenate([done[live], near < 0], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            done[live] = np.take_along_axis(all_e, best, 1)
        return ids, far

    def prune(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each point, up to ``degree`` of its candidates: nearest first, those
        left out that a chosen one is nearer to, by the relaxed factor."""
        ids = np.where(ids == points[:, None], -1, ids)
        order = np.argsort(ids, axis=1, kind="stable")
        ids = np.take_along_axis(ids, order, 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        own = self.x[points]
        d = self.distances(own, self.norm[points], ids)
        vectors = self.x[ids]
        between = self.norm[ids][:, :, None] + self.norm[ids][:, None, :] - 2 * np.matmul(
            vectors, vectors.transpose(0, 2, 1)
        )
        alive = ids >= 0
        out = np.full((len(points), self.degree), -1, dtype=np.int32)
        each = np.arange(len(points))
        for k in range(self.degree):
            pick = np.argmin(np.where(alive, d, np.inf), axis=1)
            ok = alive[each, pick]
            if not ok.any():
                break
            out[ok, k] = ids[each, pick][ok]
            alive &= self.alpha2 * between[each, pick] > d
            alive[each, pick] = False
        # Slots that pruning left free go to the nearest others.
        free = (out < 0).sum(axis=1)
        if free.any():
            spare = np.where((ids >= 0) & ~(ids[:, :, None] == out[:, None, :]).any(axis=2), d, np.inf)
            near = np.argsort(spare, axis=1, kind="stable")[:, : self.degree // 4]
            for k in range(near.shape[1]):
                slot = self.degree - free
                ok = (slot < self.degree) & np.isfinite(spare[each, near[:, k]])
                out[each[ok], slot[ok]] = ids[each, near[:, k]][ok]
                free = free - ok
        return out

    def insert(self, points: np.ndarray, beam: int) -> None:
        found, _ = self.search(self.x[points], beam)
        self.edges[points] = self.prune(points, np.concatenate([found, self.edges[points]], axis=1))
        # Edges back, pruned where a vertex has too many.
        source = np.repeat(points, self.degree)
        target = self.edges[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        vertices, first, n = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(vertices), BATCH):
            part = slice(lo, lo + BATCH)
            v, start, count = vertices[part], first[part], n[part]
            wide = int(count.max())
            at = start[:, None] + np.arange(wide)
            back = np.where(np.arange(wide) < count[:, None], source[np.minimum(at, len(source) - 1)], -1)
            if wide > 2 * self.degree:  # the nearest of very many
                d = self.distances(self.x[v], self.norm[v], back)
                back = np.take_along_axis(back, np.argsort(d, axis=1)[:, : 2 * self.degree], 1)
            self.edges[v] = self.prune(v, np.concatenate([self.edges[v], back.astype(np.int32)], axis=1))

    def build(self, beam: int = BUILD_BEAM, seed: int = 5) -> Graph:
        """Insert all points in seeded order, in batches that grow with the graph;
        then once more, against the whole graph."""
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]]) if n else order
        first = order[: min(n, 2 * self.degree)]
        if len(first) > 1:
            self.edges[first] = self.prune(first, np.tile(first.astype(np.int32), (len(first), 1)))
        at = len(first)
        while at < n:
            to = min(n, at + min(BATCH, max(32, at // 4)))
            self.insert(order[at:to], beam)
            at = to
        for lo in range(0, n, BATCH):
            self.insert(order[lo : lo + BATCH], beam)
        return self


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """With one more coordinate, so that all have the largest norm."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]], axis=1)


def _index(shard: pd.DataFrame) -> pd.DataFrame:
    """Graph of one shard.  Equal vectors are one vertex with all their rows."""
    shard = shard.sort_values(["vec_id", "row"], kind="stable", na_position="last")
    vectors = np.stack([np.asarray(v, dtype=np.float64) for v in shard["vector"]])
    distinct, vertex = np.unique(vectors, axis=0, return_inverse=True)
    graph = Graph(_lifted(distinct)).build()
    return pd.DataFrame(
        {
            "shard": [shard["shard"].iloc[0]],
            "dim": [vectors.shape[1]],
            "entry": [graph.entry],
            "vectors": [distinct.tobytes()],
            "edges": [graph.edges.tobytes()],
            "vertex": [vertex.astype(np.int32).tobytes()],
            "ids": [shard["vec_id"].fillna(-1).to_numpy(np.int64).tobytes()],
            "rows": [shard["row"].to_numpy(np.int64).tobytes()],
        }
    )


_INDEX = "shard int, dim int, entry int, vectors binary, edges binary, vertex binary, ids binary, rows binary"
_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _searched(batches: Iterator[pd.DataFrame], k: int, beam: int) -> Iterator[pd.DataFrame]:
    """Nearest of one shard for one block of queries, per input row."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            x = np.frombuffer(r.vectors).reshape(-1, r.dim)
            lifted = _lifted(x)
            graph = Graph(lifted)
            graph.edges = np.frombuffer(r.edges, dtype=np.int32).reshape(len(x), -1)
            graph.entry = r.entry
            vertex = np.frombuffer(r.vertex, dtype=np.int32)
            ids, rows = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.rows, dtype=np.int64)
            members = np.argsort(vertex, kind="stable")  # by vertex, then id
            first = np.searchsorted(vertex[members], np.arange(len(x) + 1))
            q = np.frombuffer(r.q_vectors).reshape(-1, r.dim)
            q_rows, q_ids = np.frombuffer(r.q_rows, dtype=np.int64), np.frombuffer(r.q_ids, dtype=np.int64)
            flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
            out = []
            for lo in range(0, len(q), BATCH):
                found, _ = graph.search(flat[lo : lo + BATCH], beam)
                for i, near in enumerate(found, lo):
                    near = near[near >= 0]
                    score = x[near] @ q[i]
                    # Rows of each vertex with the smallest ids; one more for the query's own.
                    take = [members[first[v] : min(first[v] + k + 1, first[v + 1])] for v in near]
                    at = np.concatenate(take)
                    s = np.repeat(score, [len(t) for t in take])
                    other = rows[at] != q_rows[i]
                    at, s = at[other], s[other]
                    best = np.lexsort((ids[at], -s))[:k]
                    out.append((q_rows[i], q_ids[i], rows[at[best]], ids[at[best]], s[best]))
            size = [len(o[2]) for o in out]
            yield pd.DataFrame(
                {
                    "query_row": np.repeat([o[0] for o in out], size),
                    "query_id": np.repeat([o[1] for o in out], size),
                    "row": np.concatenate([o[2] for o in out]),
                    "vec_id": np.concatenate([o[3] for o in out]),
                    "score": np.concatenate([o[4] for o in out]),
                }
            )


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    beam: int = BEAM,
) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own.  Nearness is the inner product in double precision,
    ties go to the smaller id.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors of
    different lengths do not meet.  Rows that repeat an id are rows of their own.
    Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stage(
        vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vector_col).cast("array<double>").alias("vector"),
            F.size(vector_col).alias("dim"),
        ),
        "vectors",
    )
    # Shards of a length are numbered after those of the lengths before it.
    per_dim = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shard, base = F.lit(None).cast("int"), 0
    bases = {}
    for dim, n in sorted(per_dim.items()):
        shards = -(-n // shard_rows)
        shard = F.when(
            F.col("dim") == dim, (F.lit(base) + F.pmod(F.xxhash64("row"), F.lit(shards))).cast("int")
        ).otherwise(shard)
        bases[dim] = (base, shards)
        base += shards
    graphs = stage(
        rows.withColumn("shard", shard).select("shard", "row", "vec_id", "vector").groupBy("shard").applyInPandas(_index, _INDEX),
        "graphs",
    )

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                for lo in range(0, len(part), BATCH):
                    some = part.iloc[lo : lo + BATCH]
                    base, shards = bases[dim]
                    yield pd.DataFrame(
                        {
                            "q_shard": list(range(base, base + shards)),
                            "q_rows": [some["row"].to_numpy(np.int64).tobytes()] * shards,
                            "q_ids": [some["vec_id"].to_numpy(np.int64).tobytes()] * shards,
                            "q_vectors": [np.stack(list(some["vector"])).astype(np.float64).tobytes()] * shards,
                        }
                    )

    queries = stage(
        rows.where(F.col("vec_id") % every == 0).mapInPandas(
            blocks, "q_shard int, q_rows binary, q_ids binary, q_vectors binary"
        ),
        "query-blocks",
    )
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 4)  # a row holds a whole graph and a block of queries
    try:
        found = stage(
            graphs.join(queries, F.col("shard") == F.col("q_shard")).mapInPandas(
                lambda batches: _searched(batches, k, beam), _FOUND
            ),
            "found",
        )
    finally:
        spark.conf.set(setting, before)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
