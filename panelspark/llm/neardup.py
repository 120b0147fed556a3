"""Near-duplicate classes by Order MinHash and banded alignment.

A text is its sequence of words.  Each sketch takes the least few of its k-mers
(runs of five words, told apart by occurrence) under one hash and keeps them in
text order, so that agreeing sketches point to a small edit distance and not just
to a shared vocabulary.  Texts that agree in a sketch meet in a bucket, where all
are compared with one leader.  Where that leaves members in different classes, they
are compared with each other, within their bucket and block by block: counts of
hashed words bound what two texts can share, and the pairs that may be alike go on
to be aligned.  A pair counts as a link only when its words align within a band
with a similarity of 0.8 or more.  Classes are the connected components of the
links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, apply_copies, small_batches, text_or_empty

#: Words of a k-mer, sketches of a text, k-mers of a sketch.
WORDS = 5
SKETCHES = 64
PER_SKETCH = 2
#: Least similarity: 1 - (word edits) / (words of the longer text).
SIMILARITY = 0.8
#: Bits that hold the place of a k-mer beside its hash.
_PLACE = np.uint64((1 << 28) - 1)
#: K-mers that are hashed at once.
_CHUNK = 1 << 16
_BLOCK = 32
#: Members of a bucket that are compared with each other at once; more are dealt.
MEMBERS = 2048
#: Least and most slots in which the words of a text are counted.
_SLOTS = (64, 4096)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_kmers(texts: list[np.ndarray], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of all texts, and where each text starts.

    A text of fewer words than ``k`` (at least one) is one k-mer.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = _mixed(np.concatenate(texts).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    kmers = np.maximum(sizes - k + 1, 1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first = np.concatenate([[0], np.cumsum(kmers)[:-1]])
    doc = np.repeat(np.arange(len(texts)), kmers)
    at = np.arange(kmers.sum()) - first[doc] + starts[doc]
    end = (starts + sizes)[doc]
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        here = at + j
        word = np.where(here < end, flat[np.minimum(here, len(flat) - 1)], np.uint64(j + 1))
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)
    # Occurrences: equal k-mers of a text in order of place.
    own = h + _mixed(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    same = np.concatenate([[False], own[order][1:] == own[order][:-1]])
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    label = np.empty(len(order), dtype=np.uint64)
    label[order] = run.astype(np.uint64)
    return _mixed(h + label * np.uint64(0xD6E8FEB86659FD93)), first


def order_min_hash(
    texts: list[np.ndarray], sketches: int = SKETCHES, k: int = WORDS, per_sketch: int = PER_SKETCH
) -> np.ndarray:
    """``len(texts) x sketches`` hashes; every text has a word at least."""
    labelled, first = labelled_kmers(texts, k)
    length = np.diff(np.append(first, len(labelled)))
    place = (np.arange(len(labelled)) - np.repeat(first, length)).astype(np.uint64) & _PLACE
    rng = np.random.default_rng(20240229)
    seeds = rng.integers(1, 2**63, size=(sketches, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(texts), sketches), dtype=np.uint64)
    for s, (a, b) in enumerate(seeds):
        ranks = (labelled ^ a) * b
        ranks ^= ranks >> np.uint64(32)
        ranks *= a
        ranks = (ranks & ~_PLACE) | place
        picked = []
        for n in range(per_sketch):
            low = np.minimum.reduceat(ranks, first)
            spot = first + (low & _PLACE).astype(np.int64)
            spot = np.where(length > n, spot, picked[-1] if picked else spot)
            picked.append(spot)
            ranks[spot] = np.uint64(0xFFFFFFFFFFFFFFFF)
        in_text_order = np.sort(np.stack(picked), axis=0)
        h = np.full(len(texts), s + 1, dtype=np.uint64)
        for spot in in_text_order:
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + labelled[spot])
        out[:, s] = h
    return out.view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edits between two texts, or None when they are more than ``most``.

    Alignment within the band of ``most`` diagonals: after each edit it is known
    how far every diagonal of the band reaches.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    shared = min(n, m)
    differ = np.flatnonzero(a[:shared] != b[:shared])
    head = int(differ[0]) if len(differ) else shared
    a, b = a[head:], b[head:]
    n, m = len(a), len(b)
    shared = min(n, m)
    differ = np.flatnonzero(a[n - shared :][::-1] != b[m - shared :][::-1])
    tail = int(differ[0]) if len(differ) else shared
    n, m = n - tail, m - tail
    if not n or not m:
        return max(n, m) if max(n, m) <= most else None
    pad = np.arange(_BLOCK)
    a = np.concatenate([a[:n].astype(np.int64), np.full(_BLOCK + 1, 1 << 40)])
    b = np.concatenate([b[:m].astype(np.int64), np.full(_BLOCK + 1, 1 << 41)])
    low, high = -min(most, n), min(most, m)  # diagonals: place in b minus place in a
    width = high - low + 3
    goal = m - n - low + 1
    reach = np.full(width, -1, dtype=np.int64)
    diagonal = np.arange(low - 1, high + 2)
    last = np.minimum(n, m - diagonal)
    for edits in range(most + 1):
        x0, x1 = max(-edits - low + 1, 1), min(edits - low + 1, width - 2)
        part = slice(x0, x1 + 1)
        if edits == 0:
            new = np.zeros(1, dtype=np.int64)
        else:
            new = np.maximum(reach[x0 - 1 : x1], reach[part] + 1)
            new = np.maximum(new, reach[x0 + 1 : x1 + 2] + 1)
            first_row = np.maximum(-diagonal[part], 0)
            new = np.minimum(np.maximum(new, first_row), last[part])
        live = np.flatnonzero(new < last[part])
        shift = diagonal[part]
        while len(live):
            i = new[live]
            miss = a[i[:, None] + pad] != b[(i + shift[live])[:, None] + pad]
            full = ~miss.any(axis=1)
            new[live] = i + np.where(full, _BLOCK, miss.argmax(axis=1))
            live = live[full]
        reach[part] = new
        if reach[goal] >= n:
            return edits
    return None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word sequences align with a similarity of ``least`` or more."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    # Every word of the longer text that the other lacks is an edit.
    wa, na = np.unique(a, return_counts=True)
    wb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(wa, wb, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(na[ia], nb[ib]).sum()) > most:
        return False
    return edit_distance(a, b, most) is not None


def _sketched(tokens: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [np.asarray(w, dtype=np.int32) for w in batch["words"]]
            rows, at = [], 0
            while at < len(texts):  # chunks of texts, so that hashes stay in cache
                to, n = at, 0
                while to < len(texts) and (to == at or n + len(texts[to]) <= _CHUNK):
                    n += len(texts[to])
                    to += 1
                rows.extend(order_min_hash(texts[at:to]))
                at = to
            yield pd.DataFrame(
                {"digest": batch["digest"], "row": batch["row"], "n": [len(t) for t in texts], "sketches": rows}
            )

    some = tokens.where(F.size("words") > 0).select("digest", "row", "words")
    return some.mapInPandas(run, "digest binary, row long, n int, sketches array<long>")


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``link``: whether their texts are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            link = [
                similar(np.asarray(x, dtype=np.int32), np.asarray(y, dtype=np.int32), least)
                for x, y in zip(batch["wa"], batch["wb"], strict=True)
            ]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "link": link})

    members = words.select(F.col("node").alias("rb"), F.col("words").alias("wb"))
    leaders = words.select(F.col("node").alias("ra"), F.col("words").alias("wa"))
    # Members first: they differ, so the join with a leader of many comes last,
    # where its rows are large enough to be split.
    both = pairs.join(members, F.col("b") == F.col("rb")).join(leaders, F.col("a") == F.col("ra"))
    return both.select("a", "b", "wa", "wb").mapInPandas(run, "a long, b long, link boolean")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: least node of the connected component of each linked node.

    Alternates large-star and small-star steps until every edge leads from a node
    to its root.  Edges are distinct, one small row each, and written to the shared
    folder after every step; the tables of the step before are deleted.
    """
    stages = Stages(links.sparkSession)
    edges = stages.write(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "edges",
    )

    def unsettled() -> bool:
        heads = edges.select(F.col("u").alias("head"))
        onward = edges.join(heads, F.col("v") == F.col("head"), "left_semi").select("u")
        forked = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        return bool(onward.unionByName(forked).take(1))

    while unsettled():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")
        )
        large = stages.write(large.distinct(), "large-star")
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        next_edges = stages.write(
            small.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), "small-star"
        )
        stages.drop(edges, large)
        edges = next_edges
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def forest_roots(parents: DataFrame) -> DataFrame:
    """``node, root`` of a forest given as ``node, parent`` (one row a node).

    Every step doubles the distance that pointers skip.
    """
    stages = Stages(parents.sparkSession)
    at = stages.write(parents.select("node", F.col("parent").alias("root")), "forest")
    while True:
        up = at.select(F.col("node").alias("via"), F.col("root").alias("higher"))
        joined = at.select("node", "root").join(up, F.col("root") == F.col("via"), "left")
        next_at = stages.write(
            joined.select(
                "node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")
            ),
            "forest",
        )
        stages.drop(at)
        at = next_at
        if not at.where("moved").take(1):
            break
    at = at.drop("moved")
    return at.unionByName(at.select(F.col("root").alias("node"), "root").distinct())


class Classes:
    """Classes of nodes that grow by links: ``node, root`` of all nodes with a link."""

    def __init__(self, stages: Stages):
        self.stages = stages
        self.roots: DataFrame | None = None

    def start(self, parents: DataFrame) -> None:
        """From links that are a forest (``node, parent``)."""
        self.roots = self.stages.write(forest_roots(parents), "roots")

    def lift(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``xa`` and ``xb``, the roots of their nodes, where those differ."""
        ra = self.roots.select(F.col("node").alias("na"), F.col("root").alias("xa"))
        rb = self.roots.select(F.col("node").alias("nb"), F.col("root").alias("xb"))
        joined = pairs.join(rb, F.col("b") == F.col("nb"), "left").join(ra, F.col("a") == F.col("na"), "left")
        return (
            joined.withColumns({"xa": F.coalesce("xa", "a"), "xb": F.coalesce("xb", "b")})
            .where("xa <> xb")
            .select(*pairs.columns, "xa", "xb")
        )

    def merge(self, links: DataFrame) -> None:
        """The classes at both ends of each link become one."""
        new = self.lift(links).select(F.col("xa").alias("a"), F.col("xb").alias("b")).distinct()
        new = self.stages.write(new, "new-links")
        if new.take(1):
            found = self.stages.write(components(new), "merged")
            up = found.select(F.col("node").alias("via"), F.col("root").alias("higher"))
            known = self.roots.join(up, F.col("root") == F.col("via"), "left").select(
                "node", F.coalesce("higher", "root").alias("root")
            )
            there = self.roots.select(F.col("node").alias("known"))
            fresh = found.join(there, F.col("node") == F.col("known"), "left_anti")
            old, self.roots = self.roots, self.stages.write(known.unionByName(fresh), "roots")
            self.stages.drop(old, found)
        self.stages.drop(new)

    def compare(self, pairs: DataFrame, words: DataFrame, least: float) -> None:
        """Merge the classes of all ``pairs`` (``a``, ``b``, ``hope``) that are links.

        Pairs within a class need no comparison, so of each two classes the pair of most
        hope comes first, and then those of all pairs that are still in two classes.
        """
        stages = self.stages
        left = stages.write(self.lift(pairs.select("a", "b", "hope")), "pairs-left")
        if left.take(1):
            # A struct of the pair after its hope: one of equals, the same in a rerun.
            best = left.groupBy("xa", "xb").agg(F.max(F.struct("hope", "a", "b")).alias("m"))
            with small_batches(stages.spark):
                tried = stages.write(_verified(best.select("m.a", "m.b"), words, least), "verified")
            self.merge(tried.where("link").select("a", "b"))
            done = tried.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
            rest = left.join(done, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
            rest = stages.write(self.lift(rest.select("a", "b")).select("a", "b"), "pairs-rest")
            if rest.take(1):
                with small_batches(stages.spark):
                    more = stages.write(_verified(rest, words, least), "verified")
                self.merge(more.where("link").select("a", "b"))
                stages.drop(more)
            stages.drop(tried, rest)
        stages.drop(left)


def _near_in_length(a: str, b: str, least: float) -> Column:
    """Texts whose lengths differ by more than the edits allowed are not similar."""
    longer, shorter = F.greatest(a, b), F.least(a, b)
    return (longer - shorter) <= F.floor((1 - least) * longer + 1e-9)


def linked(nodes: DataFrame, words: DataFrame, stages: Stages, least: float = SIMILARITY) -> DataFrame:
    """``node, root`` of nodes that have a link (others may be missing or their own root).

    ``nodes`` has ``node``, its ``sketches`` and its number of words ``n``; ``words``
    the ``words`` of every ``node``.  Both are deleted when they are not needed.
    """
    members = nodes.select("node", "n", F.posexplode("sketches").alias("sketch", "h")).select(
        F.xxhash64("sketch", "h").alias("key"), "node", "n"
    )
    first = members.groupBy(F.col("key").alias("lk")).agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("met"))
    lengths = nodes.select(F.col("node").alias("x"), F.col("n").alias("na"))
    leaders = stages.write(
        first.where("met > 1").join(lengths, F.col("a") == F.col("x")).select("lk", "a", "na"), "leaders"
    )
    met = members.join(leaders, F.col("key") == F.col("lk")).where("node <> a")
    met = stages.write(met.select("key", "a", "na", F.col("node").alias("b"), F.col("n").alias("nb")), "met")
    stages.drop(leaders, nodes)
    # Only the words of nodes that have met another one are moved again.
    some = met.select(F.col("a").alias("x")).unionByName(met.select(F.col("b").alias("x"))).distinct()
    used = stages.write(words.join(some, F.col("node") == F.col("x"), "left_semi"), "words-met")
    stages.drop(words)
    near = met.where(_near_in_length("na", "nb", least))
    pairs = stages.write(near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), "pairs")
    # The leader that shares most sketches comes first; most others then are
    # already in one class with their member.
    best = pairs.groupBy(F.col("b").alias("bb")).agg(F.max(F.struct("shared", "a")).alias("m"))
    with small_batches(stages.spark):
        tried = stages.write(_verified(best.select("m.a", F.col("bb").alias("b")), used, least), "verified")
    classes = Classes(stages)
    # Each member has one leader, smaller than itself.
    classes.start(tried.where("link").select(F.col("b").alias("node"), F.col("a").alias("parent")))
    done = tried.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    left = pairs.join(done, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
    left = stages.write(left.select("a", "b", F.col("shared").cast("int").alias("hope")), "pairs-left")
    classes.compare(left, used, least)
    stages.drop(pairs, tried, left)
    # All members have been compared with the leader.  Where the others of a bucket
    # are not one class, they are compared with each other.
    of = classes.roots.select(F.col("node").alias("rn"), "root")
    there = met.select("key", F.col("b").alias("node"), F.col("nb").alias("n"))
    there = there.join(of, F.col("node") == F.col("rn"), "left").drop("rn")
    there = stages.write(there.withColumn("root", F.coalesce("root", "node")), "members")
    stages.drop(met)
    spread = there.groupBy(F.col("key").alias("ok")).agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")
    )
    spread = stages.write(spread.where("lo <> hi").select("ok", "size"), "open")
    if spread.take(1):
        apart = stages.write(there.join(spread, F.col("key") == F.col("ok")).drop("ok"), "open-members")
        stages.drop(there)
        across = stages.write(_across(apart, used, stages, least), "pairs-across")
        stages.drop(apart)
        classes.compare(across, used, least)
        stages.drop(across)
    else:
        stages.drop(there)
    stages.drop(spread, used)
    return classes.roots


def word_counts(words: np.ndarray) -> tuple[bytes, int]:
    """How often words fall into each of about as many slots as there are words, up to
    255, and how many that leaves out."""
    slots = 1 << max(len(words) - 1, 0).bit_length()
    slots = min(max(slots, _SLOTS[0]), _SLOTS[1])
    counts = np.bincount(_mixed(words.astype(np.int64).view(np.uint64)) & np.uint64(slots - 1), minlength=slots)
    held = np.minimum(counts, 255)
    return held.astype(np.uint8).tobytes(), int((counts - held).sum())


def _counted(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [word_counts(np.asarray(w, dtype=np.int32)) for w in batch["words"]]
            yield pd.DataFrame(
                {"cn": batch["node"], "counts": [c for c, _ in found], "excess": [e for _, e in found]}
            )

    return words.select("node", "words").mapInPandas(run, "cn long, counts binary, excess int")


def may_be_alike(group: dict[str, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of different classes that hashed word counts do not tell apart.

    Two texts share at most the lesser count of every slot, so a pair that shares too
    few has too many edits: none that is alike is left out.  ``side`` is 0 for members
    that meet all others, else 1 or 2 for the two sides to be compared.  Of the open
    buckets that two texts share (``keys``), only the first, ``key``, compares them.
    Yields the nodes of pairs and how many words they may share.
    """
    order = np.argsort(group["n"], kind="stable")
    n, root, side, node = (group[c][order].astype(np.int64) for c in ("n", "root", "side", "node"))
    before = earlier_keys([group["keys"][k] for k in order], int(group["key"][0]))
    excess = group["excess"][order].astype(np.int64)
    counts = [np.frombuffer(group["counts"][k], dtype=np.uint8) for k in order]
    slots = np.array([len(c) for c in counts])
    for size in np.unique(slots):
        # Lengths of texts alike differ by less than two, and so do their slots.
        own, next_size = np.flatnonzero(slots == size), np.flatnonzero(slots == 2 * size)
        table = np.stack([counts[k] for k in own]).astype(np.uint16)
        if len(next_size):
            wide = np.stack([counts[k] for k in next_size]).astype(np.uint16)
            # Slot numbers are the low bits of one hash, so halves are added.
            table = np.concatenate([table, wide[:, :size] + wide[:, size:]])
        member = np.concatenate([own, next_size])
        length, extra, of, half, name = n[member], excess[member], root[member], side[member], node[member]
        most = ((1 - least) * length + 1e-9).astype(np.int64)
        # Members are in order of length: those too long for a member end its range.
        ends = np.searchsorted(length - most, length, side="right")
        for i in range(len(own)):
            rest = slice(i + 1, ends[i])
            shared = np.minimum(table[i], table[rest]).sum(axis=1, dtype=np.int64) + np.minimum(extra[i], extra[rest])
            hit = (length[rest] - shared <= most[rest]) & (of[rest] != of[i])
            hit &= (half[rest] == 0) if half[i] == 0 else (half[rest] != half[i])
            found = np.flatnonzero(hit)
            if len(found) and before.shape[1]:
                met = before[member[found + i + 1]] @ before[member[i]]
                found = found[met == 0]
            if len(found):
                other = name[found + i + 1]
                yield np.minimum(name[i], other), np.maximum(name[i], other), shared[found]


def earlier_keys(keys: list[np.ndarray], key: int) -> np.ndarray:
    """Which of the keys below ``key`` that two members at least have each member has."""
    sizes = [len(k) for k in keys]
    flat = np.concatenate([np.asarray(k, dtype=np.int64) for k in keys])
    member = np.repeat(np.arange(len(keys)), sizes)
    member, flat = member[flat < key], flat[flat < key]
    value, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    out = np.zeros((len(keys), int(shared.sum())), dtype=np.float32)
    some = shared[at]
    out[member[some], column[at[some]]] = 1
    return out


def _across(apart: DataFrame, words: DataFrame, stages: Stages, least: float) -> DataFrame:
    """``a, b, hope``: pairs of members of one bucket in different classes that may be
    alike, each once, and the words that they may share.

    ``apart`` has ``key, size, node, n, root``.  A bucket of up to ``MEMBERS`` is
    compared as one; a larger one is dealt by steps of length into parts of about that
    size, and each two parts whose lengths are near enough are compared.
    """
    some = apart.select(F.col("node").alias("x")).distinct()
    with small_batches(stages.spark):
        counts = stages.write(_counted(words.join(some, F.col("node") == F.col("x"), "left_semi")), "word-counts")
    # At most as many open buckets as a text has sketches.
    open_of = apart.groupBy(F.col("node").alias("kn")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    counts = counts.join(open_of, F.col("cn") == F.col("kn")).drop("kn")
    small = apart.where(F.col("size") <= MEMBERS).select(
        F.xxhash64("key").alias("g"), "key", F.lit(0).alias("side"), "node", "n", "root"
    )
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(least)) + 1e-9).cast("int")
    large = apart.where(F.col("size") > MEMBERS).withColumn("step", step)
    # One number for each bucket and step of length: lengths are bounded, so are steps.
    sizes = large.groupBy(F.col("key").alias("sk"), "step").agg(F.count(F.lit(1)).alias("c"))
    parts = sizes.groupBy("sk").agg(
        F.map_from_entries(F.collect_list(F.struct("step", F.ceil(F.col("c") / MEMBERS).cast("int")))).alias("parts")
    )
    parts = stages.write(parts, "parts")
    dealt = large.join(parts, F.col("key") == F.col("sk"))
    n_parts = lambda at: F.coalesce(F.try_element_at("parts", at), F.lit(0))
    own = F.pmod(F.xxhash64("node"), F.coalesce(F.try_element_at("parts", F.col("step")), F.lit(1))).cast("int")
    dealt = dealt.withColumn("own", own)
    one = lambda t, p, u, q, side: F.struct(
        F.xxhash64("key", t, p, u, q).alias("g"), side.alias("side")
    )
    numbers = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda q: q < n)
    at, up, down = F.col("step"), F.col("step") + 1, F.col("step") - 1
    here = F.transform(
        numbers(n_parts(at)),
        lambda q: one(
            at,
            F.least(q, F.col("own")),
            at,
            F.greatest(q, F.col("own")),
            F.when(q == F.col("own"), 0).when(F.col("own") < q, 1).otherwise(2),
        ),
    )
    above = F.transform(numbers(n_parts(up)), lambda q: one(at, F.col("own"), up, q, F.lit(1)))
    below = F.transform(numbers(n_parts(down)), lambda q: one(down, q, at, F.col("own"), F.lit(2)))
    big = dealt.select(F.explode(F.concat(here, above, below)).alias("x"), "key", "node", "n", "root").select(
        "x.g", "key", "x.side", "node", "n", "root"
    )
    rows = small.unionByName(big).join(counts, F.col("node") == F.col("cn")).drop("cn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if group["root"].nunique() > 1:
                for a, b, hope in may_be_alike({c: group[c].to_numpy() for c in group.columns}, least):
                    yield pd.DataFrame({"a": a, "b": b, "hope": hope})

        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held["g"].iloc[-1] if len(held) else None
            whole = held[held["g"] != last]
            held = held[held["g"] == last]
            for _, group in whole.groupby(["g", "key"], sort=False):
                yield from found(group)
        if held is not None and len(held):
            for _, group in held.groupby(["g", "key"], sort=False):
                yield from found(group)

    grouped = rows.repartition("g").sortWithinPartitions("g")
    return grouped.mapInPandas(run, "a long, b long, hope int")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs`` with its class of near-duplicates.

    Returns ``doc_id``, ``class_id`` (least id of the class; null only if all are),
    ``class_size``, ``kept`` (true for one row of each class, one with the least
    id) and ``text_key``.  Texts with the same words, whatever their case and
    punctuation, are one class; texts without words only if they are equal.  A
    null text counts as empty.  Texts of fewer than five words and pairs without
    a common run of five words have no other links.  Repeated rows are one class.
    Other columns are not read; an empty table gives no rows.
    """
    stages = Stages(docs.sparkSession)
    text = text_or_empty(text_col)
    words = words_of(text)
    tokens = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.unhex(F.md5(text.cast("binary"))).alias("raw"),
        words.alias("w"),
    ).select(
        "row",
        "doc_id",
        "text_key",
        F.when(F.size("w") > 0, F.unhex(F.md5(F.array_join("w", " ").cast("binary"))))
        .otherwise(F.concat(F.lit("raw").cast("binary"), F.col("raw")))
        .alias("digest"),
        F.transform("w", lambda x: F.hash(x)).alias("words"),
    )
    tokens = stages.write(tokens, "tokens")
    plain = stages.write(tokens.drop("words"), "rows")
    with small_batches(docs.sparkSession):
        nodes = stages.write(
            _sketched(tokens).groupBy("digest").agg(
                F.min("row").alias("node"), F.first("sketches").alias("sketches"), F.max("n").alias("n")
            ),
            "nodes",
        )
    # One text of each digest; the words of the other rows are not needed any more.
    first = nodes.select(F.col("node").alias("x"))
    texts = stages.write(
        tokens.select(F.col("row").alias("node"), "words").join(first, F.col("node") == F.col("x"), "left_semi"),
        "words",
    )
    stages.drop(tokens)
    roots = linked(nodes, texts, stages, least)
    by_digest = stages.write(
        plain.groupBy(F.col("digest").alias("d")).agg(F.min("row").alias("first"))
        .join(roots, F.col("first") == F.col("node"), "left")
        .select("d", F.coalesce("root", "first").alias("root")),
        "class-roots",
    )
    rows = stages.write(
        plain.join(by_digest, F.col("digest") == F.col("d")).drop("d", "digest"),
        "class-rows",
    )
    stages.drop(plain, by_digest, roots)
    heads = stages.write(
        rows.groupBy(F.col("root").alias("r"))
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"),
            F.count(F.lit(1)).alias("class_size"),
        ),
        "class-heads",
    )
    return rows.join(heads, F.col("root") == F.col("r")).select(
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        F.col("class_size").cast("long").alias("class_size"),
        (F.col("row") == F.col("head.row")).alias("kept"),
        "text_key",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, columns unchanged.

    The row with the least id stays, a null id only if the class has no other; of rows
    that repeat id and text, one.  Null, empty and wordless texts, very long and short
    ones as in ``near_classes``.  An empty table stays empty, and columns may have any
    names.
    """
    found = near_classes(docs)
    copies = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("kept").cast("int")).alias("n_out")
    )
    return apply_copies(docs, copies)
