"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are summed by membership pattern (the set of sources a document belongs
to).  Patterns supply words, once per repetition and at a cost that rises with
each; sources demand their targets.  A minimum-cost flow routes supply to demand
through memberships, so that no word is repeated while an unrepeated one can take
its place.  The flow runs on patterns and sources only; documents are then chosen
in seeded order until the words of their pattern are reached.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apply_copies, small_batches, stage, text_or_empty

#: Weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken so many times at most.
MAX_REPEATS = 3
#: Patterns and sources that the flow network may have: it is solved on the
#: driver, so a column of unbounded names is refused, not cut.  Tables of one row
#: per pattern are therefore small enough to broadcast.
MAX_NODES = 20_000
#: Bits of the seeded order that one histogram resolves.
BITS = 12


def word_counts(docs: DataFrame, columns: Sequence[str | Column], text_col: str = "text") -> DataFrame:
    """``columns`` of every row with ``size``, its runs of non-blank characters.

    Blank is space and U+0009 to U+000D; a null text has none.
    """
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([len(t.split()) for t in batch], dtype="int64")

    return docs.select(*columns, count(text_or_empty(text_col).cast("binary")).alias("size"))


def capped_targets(sizes: dict, weights: dict, cap: float = MAX_REPEATS) -> dict:
    """Shares of the total size by weight, none above ``cap`` times its size.

    What a capped source can't take is shared among the others by weight, until
    none is above.  An empty source gets nothing.
    """
    total = float(sum(sizes.values()))
    target, free, left = {}, set(sizes), total
    while free:
        weight = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / weight > cap * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / weight for s in free}
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc ``(from, to, capacity, cost)``: most flow at least cost.

    Successive shortest paths; costs are not negative at the start.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    while True:
        dist, via, queue, queued = [None] * n, [0] * n, deque([source]), [False] * n
        dist[source] = 0
        while queue:
            u = queue.popleft()
            queued[u] = False
            for e in out[u]:
                v = to[e]
                if cap[e] and (dist[v] is None or dist[u] + cost[e] < dist[v]):
                    dist[v], via[v] = dist[u] + cost[e], e
                    if not queued[v]:
                        queued[v] = True
                        queue.append(v)
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        push, v = None, sink
        while v != source:
            push = cap[via[v]] if push is None else min(push, cap[via[v]])
            v = to[via[v] ^ 1]
        v = sink
        while v != source:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]


def route(supply: dict[tuple, int], quota: dict, repeats: int = MAX_REPEATS) -> dict[tuple, dict]:
    """Words that each pattern gives to each source.

    ``supply``: words of each pattern (a tuple of sources).  Its k-th repetition
    costs k * k a word, so repetition is spread before it is deepened.  Patterns that
    share no source, directly or through others, are routed on their own; one that
    alone feeds its only source needs no flow.
    """
    out: dict[tuple, dict] = {}
    for patterns, names in overlapping(supply, quota):
        if len(patterns) == len(names) == 1:
            words = min(quota[names[0]], repeats * supply[patterns[0]])
            out[patterns[0]] = {names[0]: words} if words else {}
        else:
            out |= _route_group(patterns, names, supply, quota, repeats)
    return {p: out[p] for p in supply}


def overlapping(supply: dict[tuple, int], quota: dict) -> list[tuple[list, list]]:
    """Patterns and sources in groups that overlap, in the order of the patterns."""
    head = {s: s for s in quota}

    def find(s):
        while head[s] != s:
            head[s] = head[head[s]]
            s = head[s]
        return s

    for p in supply:
        for s in p[1:]:
            head[find(s)] = find(p[0])
    groups: dict = {}
    for p in supply:
        groups.setdefault(find(p[0]), ([], []))[0].append(p)
    for s in quota:
        if find(s) in groups:
            groups[find(s)][1].append(s)
    return list(groups.values())


def _route_group(patterns: list, names: list, supply: dict, quota: dict, repeats: int) -> dict[tuple, dict]:
    place = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    arcs, links = [], []
    for i, p in enumerate(patterns):
        arcs += [(0, 1 + i, supply[p], k * k) for k in range(repeats)]
    for i, p in enumerate(patterns):
        for s in p:
            links.append((len(arcs), p, s))
            arcs.append((1 + i, place[s], repeats * supply[p], 0))
    arcs += [(place[s], sink, quota[s], 0) for s in names]
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for at, p, s in links:
        if flow[at]:
            out[p][s] = flow[at]
    return out


def whole_quota(target: dict) -> dict:
    """Targets as whole words with the same total, the largest remainders up."""
    low = {s: int(t) for s, t in target.items()}
    spare = round(sum(target.values())) - sum(low.values())
    for s in sorted(target, key=lambda s: low[s] - target[s])[: max(0, spare)]:
        low[s] += 1
    return low


def plan_mix(
    patterns: DataFrame, weights: dict | Sequence[float], repeats: int = MAX_REPEATS
) -> list[tuple]:
    """What to take of each membership pattern.

    ``patterns``: ``pattern, sources, size``.  A sequence of ``weights`` is dealt
    to the sources in order of code points, null last.  A document counts in full
    in the size of each of its sources.  Rows ``(pattern, source_size, target,
    rounds, need)``: whole rounds, and words to take in the round after them.
    """
    rows = patterns.limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} membership patterns: group rare sources first")
    supply = {tuple(r["sources"]): r["size"] for r in rows}
    sizes: dict = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    if not isinstance(weights, dict):
        weights = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    target = capped_targets(sizes, weights, repeats)
    flows = route(supply, whole_quota(target), repeats)
    out = []
    for r in rows:
        p = tuple(r["sources"])
        words, n = sum(flows[p].values()), supply[p]
        rounds, need = divmod(words, n) if n else (0, 0)
        out.append((r["pattern"], sizes[p[0]], float(target[p[0]]), rounds, need))
    return out


def _cut(sums: DataFrame, need: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per pattern, where in ``order`` the running ``size`` passes ``need``.

    ``sums`` is already summed and has a bounded number of rows per pattern.
    Adds ``before`` (words ahead) and keeps only the row in which ``need`` lies.
    """
    run = Window.partitionBy("pattern").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sums.withColumn("_upto", F.sum("size").over(run))
        .withColumn("before", F.col("_upto") - F.col("size"))
        .where((F.col("before") < F.col(need)) & (F.col("_upto") >= F.col(need)))
        .select("pattern", need, *order, *keep, "before")
    )


def mix(
    docs: DataFrame,
    weights: dict | Sequence[float] = WEIGHTS,
    repeats: int = MAX_REPEATS,
    seed: int = 7,
    id_col: str = "doc_id",
    source: str | Column = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: how often the mix takes it.

    ``source`` is a column of names or of arrays of names (overlapping sources;
    null and empty arrays are the source null).  The words of a pattern are taken
    in whole rounds, then in the order of a seeded hash of id and text, past those
    that do not fit what is left, and last the one of the nearest size.  Returns
    ``doc_id, size, source_size, target, taken, copies, text_key``; ``taken`` is
    ``copies * size``, the sizes and targets are those of the row's first source.
    A document without words is taken 0 times.  Repeated rows are separate
    documents.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = F.col(source) if isinstance(source, str) else source
    nobody = F.array(F.lit(None).cast("string"))
    if docs.select(names.alias("s")).schema["s"].dataType.typeName() == "array":
        sources = F.when(F.size(names) > 0, F.array_sort(F.array_distinct(names))).otherwise(nobody)
    else:
        sources = F.array(names)
    text_key = F.xxhash64(text_or_empty(text_col))
    key = F.xxhash64(F.lit(seed), F.col(id_col), text_key)
    named = F.transform("sources", lambda s: F.coalesce(F.concat(F.length(s), F.lit(":"), s), F.lit("-")))
    with small_batches(spark):
        slim = stage(
            word_counts(
                docs,
                [
                    F.monotonically_increasing_id().alias("row"),
                    F.col(id_col).alias("doc_id"),
                    sources.alias("sources"),
                    text_key.alias("text_key"),
                    key.alias("key"),
                ],
                text_col,
            ).withColumn("pattern", F.array_join(named, ",")),
            "mix-rows",
        )
    patterns = slim.groupBy("pattern", "sources").agg(F.sum("size").alias("size"))
    plan = stage(
        spark.createDataFrame(
            plan_mix(patterns, weights, repeats),
            "_p string, source_size long, target double, rounds long, need long",
        ),
        "mix-plan",
    )
    high = F.shiftrightunsigned("key", 64 - BITS).cast("int")
    low = F.shiftrightunsigned("key", 64 - 2 * BITS).cast("int") % (1 << BITS)
    rows = slim.withColumn("high", high).withColumn("low", low)
    needs = plan.select("_p", "need")
    chosen, cuts = _in_order(rows, needs)
    got = chosen.groupBy(F.col("pattern").alias("_g")).agg(F.sum("size").alias("got"))
    rest = cuts.join(got, F.col("_p") == F.col("_g"), "left").select(
        "_p", "cut1", "cut2", (F.col("need2") - F.coalesce("got", F.lit(0))).alias("left_over")
    )
    state = (
        rows.join(F.broadcast(rest), F.col("pattern") == F.col("_p"), "left")
        .join(chosen.select("chosen_row"), F.col("row") == F.col("chosen_row"), "left")
        .drop("_p")
        .withColumn(
            "extra",
            F.coalesce(
                (F.col("high") < F.col("cut1"))
                | ((F.col("high") == F.col("cut1")) & (F.col("low") < F.col("cut2")))
                | F.col("chosen_row").isNotNull(),
                F.lit(False),
            ),
        )
    )
    state = stage(state.drop("sources"), "mix-state")
    top = _fill(
        state.where(~F.col("extra") & (F.col("size") > 0) & (F.col("left_over") > 0)).select(
            "pattern", "key", "row", "size", "high", "low"
        ),
        rest.select(F.col("_p").alias("pattern"), "left_over"),
    )
    extra = F.col("extra") | F.col("top_row").isNotNull()
    copies = F.when(F.col("size") > 0, F.col("rounds") + extra.cast("long")).otherwise(0).cast("long")
    return (
        state.join(top, F.col("row") == F.col("top_row"), "left")
        .join(F.broadcast(plan), F.col("pattern") == F.col("_p"))
        .withColumn("copies", copies)
        .select(
            "doc_id", "size", "source_size", "target",
            (F.col("copies") * F.col("size")).alias("taken"), "copies", "text_key",
        )
    )


def _in_order(rows: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the words that each pattern ``needs`` (``_p, need``) end in the seeded order.

    The order is cut in a bucket ``cut1, cut2`` of two histograms; rows of the
    buckets before are within the need, and of that bucket the ``chosen`` rows.
    """
    # The words still needed end in one bucket of the order, then in one bucket of that.
    first = rows.groupBy("pattern", "high").agg(F.sum("size").alias("size"))
    first = first.join(needs, F.col("pattern") == F.col("_p")).where("need > 0")
    cut1 = stage(
        _cut(first, "need", ["high"]).select(
            F.col("pattern").alias("_p"), F.col("high").alias("cut1"), (F.col("need") - F.col("before")).alias("need1")
        ),
        "mix-cut1",
    )
    second = rows.join(F.broadcast(cut1), (F.col("pattern") == F.col("_p")) & (F.col("high") == F.col("cut1")))
    second = second.groupBy("pattern", "need1", "low").agg(F.sum("size").alias("size"))
    cut2 = stage(
        _cut(second, "need1", ["low"]).select(
            F.col("pattern").alias("_p2"), F.col("low").alias("cut2"), (F.col("need1") - F.col("before")).alias("need2")
        ),
        "mix-cut2",
    )
    cuts = cut1.join(cut2, F.col("_p") == F.col("_p2")).drop("_p2")
    # Rows of that bucket one by one: repeats share a key, so they are numbered
    # within their input partition and counted across partitions.
    last = (
        rows.join(F.broadcast(cuts), (F.col("pattern") == F.col("_p")) & (F.col("high") == F.col("cut1")) & (F.col("low") == F.col("cut2")))
        .withColumn("part", F.shiftright("row", 33))
        .select("pattern", "need2", "key", "part", "row", "size")
    )
    groups = last.groupBy("pattern", "need2", "key", "part").agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("pattern").orderBy("key", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        F.col("pattern").alias("gp"), F.col("key").alias("gk"), F.col("part").alias("gq"),
        F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"),
    )
    in_part = Window.partitionBy("pattern", "key", "part").orderBy("row")
    chosen = stage(
        last.withColumn("own", F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
        .join(groups, (F.col("pattern") == F.col("gp")) & (F.col("key") == F.col("gk")) & (F.col("part") == F.col("gq")))
        .withColumn("upto", F.col("ahead") + F.col("own"))
        .where(F.col("upto") <= F.col("need2"))
        .select(F.col("row").alias("chosen_row"), "pattern", "need2", "size"),
        "mix-chosen",
    )
    return chosen, cuts


def _fill(spare: DataFrame, lack: DataFrame) -> DataFrame:
    """``top_row``: more documents of ``spare`` for the words that each pattern lacks.

    The seeded order goes on past documents that do not fit: those of the others
    that fit are taken in order, until none fits what is still lacking.  Last comes
    the one whose size is nearest to that, where taking it brings the words nearer.
    """
    picks = None
    fitting = spare
    while True:
        open_ = lack.where("left_over > 0").select(F.col("pattern").alias("_l"), "left_over")
        fitting = fitting.select("pattern", "key", "row", "size", "high", "low").join(
            F.broadcast(open_), F.col("pattern") == F.col("_l")
        )
        fitting = stage(fitting.where(F.col("size") <= F.col("left_over")).drop("_l"), "mix-fitting")
        needs = stage(
            fitting.groupBy(F.col("pattern").alias("_p"), "left_over")
            .agg(F.sum("size").alias("all"))
            .select("_p", F.least("all", "left_over").alias("need")),
            "mix-needs",
        )
        if not needs.take(1):
            break
        chosen, cuts = _in_order(fitting.drop("left_over"), needs)
        before = (F.col("high") < F.col("cut1")) | ((F.col("high") == F.col("cut1")) & (F.col("low") < F.col("cut2")))
        marked = stage(
            fitting.drop("left_over")
            .join(F.broadcast(cuts.select("_p", "cut1", "cut2")), F.col("pattern") == F.col("_p"))
            .join(chosen.select("chosen_row"), F.col("row") == F.col("chosen_row"), "left")
            .withColumn("fits", before | F.col("chosen_row").isNotNull()),
            "mix-marked",
        )
        now = marked.where("fits").select(F.col("row").alias("top_row"))
        picks = now if picks is None else picks.unionByName(now)
        got = marked.where("fits").groupBy(F.col("pattern").alias("_b")).agg(F.sum("size").alias("got"))
        lack = stage(
            lack.join(got, F.col("pattern") == F.col("_b"), "left").select(
                "pattern", (F.col("left_over") - F.coalesce("got", F.lit(0))).alias("left_over")
            ),
            "mix-lack",
        )
        fitting = marked.where("not fits")
    near = spare.join(
        F.broadcast(lack.where("left_over > 0").select(F.col("pattern").alias("_l"), "left_over")),
        F.col("pattern") == F.col("_l"),
    )
    if picks is not None:
        near = near.join(picks.select(F.col("top_row").alias("_taken")), F.col("row") == F.col("_taken"), "left_anti")
    gap = F.abs(F.col("size") - F.col("left_over"))
    best = stage(
        near.where(gap < F.col("left_over"))
        .groupBy("pattern")
        .agg(F.min(F.struct(gap.alias("gap"), "key", "row")).alias("m"))
        .select(F.col("m.row").alias("top_row")),
        "mix-fill",
    )
    return best if picks is None else picks.unionByName(best)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: rows repeated or left out, columns unchanged.

    Cases are those of ``mix``: a null or empty text has size 0 and is taken with its
    round, a null source is a source, very long texts count whole, ties are broken by
    the seeded hash.  Repeated rows share what the mix takes of them; rows equal in id
    and text are merged before they are multiplied.  An empty table stays empty, and
    columns may have any names.
    """
    mixed = mix(docs, **options)
    copies = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("copies").alias("n_out")
    )
    return apply_copies(docs, copies)
