"""Best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so the packing of a whole corpus
follows from how many pieces there are of each length.  Best-fit decreasing is
run on those counts: a segment tree over remaining capacities finds the tightest
open bins in logarithmic time, and every group of equal bins is filled at once.
The outcome (which ranks of a length go to which bins) is a plan whose size
depends on the capacity, not on the corpus; Spark joins pieces to it by length
and rank.  The result equals placing all pieces of the corpus one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage

CAPACITY = 2048
#: Pieces of one length that are numbered together; more are dealt into parts.
PART_ROWS = 1_000
#: Written after each document.
END_ID = 0
_SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class SegmentTree:
    """Which remaining capacities have open bins; the least at or above a need."""

    def __init__(self, capacity: int):
        self.base = 1
        while self.base <= capacity:
            self.base *= 2
        self.any = [False] * (2 * self.base)

    def set(self, key: int, value: bool) -> None:
        node = key + self.base
        self.any[node] = value
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def least_from(self, key: int) -> int | None:
        node = key + self.base
        if self.any[node]:
            return key
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.base:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.base


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (pieces of each length); of equally
    tight bins the one opened first is filled.

    Rows ``(length, first_rank, last_rank, first_bin, per_bin, offset)``: rank
    ``r`` of a length goes to bin ``first_bin + (r - first_rank) // per_bin``, at
    ``offset + (r - first_rank) % per_bin * length``.
    """
    tree = SegmentTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining: [(first bin, bins)]
    bins = 0
    plan = []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            if not open_bins.setdefault(remaining, []):
                tree.set(remaining, True)
            heappush(open_bins[remaining], (first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.least_from(length)
            if remaining is None:
                remaining = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = heappop(open_bins[remaining])
                if not open_bins[remaining]:
                    tree.set(remaining, False)
            per_bin = remaining // length
            full = min(n, left // per_bin)
            offset = capacity - remaining
            if full:
                plan.append((length, rank, rank + full * per_bin - 1, first, per_bin, offset))
                rank, left = rank + full * per_bin, left - full * per_bin
                put(remaining - per_bin * length, first, full)
                first, n = first + full, n - full
            if n and left:
                plan.append((length, rank, rank + left - 1, first, left, offset))
                put(remaining - left * length, first, 1)
                rank, left = rank + left, 0
                first, n = first + 1, n - 1
            put(remaining, first, n)
    return plan


def piece_starts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document; only the first may be short."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenizer(path: str):
    """Text to ids, as the tokenizer file gives them without added special tokens.

    Reads the vocabulary and merges of the file.  A text that spells a special
    token goes through the file's own tokenizer.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    own = Tokenizer.from_file(path)
    shown = _byte_of_letter()
    if {*shown} != {*ByteLevel.alphabet()}:
        raise ValueError("not a byte-level vocabulary")
    ranks = {
        bytes(shown[c] for c in piece): i
        for piece, i in own.get_vocab(with_added_tokens=False).items()
        if piece != _SPECIAL
    }
    fast = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if _SPECIAL in text:
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def _byte_of_letter() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenize(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """Pieces of all documents; ``row`` numbers the rows of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        ids_of = tokenizer(path)
        for batch in batches:
            out = []
            for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
                ids = np.array(ids_of(text) + [END_ID], dtype="<u4")
                for k, (start, n) in enumerate(piece_starts(len(ids), capacity)):
                    out.append((doc_id, row, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            pieces = pd.DataFrame(out, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
            pieces["doc_id"] = pieces["doc_id"].astype("Int64")
            yield pieces

    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return slim.mapInPandas(run, PIECES)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there.

    A document is its token ids, then id 0; a null text counts as empty.  Longer
    ones than ``capacity`` are cut into pieces of that length, the first one
    shorter.  Sequences are filled best-fit decreasing over the whole table.
    Repeated rows are separate documents.  Returns ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset``; other columns are not read and an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = stage(tokenize(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Pieces that fill a sequence alone need no rank, however many there are.
    full = pieces.where(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity)
    # One row per length, so at most as many as the capacity.
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealing = spark.createDataFrame([(k, -(-n // PART_ROWS)) for k, n in counts.items()], "dealt_length long, parts long")
    part = F.pmod(F.xxhash64("row", "piece"), F.col("parts"))
    dealt = rest.join(F.broadcast(dealing), F.col("length") == F.col("dealt_length")).withColumn("part", part)
    dealt = dealt.drop("dealt_length", "parts")
    # Ranks of a length: places within its parts plus the sizes of earlier parts.
    sizes = stage(dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(
        F.col("length").alias("l"), F.col("part").alias("p"), "before"
    )
    plan = spark.createDataFrame(
        best_fit_plan(counts, capacity),
        "pl long, first_rank long, last_rank long, first_bin long, per_bin long, at long",
    )
    # A rank finds its row of the plan in an array per length, of bounded size.
    by_length = plan.groupBy("pl").agg(
        F.sort_array(F.collect_list(F.struct("first_rank", "last_rank", "first_bin", "per_bin", "at"))).alias("runs")
    )
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "piece")) - 1
    starts = starts.join(by_length, F.col("l") == F.col("pl")).select("l", "p", "before", "runs")
    ranked = (
        dealt.withColumn("place", place)
        .join(starts, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
        .withColumn("rank", F.col("before") + F.col("place"))
        .withColumn(
            "run",
            F.filter("runs", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") <= r["last_rank"]))[0],
        )
    )
    nth = F.col("rank") - F.col("run.first_rank")
    placed = ranked.select(
        *columns,
        (F.col("run.first_bin") + F.floor(nth / F.col("run.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + nth % F.col("run.per_bin") * F.col("length")).cast("long").alias("offset"),
    )
    return full.unionByName(placed)
