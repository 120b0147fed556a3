"""Language-model scores by stupid backoff over corpus-wide n-gram counts.

    S(w | context) = c(context w) / c(context)   if c(context w) > 0
                   = BACKOFF * S(w | shorter context)   otherwise

Counts are those of the whole corpus without the document that is scored, so a
document does not vouch for itself.  Documents are read in chunks of bounded
size.  A chunk sends each of its distinct n-grams, once and with its count, to the
table partition of the n-gram's hash; the partition adds up the counts of all
chunks and answers each; the chunk joins the answers to its n-grams and sums the
scores per document.  A frequent n-gram therefore reaches its partition once a
chunk, however often it occurs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .neardup import words_of

#: Longest n-gram, factor of each step back.
ORDER, BACKOFF = 2, 0.4
#: Words of a chunk, about; words of the corpus for each partition of a table.
CHUNK_WORDS = 3 << 19
TABLE_ROWS = 1 << 21

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, equal places of all numbers together."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return values.dtype.str.encode() + b":" + zlib.compress(raw.T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    kind, _, data = bytes(blob).partition(b":")
    dtype = np.dtype(kind.decode())
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(words: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each document, and the place of their last word."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    h = words.copy()
    for n in range(1, order):
        h = _mixed(h[: len(words) - n] * _MIX + words[n:]) if len(words) > n else h[:0]
    last = np.arange(order - 1, order - 1 + len(h))
    inside = doc[last] == doc[last - order + 1]
    return h[inside], last[inside]


def chunks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``chunk, n_words, ids, sizes, vocabulary, codes``: documents as packed word hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(rows: list) -> pd.DataFrame:
            sizes = np.array([len(w) for _, _, w in rows], dtype=np.int32)
            words = np.concatenate([w for _, _, w in rows]).view(np.uint64)
            vocabulary, inverse, n = np.unique(words, return_inverse=True, return_counts=True)
            by_count = np.argsort(-n, kind="stable")  # frequent words get small codes
            rank = np.empty(len(n), dtype=np.uint32)
            rank[by_count] = np.arange(len(n), dtype=np.uint32)
            return pd.DataFrame(
                {
                    "chunk": [rows[0][0]],
                    "n_words": [int(sizes.sum())],
                    "ids": [_packed(np.array([-1 if i is None else i for _, i, _ in rows], dtype=np.int64))],
                    "no_id": [_packed(np.array([i is None for _, i, _ in rows]))],
                    "sizes": [_packed(sizes)],
                    "vocabulary": [vocabulary[by_count].tobytes()],
                    "codes": [_packed(rank[inverse])],
                }
            )

        rows, n = [], 0
        for batch in batches:
            for row, i, w in zip(batch["row"], batch["doc_id"], batch["words"], strict=True):
                if rows and n + len(w) > CHUNK_WORDS:
                    yield emit(rows)
                    rows, n = [], 0
                rows.append((row, None if pd.isna(i) else int(i), np.asarray(w, dtype=np.int64)))
                n += len(w)
        if rows:
            yield emit(rows)

    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.transform(words_of(text_or_empty(text_col)), lambda w: F.xxhash64(w)).alias("words"),
    )
    return slim.mapInPandas(
        run,
        "chunk long, n_words long, ids binary, no_id binary, sizes binary, vocabulary binary, codes binary",
    )


def _open(r) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(r.vocabulary, dtype=np.uint64)[_unpacked(r.codes)]
    return words, _unpacked(r.sizes)


def counted(chunks: DataFrame, order: int, parts: int) -> DataFrame:
    """Totals over all chunks of each chunk's distinct n-grams.

    ``chunk, n, part, totals``, the totals in the order of the hashes of that
    part.  An n-gram belongs to the part that its hash falls in.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = (np.arange(1, parts) * (2.0**64 / parts)).astype(np.uint64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                words, sizes = _open(r)
                for n in range(1, order + 1):
                    distinct, count = np.unique(ngrams(words, sizes, n)[0], return_counts=True)
                    cuts = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
                    full = np.flatnonzero(np.diff(cuts))
                    spans = [(cuts[i], cuts[i + 1]) for i in full]
                    yield pd.DataFrame(
                        {
                            "chunk": r.chunk,
                            "n": n,
                            "part": full,
                            "hashes": [distinct[a:b].tobytes() for a, b in spans],
                            "counts": [_packed(count[a:b].astype(np.uint32)) for a, b in spans],
                        }
                    )

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", kind="stable")
        hashes = [np.frombuffer(h, dtype=np.uint64) for h in rows["hashes"]]
        counts = np.concatenate([_unpacked(c) for c in rows["counts"]])
        table, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(table)).astype(np.int64)[inverse]
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        return pd.DataFrame(
            {
                "chunk": rows["chunk"],
                "n": rows["n"],
                "part": rows["part"],
                "totals": [_packed(t) for t in np.split(total, ends)],
            }
        )

    asked = chunks.select("chunk", "sizes", "vocabulary", "codes").mapInPandas(
        ask, "chunk long, n int, part int, hashes binary, counts binary"
    )
    return asked.groupBy("n", "part").applyInPandas(answer, "chunk long, n int, part int, totals binary")


def chunk_scores(
    words: np.ndarray, sizes: np.ndarray, totals: dict[int, np.ndarray], corpus: int, backoff: float
) -> tuple[np.ndarray, np.ndarray]:
    """Per document, the sum of ln S over its words and how many of them follow a
    context seen in another document (by the longest n-gram that fits).

    ``totals`` has, by order, the corpus counts of the chunk's distinct n-grams in
    the order of their hashes.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    others = np.maximum(corpus - sizes[doc], 1).astype(float)
    order = max(totals)
    seen: dict[int, np.ndarray] = {}  # by order, at the place of the last word: count elsewhere
    for n in range(1, order + 1):
        h, last = ngrams(words, sizes, n)
        distinct, inverse = np.unique(h, return_inverse=True)
        own_key = doc[last].astype(np.int64) * max(len(distinct), 1) + inverse
        _, own, times = np.unique(own_key, return_inverse=True, return_counts=True)
        elsewhere = np.zeros(len(words), dtype=np.int64)
        elsewhere[last] = totals[n][inverse] - times[own]
        seen[n] = elsewhere
    # A word that no other document has counts as if it had been seen once.
    log_s = np.log(np.maximum(seen[1], 1) / others)
    place = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[doc]
    top = seen[1] > 0
    for n in range(2, order + 1):
        fits = place >= n - 1
        here = fits & (seen[n] > 0)
        context = np.roll(seen[n - 1], 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.log(seen[n] / context)
        log_s = np.where(here, direct, np.where(fits, np.log(backoff) + log_s, log_s))
        top = np.where(fits, here, top)
    return (
        np.bincount(doc, weights=log_s, minlength=len(sizes)),
        np.bincount(doc, weights=top, minlength=len(sizes)).astype(np.int64),
    )


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    backoff: float = BACKOFF,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, log_sum, score, n_seen`` for every row of ``docs``.

    Words are lower-cased runs of letters and digits.  ``log_sum`` is the sum of
    ln S over the words, ``score`` its mean (null without words), ``n_seen`` the
    words whose longest fitting n-gram occurs in another document.  The first
    words of a document have shorter contexts.  A null text counts as empty;
    repeated rows are separate documents.  Other columns are not read; an empty
    table gives no rows.
    """
    chunks = stage(chunks_of(docs, id_col, text_col), "lm-chunks")
    corpus = chunks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-corpus // TABLE_ROWS))
    totals = counted(chunks, order, parts)

    def score(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r = next(chunk.itertuples(index=False))
        words, sizes = _open(r)
        answers = answers.sort_values(["n", "part"])
        by_order = {n: np.zeros(0, dtype=np.int64) for n in range(1, order + 1)} | {
            n: np.concatenate([_unpacked(t) for t in part["totals"]]) for n, part in answers.groupby("n")
        }
        log_sum, n_seen = chunk_scores(words, sizes, by_order, corpus, backoff)
        ids = pd.array(_unpacked(r.ids), dtype="Int64")
        ids[_unpacked(r.no_id)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_words": sizes, "log_sum": log_sum, "n_seen": n_seen})

    scored = (
        chunks.groupBy("chunk")
        .cogroup(totals.groupBy("chunk"))
        .applyInPandas(score, "doc_id long, n_words long, log_sum double, n_seen long")
    )
    return scored.select(
        "doc_id",
        "n_words",
        "log_sum",
        F.when(F.col("n_words") > 0, F.col("log_sum") / F.col("n_words")).alias("score"),
        "n_seen",
    )
