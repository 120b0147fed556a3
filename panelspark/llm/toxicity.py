"""Toxicity scores by non-negative positive-unlabelled learning.

Labels confirm some toxic texts; everything else is unlabelled, not clean.  A
linear model on the words of a text is trained with numpy on a bounded sample of
confirmed and unlabelled texts, minimising the class-prior-corrected risk

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

whose second term is kept from going negative.  Spark draws the sample, counts
its words and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, text_or_empty

#: Bounds of the training sample: confirmed toxic and unlabelled texts.
MAX_POSITIVE = 5_000
MAX_UNLABELLED = 20_000
#: Words that the model weighs at most, and what a word must show in the sample:
#: texts of the toxic part, and a log-likelihood ratio between the parts.
MAX_WORDS = 4_096
MIN_TEXTS = 3
MIN_RATIO = 12.0
#: Gradient steps, their size, and the weight of the squared coefficients.
STEPS, RATE, SHRINK = 250, 0.1, 3e-4
#: Every fifth id is held out: its label is never read.
FOLDS = 5

_WORD = re.compile(r"\w+")


def words_in(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo ``FOLDS`` (null: 1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(1))


@dataclass
class Model:
    """Weights of words and the intercept; without words, one score for all."""

    intercept: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        known = self.weights.keys() & words_in(text)
        g = self.intercept + math.fsum(self.weights[w] for w in known)
        return 1 / (1 + math.exp(-min(max(g, -30.0), 30.0)))


def log_ratio(k1: int, n1: int, k0: int, n0: int) -> float:
    """Twice the log-likelihood ratio of two shares against a common one."""
    both = (k1 + k0) / (n1 + n0)
    return 2 * sum(k * math.log(k / (n * both)) for k, n in ((k1, n1), (k0, n0)) if k)


def nnpu(
    features: list[np.ndarray], positive: np.ndarray, prior: float, columns: int, steps: int = STEPS
) -> tuple[np.ndarray, float]:
    """Weights and intercept from the feature ids of each text of the sample.

    ``positive`` marks the confirmed texts; the others are unlabelled.
    """
    sizes = np.array([len(f) for f in features])
    flat = np.concatenate(features).astype(np.int64) if sizes.sum() else np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(features)), sizes)
    pos, unl = positive, ~positive
    w, b = np.zeros(columns), math.log(prior / (1 - prior))
    moment, square = np.zeros(columns + 1), np.zeros(columns + 1)
    for t in range(1, steps + 1):
        g = b + np.bincount(text, weights=w[flat], minlength=len(features))
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_neg = np.logaddexp(0, g)
        slack = loss_neg[unl].mean() - prior * loss_neg[pos].mean()
        d = np.zeros(len(features))
        away = np.where(unl, p / unl.sum(), -prior * p / pos.sum())
        if slack >= 0:
            d = away
            d[pos] -= prior * (1 - p[pos]) / pos.sum()
        else:  # the negative risk is overfitted: step back
            d = -away
        grad = np.append(np.bincount(flat, weights=d[text], minlength=columns) + SHRINK * w, d.sum())
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        step = RATE * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_positive: int, max_unlabelled: int
) -> tuple[DataFrame, float]:
    """``positive, text`` of the training sample, and the class prior.

    The prior is the share of toxic rows among those labelled for training.
    Both parts are drawn in the order of a hash of the id; rows that repeat an id
    give one text.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    n, n_toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(max((n_toxic or 0) / n, 1e-4), 0.5) if n else 0.0
    order = F.xxhash64(F.lit(11), F.col("_id"))
    texts = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("text"))
    confirmed = known.where("toxic = 1").orderBy(order, "_id").limit(max_positive)
    others = (
        docs.where(F.col(id_col).isNotNull() & (fold(id_col) != 0))
        .select(F.col(id_col).alias("_id")).distinct().orderBy(order, "_id").limit(max_unlabelled)
    )
    drawn = confirmed.select("_id", F.lit(True).alias("positive")).unionByName(
        others.select("_id", F.lit(False).alias("positive"))
    )
    # At most max_positive + max_unlabelled ids, so they fit every executor.
    found = texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    return stage(found.groupBy("positive", "_id").agg(F.min("text").alias("text")), "toxicity-sample"), prior


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Model from ``docs`` and the labels of the training folds.

    ``max_positive`` and ``max_unlabelled`` bound the texts that are fitted on.
    Only words, counts and features of the bounded sample reach the driver.
    Without a confirmed text every score is near 0.
    """
    sample, prior = _sample(docs, labels, id_col, text_col, max_positive, max_unlabelled)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, unl = Counter({"": 0}), Counter({"": 0})  # "" counts texts
        for batch in batches:
            for positive, text in zip(batch["positive"], batch["text"], strict=True):
                (pos if positive else unl).update(words_in(text) | {""})
        words = list(pos.keys() | unl.keys())
        yield pd.DataFrame({"word": words, "pos": [pos[w] for w in words], "unl": [unl[w] for w in words]})

    counts = (
        sample.mapInPandas(count, "word string, pos long, unl long")
        .groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
        .where((F.col("pos") >= MIN_TEXTS) | (F.col("word") == ""))
    )
    with small_batches(docs.sparkSession):
        rows = [tuple(r) for r in counts.collect()]
    n_pos, n_unl = next(((p, u) for w, p, u in rows if w == ""), (0, 0))
    if not n_pos or not n_unl:
        return Model()
    ranked = sorted((-log_ratio(p, n_pos, u, n_unl), w) for w, p, u in rows if w)
    words = [w for r, w in ranked[:MAX_WORDS] if -r >= MIN_RATIO]
    index = {w: i for i, w in enumerate(words)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [sorted(index[w] for w in index.keys() & words_in(t)) for t in batch["text"]]
            yield pd.DataFrame({"positive": batch["positive"], "ids": ids})

    with small_batches(docs.sparkSession):
        coded = sample.mapInPandas(encode, "positive boolean, ids array<int>").collect()
    coded.sort(key=lambda r: (r["positive"], r["ids"]))  # the same sums in every run
    weights, intercept = nnpu(
        [np.array(r["ids"], dtype=np.int64) for r in coded],
        np.array([r["positive"] for r in coded]),
        prior,
        len(words),
    )
    return Model(float(intercept), {w: float(weights[i]) for w, i in index.items()})


def scorer(model: Model):
    """A column function from text to score (null counts as empty).

    Texts are scored one by one, so they travel pickled, a hundred at a time: an Arrow
    batch has ten thousand unless the caller's session says otherwise when it runs.
    """
    return F.udf(lambda text: model.score(text or ""), "double", useArrow=False)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null text counts as empty, and a null id is not held out.  Repeated rows
    have equal scores.  Other columns are not read; an empty table gives no rows.
    """
    scored = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(id_col) == 0).alias("held_out"),
        scorer(model)(F.col(text_col)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the texts predicted toxic, columns unchanged.

    Every row is judged by its whole text, however long; a null text counts as empty and
    has the score of a text without known words.  Rows with equal texts, repeated ones
    too, are kept or dropped together; a score of 0.5 is toxic.  Without labels nothing
    is dropped.  An empty table stays empty, and columns may have any names.
    """
    return docs.where(scorer(train(docs, labels))(F.col("text")) < 0.5)
