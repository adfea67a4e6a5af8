"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. All other texts are unlabelled: some of them are toxic
too. With the share of toxic texts, the class prior p, the risk of a classifier is
p * (risk of positives as positive) + (risk of the unlabelled as negative)
- p * (risk of positives as negative), where the last two together cannot truly be below zero. If
they fall below it on the sample, the classifier is overfitting, and the step goes the other way.

The classifier is logistic over the presence of words and word beginnings. They are chosen by how
much more often they occur in positives, on counts that Spark folds; numpy fits the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: The fit sees at most so many confirmed toxic rows and so many other rows, the first by hash.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 8_000
#: Features in the model, and the positives that must hold one. A feature's share among positives must
#: be so many standard errors above that among the unlabelled, and texts with it toxic more often than
#: not: the prior times the ratio of the shares.
MOST_FEATURES, LEAST_POSITIVES, LEAST_ERRORS, LEAST_TOXIC = 512, 5, 4.0, 0.6
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
STEPS, RATE, DECAY, SLACK, BACK = 800, 0.05, 1e-4, 0.0, 0.5
#: Words whose features a worker remembers.
KNOWN_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) - (1 << 63)


def features_of(word: str) -> list[int]:
    """The word as a whole and its beginnings, as hashes."""
    return [_hash(f"={word}"), *(_hash(f"<{word[:n]}") for n in BEGINNINGS if len(word) > n)]


def text_features(text: str | None) -> set[int]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w)}


def learnable(key: Column) -> Column:
    """Rows whose labels may be learned from: the CRC-32 of the key as text, mod 3, is not 1."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1


@dataclass(frozen=True)
class Model:
    features: dict[int, int]
    weights: np.ndarray
    bias: float

    def score(self, present: list[int]) -> float:
        margin = self.bias + float(self.weights[present].sum())
        return float(np.float64(1) / (1 + np.exp(-np.clip(margin, -40, 40))))


def fit_weights(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, bias) over rows of 0 and 1, by the non-negative risk and Adam."""
    both = np.hstack([np.vstack([positive, unlabelled]), np.ones((len(positive) + len(unlabelled), 1))])
    p, u = both[: len(positive)], both[len(positive) :]
    w = np.zeros(both.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    decay = np.full_like(w, DECAY)
    decay[-1] = 0.0

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, steps + 1):
        at_p, at_u = p @ w, u @ w
        negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        slope = u.T @ sigmoid(at_u) / len(u) - prior * (p.T @ sigmoid(at_p)) / len(p)
        if negative >= -SLACK:
            slope = slope - prior * (p.T @ sigmoid(-at_p)) / len(p)
        else:
            slope = -BACK * slope
        slope = slope + decay * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_positive: int, most_unlabelled: int) -> DataFrame:
    """(id, text, positive, unlabelled): a row per id, so that the two numbers bound the rows. Of different
    texts with one id, the smallest by digest is read; a null one only if there is no other."""
    order = [F.xxhash64("id"), F.col("id")]
    confirmed = labels.select(F.col(key).alias("id"), F.col(label).alias("y")).where(learnable(F.col("id")))
    positive = confirmed.groupBy("id").agg(F.max("y").alias("y")).where("y = 1").orderBy(*order).limit(most_positive)
    # Any row may be unlabelled: the confirmed ones keep the unlabelled a sample of all texts.
    others = docs.select(F.col(key).alias("id")).where(learnable(F.col("id"))).distinct().orderBy(*order).limit(most_unlabelled)
    chosen = positive.select("id", F.lit(1).alias("p"), F.lit(0).alias("u")).unionByName(
        others.select("id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    )
    chosen = chosen.groupBy("id").agg(F.max("p").alias("positive"), F.max("u").alias("unlabelled"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "id")
    # Folds in every task before the shuffle, however many rows share an id.
    one = texts.groupBy("id", "positive", "unlabelled").agg(F.min(F.struct(F.col("text").isNull(), F.md5("text"), "text")).alias("least"))
    return materialize(one.select("id", "least.text", "positive", "unlabelled"), "toxicity-sample")


def _choose(sample: DataFrame, positives: int, unlabelled: int, prior: float, most: int) -> list[int]:
    """The features that tell positives from the unlabelled best."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[int]] = {}
            for text, p, u in zip(*(c.to_pylist() for c in batch.columns)):
                for feature in text_features(text):
                    both = found.setdefault(feature, [0, 0])
                    both[0] += p
                    both[1] += u
            columns = [list(found), [v[0] for v in found.values()], [v[1] for v in found.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["feature", "p", "u"])

    rows = sample.select("text", F.col("positive").cast("bigint"), F.col("unlabelled").cast("bigint"))
    counts = rows.mapInArrow(counted, "feature bigint, p bigint, u bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share_p, share_u = F.col("p") / positives, (F.col("u") + 1) / (unlabelled + 2)
    errors = (share_p - share_u) / F.sqrt(share_u * (1 - share_u) / positives)
    often = (F.col("p") >= LEAST_POSITIVES) & (prior * share_p / share_u >= LEAST_TOXIC)
    best = counts.where(often).select("feature", errors.alias("z")).where(F.col("z") >= LEAST_ERRORS)
    return [r["feature"] for r in best.orderBy(F.desc("z"), "feature").limit(most).collect()]


def _present(text: str | None, chosen: dict[int, int], known: dict[str, tuple[int, ...]]) -> list[int]:
    """Positions of the chosen features that the whole text holds."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        at = known.get(word)
        if at is None:
            at = known[word] = tuple(chosen[f] for f in features_of(word) if f in chosen)
        found.update(at)
    return sorted(found)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    prior: float | None = None,
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
    most_features: int = MOST_FEATURES,
) -> Model:
    """A model from the bounded sample. ``prior`` is by default the share of toxic rows among the
    labelled rows that may be learned from. Without positives every score is 0 to rounding."""
    sample = _sample(docs, labels, key, text, label, most_positive, most_unlabelled)
    size = sample.agg(F.sum("positive"), F.sum("unlabelled")).first()
    if prior is None:
        learned = labels.where(learnable(F.col(key)) & F.col(label).isNotNull())
        prior = learned.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    if not size[0] or not size[1]:
        return Model({}, np.zeros(0), -40.0)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    chosen = {f: i for i, f in enumerate(_choose(sample, size[0], size[1], prior, most_features))}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            present = [_present(t, chosen, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(present, pa.list_(pa.int32()))],
                names=["id", "positive", "unlabelled", "present"],
            )

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(placed, f"id {kind}, positive int, unlabelled int, present array<int>").orderBy("id", "present").collect()
    matrix = np.zeros((len(rows), len(chosen)))
    for at, row in enumerate(rows):
        matrix[at, row["present"]] = 1
    positive = np.array([bool(r["positive"]) for r in rows])
    unlabelled = np.array([bool(r["unlabelled"]) for r in rows])
    weights, bias = fit_weights(matrix[positive], matrix[unlabelled], prior)
    return Model(chosen, weights, bias)


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(``key``, held_out, score, predicted), a row per row; whole texts are read.

    A null text is an empty one; both have the score of a text without any word. ``held_out`` is
    whether labels of the key were not learned from; a null key is none of them, and is
    not learned from either. Repeated rows have equal scores. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [round(model.score(_present(t, model.features, known)), 9) for t in batch.column(1).to_pylist()]
            predicted = pa.array([int(s >= threshold) for s in found], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.float64()), predicted],
                names=[key, "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(~learnable(F.col(key)), F.lit(False)).alias("held_out")
    return docs.select(F.col(key), F.col(text).cast("string"), held_out).mapInArrow(
        scored, f"`{key}` {kind}, held_out boolean, score double, predicted int"
    )


def not_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that ``model`` rejects; all columns pass unchanged."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            found = [round(model.score(_present(t, model.features, known)), 9) for t in texts]
            yield pd.Series(found, dtype="float64")

    return docs.where(score(F.col(text).cast("string")) < threshold)
