"""Toxicity scores: logistic regression fitted by FTRL-proximal over hashed n-grams.

Features of a text are the presence of its words, word pairs, triples and
skip-grams (words with one or two others between them), each hashed to
``2 ** BITS`` coordinates; words are runs of letters, digits and non-ASCII
bytes, ASCII letters in lower case. FTRL keeps a learning rate per coordinate,
and its L1 term leaves most weights at exactly zero, so the model is a short
list of (coordinate, weight) that goes to every task.

Learning reads about ``TRAIN_ROWS`` labelled rows, chosen by a hash of their
ids: a documented bound, so one task sees all it learns from. Features are
extracted by all tasks, scoring runs over every row, one pass, no shuffle.

Edge cases: null or empty texts have only the bias; rows whose id is null are
scored and never learned from; repeated rows are scored alike; labels that are
null are left out, and of several labels of an id the highest counts; without
any label every score is 0. Other columns of the input are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.common import Words, chain, slices, text_of

BITS = 20
TRAIN_ROWS = 12_000
PASSES = 4
THRESHOLD = 0.3
#: Word offsets of the features: pairs, triples, and skip-grams over one or two words.
GAPS = ((1,), (1, 2), (2,), (3,))
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0


@dataclass(frozen=True)
class Model:
    """Coordinates with a weight, their weights, and the bias; no bias without training rows."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float | None


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all n-grams and skip-grams, and the texts they are of; repeats are kept."""
    words = Words(texts, "letter")
    found = [(words.hash, words.text), *(chain(words.hash, words.text, g) for g in GAPS)]
    shift = np.uint64(64 - bits)
    return (
        np.concatenate([h >> shift for h, _ in found]).astype(np.int32),
        np.concatenate([t for _, t in found]),
    )


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            at, text = features(batch.column("text"))
            pairs = np.unique(text.astype(np.int64) << BITS | at)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) << BITS)
            values = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("label"), lists], ["place", "label", "features"]
            )


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL-proximal over all rows of one partition; the last coordinate is the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for batch in batches:
        lists, labels = batch.column("features"), batch.column("label").to_numpy()
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        rows += [(np.append(values[a:b], size), y) for a, b, y in zip(offsets, offsets[1:], labels)]
    for _ in range(PASSES):
        for at, y in rows:
            w = _weights(z[at], n[at])
            w[-1] = _weights(z[size], n[size], 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    if rows:
        w = _weights(z, n)
        kept = np.flatnonzero(w[:-1])
        at = np.append(kept, size)
        w[-1] = _weights(z[size], n[size], 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], ["at", "weight"])


def _weights(z, n, l1: float = L1):
    return np.where(
        np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    )


def fit(labelled: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """Learn from rows (doc_id, text, label), about ``bound`` of them at most."""
    total = labelled.count()
    place = F.xxhash64(F.col("doc_id"), F.lit(7))
    share = min(1.0, bound / max(total, 1))
    rows = labelled.select(text_of().alias("text"), F.col("label").cast("int").alias("label"), place.alias("place"))
    if share < 1:
        # The lowest 32 bits are as good as random.
        rows = rows.filter(F.pmod(F.col("place"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
    learned = (
        rows.mapInArrow(_feature_rows, "place long, label int, features array<int>")
        .repartition(1)
        .sortWithinPartitions("place", "label")
        .mapInArrow(_learn, "at int, weight double")
        .collect()  # the weights that are not zero, 2 ** BITS at most
    )
    weights = {r["at"]: r["weight"] for r in learned}
    bias = weights.pop(1 << BITS, None)
    at = np.array(sorted(weights), np.int32)
    return Model(at, np.array([weights[int(a)] for a in at], np.float64), bias)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Add the score of each row's text."""
    if model.bias is None:
        return docs.withColumn(into, F.lit(0.0))

    at, weights, bias = model.coordinates, model.weights, model.bias

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << BITS)
        dense[at] = weights
        for series in texts:
            array = pa.array(series, pa.string())
            whole = pa.RecordBatch.from_arrays([array], ["text"])
            total = [np.empty(0)]
            for batch in slices(whole, "text"):
                place, text = features(batch.column("text"))
                known = np.flatnonzero(dense[place])
                # Presence counts once, however often a feature is there.
                pairs = np.unique(text[known].astype(np.int64) << BITS | place[known])
                sums = np.bincount(
                    pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=batch.num_rows
                )
                total.append(1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))))
            yield pd.Series(np.concatenate(total))

    return docs.withColumn(into, scores(text_of()))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: texts with a known label, without the rows that are held out."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out())
    return rows.join(known, "doc_id")


def held_out():
    """Rows kept for testing: those whose crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
