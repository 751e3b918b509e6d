"""Quality scores: histogram gradient-boosted trees over statistics of documents.

A document becomes the numbers named in ``STATISTICS``: sizes, shares of kinds of
characters, lengths and repetition of words, pairs of words and lines. Values are
cut into ``BINS`` bins by their quantiles, and trees of depth ``DEPTH`` are grown
level by level from histograms of gradients and Hessians of the logistic loss.
The trees are complete, so the model is three arrays (statistic, threshold, value)
with a row per tree; all rows of a batch go down all trees at once, by index
arithmetic, in ``DEPTH`` steps.

Learning reads at most ``TRAIN_ROWS`` labelled ids, the first in order of a hash:
a documented bound, so their keys are broadcast, and only their statistics, never
their texts, are shuffled, to one task. Scoring runs over every row, one pass, no
shuffle.

Edge cases: null or empty texts have statistics of 0 and a score like others; a
very long text is one slice of its own; rows whose id is null are scored and never
learned from; of several rows with an id one is learned from (that of the least
statistics), of several labels the highest; null labels are left out; without any
label every score is 0; repeated rows are scored alike. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbench.llm.common import Words, chain, slices, text_bytes, text_of

TRAIN_ROWS = 12_000
THRESHOLD = 0.3
BINS, DEPTH, ROUNDS, RATE = 64, 4, 120, 0.1
#: Rows a leaf holds at least, and the L2 term on its value.
LEAF_ROWS, L2 = 20, 1.0

STATISTICS = (
    "bytes", "words", "lines", "word_length", "word_deviation", "longest_word", "upper", "digits", "stops", "symbols",
    "blanks", "beyond_ascii", "entropy", "distinct_words", "top_word", "distinct_pairs", "short_words", "symbol_ends",
    "upper_starts", "loud_words", "line_words", "repeated_lines", "calls",
)
_UPPER, _LOWER, _DIGIT, _BLANK, _STOP, _SYMBOL, _BEYOND = range(7)


def _kind(c: int) -> int:
    if c >= 128:
        return _BEYOND
    if chr(c).isalpha():
        return _UPPER if chr(c).isupper() else _LOWER
    if chr(c).isdigit():
        return _DIGIT
    if c == 32 or 9 <= c <= 13:
        return _BLANK
    return _STOP if chr(c) in ".,;:!?" else _SYMBOL


_KIND = np.array([_kind(c) for c in range(256)], np.uint8)


def _most(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: number of its distinct keys, and occurrences of the most frequent."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.empty(0, int)
    count = np.diff(np.append(new, len(keys)))
    most = np.zeros(n)
    np.maximum.at(most, owner[new], count)
    return np.bincount(owner[new], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; texts hold no nulls."""
    n = len(texts)
    data, offsets = text_bytes(texts)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    bytes_of = np.bincount(owner << 8 | data, minlength=n << 8).reshape(n, 256).astype(float)
    kinds = np.stack([bytes_of[:, _KIND == k].sum(axis=1) for k in range(7)], axis=1)

    def share(part, whole):
        return np.asarray(part, float) / np.maximum(whole, 1)

    def sums(values):
        return np.bincount(words.text, weights=values, minlength=n)

    words = Words(texts, "space")
    count = words.counts()
    length = (words.end - words.start).astype(float)
    mean = share(sums(length), count)
    longest = np.zeros(n)
    np.maximum.at(longest, words.text, length)
    last, first = _KIND[data[words.end - 1]], _KIND[data[words.start]]
    lower = np.concatenate([[0], np.cumsum(_KIND[data] == _LOWER)])
    upper = np.concatenate([[0], np.cumsum(_KIND[data] == _UPPER)])
    loud = (lower[words.end] == lower[words.start]) & (upper[words.end] - upper[words.start] > 1)
    distinct, top = _most(words.hash, words.text, n)
    pairs, of = chain(words.hash, words.text, (1,))
    distinct_pairs, _ = _most(pairs, of, n)

    # A line is the sum of its words' hashes, each multiplied by an odd number for its place.
    breaks = np.concatenate([[0], np.cumsum(data == 10)])[words.start] + words.text
    starts = np.flatnonzero(np.concatenate([[True], breaks[1:] != breaks[:-1]])) if len(breaks) else np.empty(0, int)
    place = (np.arange(len(breaks)) - np.repeat(starts, np.diff(np.append(starts, len(breaks))))).astype(np.uint64)
    line = np.add.reduceat(words.hash * (2 * place + np.uint64(1)), starts) if len(starts) else np.empty(0, np.uint64)
    line_text = words.text[starts]
    lines = np.bincount(line_text, minlength=n)
    distinct_lines, _ = _most(line, line_text, n)

    p = bytes_of / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    letters = kinds[:, _UPPER] + kinds[:, _LOWER]
    found = {
        "bytes": np.log1p(size), "words": np.log1p(count), "lines": np.log1p(lines), "word_length": mean,
        "word_deviation": np.sqrt(np.maximum(share(sums(length * length), count) - mean**2, 0)),
        "longest_word": np.log1p(longest), "upper": share(kinds[:, _UPPER], letters), "digits": share(kinds[:, _DIGIT], size),
        "stops": share(kinds[:, _STOP], size), "symbols": share(kinds[:, _SYMBOL], size), "blanks": share(kinds[:, _BLANK], size),
        "beyond_ascii": share(kinds[:, _BEYOND], size), "entropy": entropy, "distinct_words": share(distinct, count),
        "top_word": share(top, count), "distinct_pairs": share(distinct_pairs, np.bincount(of, minlength=n)),
        "short_words": share(sums(length <= 3), count), "symbol_ends": share(sums(last == _SYMBOL), count),
        "upper_starts": share(sums(first == _UPPER), count), "loud_words": share(sums(loud), count),
        "line_words": np.log1p(share(count, lines)), "repeated_lines": 1 - share(distinct_lines, lines) * (lines > 0) - (lines == 0),
        "calls": share(bytes_of[:, ord("!")] + bytes_of[:, ord("?")], kinds[:, _STOP]),
    }
    return np.stack([found[name] for name in STATISTICS], axis=1)


@dataclass(frozen=True)
class Model:
    """Complete trees, a row each: statistic and threshold of every inner node, value of every leaf; and the start."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float | None

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; values above a threshold go right."""
        if self.start is None:
            return np.zeros(len(x))
        trees = np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.start + self.value[trees, node - (1 << DEPTH) + 1].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost trees on rows of statistics and labels of 0 and 1."""
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    place = bins + BINS * np.arange(width)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature = np.zeros((ROUNDS, inner), np.int32)
    threshold = np.full((ROUNDS, inner), np.inf)
    value = np.zeros((ROUNDS, leaves))
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(rate / (1 - rate)))
    total = np.full(rows, start)
    for tree in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for depth in range(DEPTH):
            first, size = (1 << depth) - 1, 1 << depth
            at = ((node - first)[:, None] * (width * BINS) + place).ravel()
            shape = (size, width, BINS)
            sums = [
                np.bincount(at, weights=None if w is None else np.repeat(w, width), minlength=size * width * BINS).reshape(shape)
                for w in (g, h, None)
            ]
            left = [s.cumsum(axis=2) for s in sums]
            right = [a[:, :, -1:] - a for a in left]
            gain = sum(a[0] ** 2 / (a[1] + L2) for a in (left, right)) - (left[0][:, :, -1:] ** 2 / (left[1][:, :, -1:] + L2))
            gain[(left[2] < LEAF_ROWS) | (right[2] < LEAF_ROWS)] = 0
            flat = gain.reshape(size, -1)
            best = flat.argmax(axis=1)
            for k in np.flatnonzero(flat[np.arange(size), best] > 1e-9):
                f, cut = divmod(int(best[k]), BINS)
                feature[tree, first + k], threshold[tree, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(rows), feature[tree, node]] > threshold[tree, node])
        leaf = node - inner
        value[tree] = RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + L2)
        total += value[tree, leaf]
    return Model(feature, threshold, value, start)


def held_out() -> Column:
    """Rows kept for testing: those whose crc32 of the id as text is 0 modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """Rows (doc_id, label, statistics) of at most ``bound`` labelled ids that are not held out."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = usable.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(bound)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = statistics(batch.column("text"))
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("label"), lists], ["doc_id", "label", "statistics"]
                )

    found = texts.mapInArrow(rows, "doc_id long, label int, statistics array<double>")
    return found.groupBy("doc_id", "label").agg(F.min("statistics").alias("statistics"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """Learn in one task, from ``bound`` rows of statistics at most."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            y = np.concatenate([b.column("label").to_numpy() for b in held]).astype(float)
            x = np.concatenate([b.column("statistics").flatten().to_numpy() for b in held]).reshape(len(y), -1)
            model = grow(x, y)
            parts = [a.tobytes() for a in (model.feature, model.threshold, model.value)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([p], pa.binary()) for p in parts], pa.array([model.start])], ["feature", "threshold", "value", "start"]
            )

    rows = training_rows(docs, labels, bound).repartition(1).sortWithinPartitions("doc_id")
    learned = rows.mapInArrow(learn, "feature binary, threshold binary, value binary, start double").collect()
    if not learned:
        return Model(np.empty(0), np.empty(0), np.empty(0), None)
    row = learned[0]
    shape = (ROUNDS, -1)
    return Model(
        np.frombuffer(row["feature"], np.int32).reshape(shape), np.frombuffer(row["threshold"]).reshape(shape),
        np.frombuffer(row["value"]).reshape(shape), row["start"],
    )


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Add the score of each row's text."""
    if model.start is None:
        return docs.withColumn(into, F.lit(0.0))

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            whole = pa.RecordBatch.from_arrays([pa.array(series, pa.string())], ["text"])
            found = [model.predict(statistics(batch.column("text"))) for batch in slices(whole, "text")]
            yield pd.Series(np.concatenate([np.empty(0), *found]))

    return docs.withColumn(into, scores(text_of()))
