"""Exact ranked lexical search: inner products of sparse vectors, found by ball trees.

A document is a vector of integer impacts, one per term, from its term counts and
its length; an item is a vector of integer term weights; the score is their inner
product. The search runs in two passes over the documents:

1. Texts become term counts, of the items' terms only, in a stage table, with the
   number of all their terms. Its aggregates are the statistics of the corpus:
   documents with terms, all terms, and documents per term.
2. Tasks read that table in blocks of ``BLOCK`` documents at most. A block becomes
   a ball tree: each node has the centroid of its documents' vectors, the greatest
   distance of any of them to it, and two subtrees around two distant documents.
   For an item, no document of a node can score above

       item . centroid + |item, on the terms of the node| * radius

   (a document has no terms but those of its node, so the others do not count).
   Nodes are opened best first, and what cannot reach the item's k-th best score
   so far, in any block the task has read, is left shut. Bounds are computed in
   floating point and rounded up by more than all rounding errors; leaves are
   scored in 64-bit integers. Each task gives k rows an item, which are merged.

Items go to tasks in groups of at most ``ENTRIES`` distinct terms of items, which
bounds what is broadcast; each further group is a further pass.

Edge cases: null or empty texts and texts without terms have no terms and no
score; null ids of documents count in all statistics and are not ranked; null
ids of items have no rows, and items that share an id are one item with the terms
of all; repeated documents are ranked each; equal scores go to the smaller id;
items without terms, or whose terms occur nowhere, have no rows; empty tables
give none; other columns are ignored. Terms meet by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbench.llm.common import Words, slices, stage, text_of

TOP = 10
#: Documents of a tree, and term counts of its documents.
BLOCK, BLOCK_COUNTS = 4096, 1 << 20
LEAF = 32
#: Distinct terms of items that one pass takes along; each is a few dozen bytes.
ENTRIES = 1 << 20
#: More than the relative error of any sum of products here, and the absolute one.
SLACK, LEAST = 1e-9, 1.0


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct rows (item_id, term) of the items' texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"), "letter")
                item = batch.column("item_id").to_numpy()[words.text]
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(words.hash.view(np.int64))], ["item_id", "term"])

    texts = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    return texts.mapInArrow(rows, "item_id long, term long").distinct()


def _groups(entries: DataFrame, limit: int) -> list[dict[int, np.ndarray]]:
    """Items and their terms, in groups of at most ``limit`` entries, or one item, if it has more.

    Entries are fetched a group at a time.
    """
    sizes = entries.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("hand").orderBy("item_id"))
    # Items are numbered by running sums within a fixed number of hands of cards, not in one task.
    hand = F.pmod(F.xxhash64("item_id"), F.lit(16))
    numbered = sizes.withColumn("hand", hand).withColumn("number", ((upto - 1) / F.lit(max(1, limit // 16))).cast("long"))
    numbered = stage(numbered.select("item_id", "number"))
    most = numbered.agg(F.max("number")).first()[0]
    groups = []
    for number in range(0 if most is None else most + 1):
        chosen = entries.join(numbered.filter(F.col("number") == number), "item_id").select("item_id", "term")
        columns = chosen.toArrow()
        item, term = (columns.column(c).to_numpy() for c in ("item_id", "term"))
        order = np.lexsort((term, item))
        item, term = item[order], term[order].view(np.uint64)
        keys, starts = np.unique(item, return_index=True)
        if len(keys):
            groups.append(dict(zip(keys.tolist(), np.split(term, starts[1:]))))
    return groups


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Rows (doc_id, n, terms, counts): number of terms, and counts of those that are in the sorted vocabulary."""
    schema = "doc_id long, n long, terms array<int>, counts array<int>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"), "letter")
                place = np.searchsorted(vocabulary, words.hash)
                place[place == len(vocabulary)] = 0
                known = vocabulary[place] == words.hash
                pairs, n = np.unique(words.text[known].astype(np.int64) << 32 | place[known], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) << 32)
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(words.counts()),
                        pa.ListArray.from_arrays(offsets, pa.array((pairs & 0xFFFFFFFF).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(rows, schema)


def weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, total: int, rows: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L of each count's document."""
    lengths, which = np.unique(n, return_inverse=True)
    m = np.array([10 + 90 * x * documents // total for x in lengths.tolist()], np.int64)[which]
    tf = counts.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of several spans, one after another."""
    length = ends - starts
    upto = np.cumsum(length)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - length), length)


class BallTree:
    """A ball tree over sparse rows of integers: positions in ``terms`` and ``values`` from ``offsets``.

    Rows are put in the order of the leaves. Centroids lie in lists by term, so that the bounds of all
    nodes for an item cost no more than the entries of its terms.
    """

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        self.offsets, self.terms, self.values = offsets, terms, values
        self.size = np.diff(offsets)
        self.order = np.arange(len(self.size))
        self.norm = np.bincount(np.repeat(self.order, self.size), weights=values.astype(np.float64) ** 2, minlength=len(self.size))
        self.dense = np.zeros(int(terms.max(initial=-1)) + 1)
        self.first, self.last, self.children, self.radius = [], [], [], []
        entries = []
        todo = [(0, len(self.order), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.first)
            if parent >= 0:
                self.children[parent].append(node)
            self.first.append(a)
            self.last.append(b)
            self.children.append([])
            rows = self.order[a:b]
            at = _spans(self.offsets[rows], self.offsets[rows + 1])
            support, centre = self._sums(at)
            centre /= max(1, b - a)
            distance = self._distance(rows, support, centre)
            # What floating point may have lost of a distance is less than this share of the lengths.
            reach = float(np.sqrt(distance.max(initial=0.0) + SLACK * (self.norm[rows].max(initial=0.0) + float(centre @ centre))))
            self.radius.append(reach * (1 + SLACK))
            entries.append((support, np.full(len(support), node), centre))
            if b - a > leaf:
                near = self._distance(rows, *self._row(rows[int(np.argmax(distance))]))
                nearer = near - self._distance(rows, *self._row(rows[int(np.argmax(near))]))
                # Each side gets an eighth at least, so the tree stays low whatever the rows.
                left = min(max(int((nearer <= 0).sum()), (b - a) // 8), b - a - (b - a) // 8)
                self.order[a:b] = rows[np.argsort(nearer, kind="stable")]
                todo += [(a + left, b, node), (a, a + left, node)]
        self.radius = np.array(self.radius)
        support, node, centre = (np.concatenate(x) for x in zip(*entries))
        by_term = np.argsort(support, kind="stable")
        self.node, self.centre = node[by_term], centre[by_term]
        self.term_ends = np.searchsorted(support[by_term], np.arange(len(self.dense) + 1))
        del self.dense

    def _row(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.offsets[row], self.offsets[row + 1])
        return self.terms[span], self.values[span].astype(np.float64)

    def _sums(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms at some positions, and the sums of their values."""
        if 4 * len(at) < len(self.dense):
            support, which = np.unique(self.terms[at], return_inverse=True)
            return support, np.bincount(which, weights=self.values[at], minlength=len(support))
        total = np.bincount(self.terms[at], weights=self.values[at], minlength=len(self.dense))
        support = np.flatnonzero(total)
        return support, total[support]

    def _distance(self, rows: np.ndarray, support: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances of rows to a sparse point."""
        self.dense[support] = point
        at = _spans(self.offsets[rows], self.offsets[rows + 1])
        own = np.repeat(np.arange(len(rows)), self.size[rows])
        product = np.bincount(own, weights=self.values[at] * self.dense[self.terms[at]], minlength=len(rows))
        self.dense[support] = 0.0
        return np.maximum(self.norm[rows] - 2 * product + float(point @ point), 0.0)

    def bounds(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each node, no less than the inner product of the item with any of its rows."""
        inside = terms < len(self.term_ends) - 1
        terms, weight = terms[inside], weight[inside].astype(np.float64)
        a, b = self.term_ends[terms], self.term_ends[terms + 1]
        at, w = _spans(a, b), np.repeat(weight, b - a)
        product = np.bincount(self.node[at], weights=w * self.centre[at], minlength=len(self.radius))
        length = np.sqrt(np.bincount(self.node[at], weights=w * w, minlength=len(self.radius)))
        return (product + length * self.radius) * (1 + SLACK) + LEAST * (length > 0)

    def leaf_scores(self, node: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a leaf and their exact inner products with a dense integer vector."""
        rows = self.order[self.first[node] : self.last[node]]
        at = _spans(self.offsets[rows], self.offsets[rows + 1])
        upto = np.concatenate([[0], np.cumsum(self.values[at] * dense[self.terms[at]])])
        ends = np.cumsum(self.size[rows])
        return rows, upto[ends] - upto[ends - self.size[rows]]

    def search(self, terms: np.ndarray, weight: np.ndarray, dense: np.ndarray, ids: np.ndarray, best: list, k: int) -> int:
        """Put rows that are among the k best into the heap ``best`` of (score, -id); returns the leaves opened."""
        bound = self.bounds(terms, weight)
        heap, opened = [(-bound[0], 0)], 0
        while heap:
            most, node = heapq.heappop(heap)
            # A bound equal to the k-th score may hide an equal score of a smaller id.
            if most == 0 or (len(best) == k and -most < best[0][0]):
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            opened += 1
            rows, scores = self.leaf_scores(node, dense)
            least = best[0][0] if len(best) == k else 1
            for at in np.flatnonzero(scores >= max(least, 1)).tolist():
                entry = (int(scores[at]), -int(ids[rows[at]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return opened


def _searched(items: list[tuple[int, np.ndarray]], weight: np.ndarray, documents: int, total: int, k: int):
    """Rows (item_id, doc_id, score): the k best of each item among all rows of a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in items]
        dense = np.zeros(len(weight), np.int64)

        def block(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = [table.column(c).combine_chunks() for c in ("terms", "counts")]
            offsets = lists[0].offsets.to_numpy().astype(np.int64)
            counts = lists[1].flatten().to_numpy()
            n, ids = table.column("n").to_numpy(), table.column("doc_id").to_numpy()
            which = np.repeat(np.arange(len(n)), np.diff(offsets))
            values = impacts(counts, n, documents, total, which)
            tree = BallTree(offsets - offsets[0], lists[0].flatten().to_numpy(), values)
            for (_, terms), heap in zip(items, best):
                dense[terms] = weight[terms]
                tree.search(terms, weight[terms], dense, ids, heap, k)
                dense[terms] = 0

        held, docs, size = [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, LEAF):
                batch = whole.slice(at, LEAF)
                more = len(batch.column("terms").flatten())
                if held and (docs + batch.num_rows > BLOCK or size + more > BLOCK_COUNTS):
                    block(held)
                    held, docs, size = [], 0, 0
                held.append(batch)
                docs, size = docs + batch.num_rows, size + more
        if held:
            block(held)
        found = [(item, -doc, score) for (item, _), heap in zip(items, best) for score, doc in heap]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return rows


def _group(docs: DataFrame, items: dict[int, np.ndarray], k: int) -> DataFrame:
    vocabulary = np.unique(np.concatenate(list(items.values())))
    counted = stage(term_counts(docs, vocabulary))
    totals = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    terms = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = terms.toArrow()  # a row per term of the group at most
    frequency[known.column("term").to_numpy()] = known.column("df").to_numpy()
    weight = weights(totals[0], frequency)
    numbered = [(item, np.searchsorted(vocabulary, x)) for item, x in items.items()]
    rows = counted.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
    return rows.mapInArrow(_searched(numbered, weight, totals[0], totals[1], k), "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item, those with a score above 0."""
    groups = _groups(stage(item_terms(items)), entries)
    if not groups:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = _group(docs, groups[0], k)
    for group in groups[1:]:
        found = found.unionAll(_group(docs, group, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
