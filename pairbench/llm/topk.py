"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers, sorted by length and cut into buckets of at
most ``BUCKET`` vectors; each bucket is one row with its ids, its vectors as one
block of bytes, and its greatest length. Queries are cut into blocks the same
way. A first pass scores every query against the ``k`` longest vectors and more,
which gives each a lower bound for its k-th best score.

A bucket can hold a better candidate for a query only if its greatest length
times the query's reaches the bound; buckets are in order of length, so a block
of queries meets a leading run of buckets, and only those pairs of blocks become
rows. Within a pair the query's local cosine threshold, bound / (query length x
greatest length), picks the pruning: above ``COORDINATE``, vectors must agree
with the query in its strongest coordinates (the rest of both is bounded by the
Cauchy-Schwarz inequality); below, or where that does not help, length alone
prunes. What is left is verified by exact integer products.

Edge cases: vectors that are null or empty, or hold components that are null or, also
when scaled, not finite take no part, neither do rows with a null id; components of any
other size are exact, and scores beyond 64 bits count as the greatest or least number
of 64 bits; vectors of another dimension than the
query's are not compared; ties go to smaller ids; an id that stands several times
is a candidate once per row; fewer candidates than k give fewer rows; an empty
table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.llm.common import stage

SCALE = 1024
BUCKET = 2048
QUERIES = 1024
#: Buckets of the first pass, of each dimension.
FIRST = 1
#: Local cosine thresholds from here on make coordinate pruning worth its cost.
COORDINATE = 0.7
STRONGEST = 8
#: Scores stay within 64 bits.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Classes of length for each doubling.
FINE = 64


def _blocks(limit: int):
    """Cut sorted vectors into rows (dim, top, ids, vectors) of at most ``limit``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "top", "ids", "vectors"]

        def block(held):
            ids, values = (np.concatenate(part) for part in zip(*held))
            top = float(_lengths(values).max()) * (1 + 1e-9)
            return pa.RecordBatch.from_arrays(
                [pa.array([values.shape[1]], pa.int32()), pa.array([top]), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([values.tobytes()], pa.binary())], names
            )

        held, size = [], 0
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("vector")
            flat, dims = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            place = np.append(0, np.cumsum(dims))
            # Runs of vectors of one dimension.
            edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)] if len(dims) else []
            for first, last in zip(edges, edges[1:]):
                values = flat[place[first] : place[last]].reshape(last - first, dims[first])
                if held and held[0][1].shape[1] != dims[first]:
                    yield block(held)
                    held, size = [], 0
                at = 0
                while at < len(values):
                    end = min(at + limit - size, len(values))
                    held.append((ids[first + at : first + end], values[at:end]))
                    size += end - at
                    at = end
                    if size == limit:
                        yield block(held)
                        held, size = [], 0
        if held:
            yield block(held)

    return rows


def _lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((vectors**2).sum(axis=1))


_BLOCK_SCHEMA = "dim int, top double, ids binary, vectors binary"


def integers(vectors: DataFrame, id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows (id, vector, length) with components floor(scale * x), whole numbers in doubles; others are left out."""
    scaled = F.transform(F.col(vector), lambda c: c.cast("double") * scale)
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("id"), scaled.alias("vector"))
    rows = rows.filter(F.col("vector").isNotNull() & F.col("id").isNotNull() & finite & (F.size("vector") > 0))
    # A double from 2 ** 52 on is whole, and may be too large for floor.
    whole = F.transform("vector", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))
    length = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)
    return rows.select("id", whole.alias("vector")).withColumn("length", length)


def _load(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products, within the bounds of 64 bits; by floating point where all sums are below 2 ** 53."""
    asked, held = (np.abs(v).max(axis=1, initial=0) for v in (queries, vectors))
    dim = queries.shape[1]
    most = float(asked.max(initial=0)) * float(held.max(initial=0)) * dim
    if most < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    if most < 2.0**62 and max(asked.max(), held.max()) < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    # Few vectors are so large: the others are multiplied among themselves.
    limit = (2.0**61 / dim) ** 0.5
    few, rest = asked < limit, held < limit
    scores = np.empty((len(queries), len(vectors)), np.int64)
    if few.any() and rest.any():
        scores[np.ix_(few, rest)] = _products(queries[few], vectors[rest])
    for rows, columns in ((~few, np.ones_like(rest)), (few, ~rest)):
        if rows.any() and columns.any():
            exact = _whole(queries[rows]) @ _whole(vectors[columns]).T
            scores[np.ix_(rows, columns)] = np.clip(exact, LEAST, MOST).astype(np.int64)
    return scores


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers of any size."""
    return np.frompyfunc(int, 1, 1)(values)


def _best(scores: np.ndarray, ids: np.ndarray, keep: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best kept scores, ties to smaller ids."""
    at = np.flatnonzero(keep)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(k: int, bounded: bool):
    """Rows (query_id, vec_id, score): candidates of pairs of a query block and a bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked, queries = _load(row["query_ids"], row["query_vectors"], row["dim"])
                ids, vectors = _load(row["ids"], row["vectors"], row["dim"])
                bounds = np.frombuffer(row["bounds"], np.float64) if bounded else np.full(len(asked), -np.inf)
                # As doubles they may have been rounded up.
                bounds = np.where(np.abs(bounds) < 2.0**53, bounds, np.nextafter(bounds, -np.inf))
                found = list(_pair(asked, queries, bounds, ids, vectors, row["top"], k))
                columns = list(zip(*found)) or [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c) if len(c) else [], pa.int64()) for c in columns],
                    ["query_id", "vec_id", "score"],
                )

    return rows


def _pair(asked, queries, bounds, ids, vectors, top, k):
    length, own = _lengths(queries), _lengths(vectors)
    slack = 1 + 1e-9
    # Length pruning of the whole bucket: the local threshold is above 1. Lengths beyond doubles prune nothing.
    with np.errstate(all="ignore"):
        reach = np.nan_to_num(length * top * slack, nan=np.inf, posinf=np.inf)
    open_ = np.flatnonzero(reach >= bounds)
    if not len(open_):
        return
    known = (reach[open_] > 0) & (np.maximum(length[open_], top) < 1e150)  # squares are doubles
    local = np.where(known, bounds[open_] / np.maximum(reach[open_], 1e-300), -np.inf)
    sharp, flat = open_[local >= COORDINATE], open_[local < COORDINATE]
    for q in sharp:
        # The strongest coordinates exactly, what is left by its length.
        strong = np.argsort(-np.abs(queries[q]), kind="stable")[:STRONGEST]
        part = vectors[:, strong]
        head = part @ queries[q, strong]
        rest = np.sqrt(np.maximum(own**2 - (part**2).sum(axis=1), 0) + 1e-6 + 1e-12 * own**2)
        whole = length[q] ** 2
        tail = np.sqrt(max(whole - float((queries[q, strong] ** 2).sum()), 0) + 1e-6 + 1e-12 * whole)
        above = head + rest * tail * slack + 1e-3 + 1e-9 * own * length[q] >= bounds[q]
        left = np.flatnonzero(above & (own * length[q] * slack >= bounds[q]))
        if len(left):
            scores = _products(queries[q : q + 1], vectors[left])[0]
            yield from _rows(asked[q], scores, ids[left], bounds[q], k)
    if len(flat):
        scores = _products(queries[flat], vectors)
        for q, line in zip(flat, scores):
            yield from _rows(asked[q], line, ids, bounds[q], k)


def _rows(query, scores, ids, bound, k):
    at = _best(scores, ids, (scores >= bound) & (ids != query), k)
    if len(at):
        yield np.full(len(at), query), ids[at], scores[at]


#: Below all classes of length.
NONE = -100_000


def _length_class(length: Column) -> Column:
    """Classes of length, ``FINE`` for each doubling, so at most some hundred thousand; the last one for lengths beyond doubles."""
    return F.when(length > 0, F.floor(F.log2(F.least(length, F.lit(1e308))) * FINE).cast("int")).otherwise(NONE)


def numbered(buckets: DataFrame) -> DataFrame:
    """Staged buckets with their number by length within each dimension; vectors stay out of the window and its shuffle."""
    key = ["file", "row"]
    place = buckets.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = Window.partitionBy("dim").orderBy(F.desc("top"), *key)
    numbers = stage(place.select("dim", "top", *key).withColumn("bucket", F.row_number().over(order) - 1).drop("dim", "top"))
    # Small enough lists are broadcast by their measured size.
    return place.join(numbers, key).drop(*key)


def top_products(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the queries: rows whose id is divisible by ``every``."""
    rows = integers(vectors, id, vector, scale)
    size = F.size("vector")
    # Equal lengths are parted by id, so no length fills a task.
    sorted_rows = rows.withColumn("dim", size).repartitionByRange("dim", F.desc("length"), "id")
    sorted_rows = sorted_rows.sortWithinPartitions("dim", F.desc("length"), "id")
    buckets = stage(sorted_rows.select("id", "vector").mapInArrow(_blocks(BUCKET), _BLOCK_SCHEMA))
    buckets = numbered(buckets)
    chosen = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "vector"]).withColumn("dim", size)
    chosen = chosen.repartitionByRange("dim", "length", "id").sortWithinPartitions("dim", "length", "id")
    queries = stage(
        chosen.select("id", "vector").mapInArrow(_blocks(QUERIES), _BLOCK_SCHEMA)
        .select("dim", F.col("top").alias("query_top"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
        .withColumn("block", F.xxhash64("query_ids", "query_vectors"))
    )
    result = "query_id long, vec_id long, score long"
    pair = ["dim", "query_ids", "query_vectors", "ids", "vectors", "top"]
    first = stage(
        queries.join(buckets.filter(F.col("bucket") < FIRST), "dim").select(*pair).mapInArrow(_search(k, False), result)
    )
    # A lower bound for the k-th best, where k candidates are known.
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = (
        first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k)
        .select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    )
    bounded = _with_bounds(queries, bounds)
    # Longest vectors first: the buckets that a block can need are a leading run. Its length is counted on classes
    # of length, whose number does not grow with the vectors.
    classes = buckets.groupBy("dim", _length_class(F.col("top")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    tops = classes.groupBy("dim").agg(F.collect_list(F.struct("class", "n")).alias("tops"))
    cut = F.when(F.col("least") > 0, _length_class(F.try_divide("least", "query_top")) - 1).otherwise(NONE)
    needed = F.aggregate("tops", F.lit(0).cast("long"), lambda a, t: a + F.when(t["class"] >= F.col("cut"), t.n).otherwise(0))
    runs = bounded.join(F.broadcast(tops), "dim").withColumn("cut", F.coalesce(cut, F.lit(NONE)))
    runs = runs.withColumn("needed", needed).filter("needed > 0")
    runs = runs.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("needed") - 1))).drop("needed", "cut")
    pairs = runs.drop("tops").join(buckets, ["dim", "bucket"]).select(*pair, "bounds")
    found = pairs.mapInArrow(_search(k, True), result)
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_bounds(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """Query blocks with the bounds of their queries, and the least bound over query length."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("block").to_pylist(), batch.column("query_ids").to_pylist()):
                values = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(values), pa.int64()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)],
                    ["block", "place", "id"],
                )

    members = queries.select("block", "query_ids").mapInArrow(unpack, "block long, place int, id long")
    each = members.join(bounds, "id", "left").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf"))).alias("bound")))).alias("all"),
    )
    listed = each.select("block", F.transform("all", lambda x: x.bound).alias("list"), F.array_min(F.transform("all", lambda x: x.bound)).alias("least"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.array(x, np.float64).tobytes() for x in batch.column("list").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("least"), pa.array(held, pa.binary())], ["block", "least", "bounds"]
            )

    packed = listed.mapInArrow(pack, "block long, least double, bounds binary")
    return queries.join(packed, "block")
