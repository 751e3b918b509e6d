"""Exact substring deduplication with two-stage suffix sorting.

Bytes go that lie in a string of ``SPAN`` bytes which starts anywhere else too.
One suffix array of all texts would be one task's work, so suffixes are dealt out
by content such that equal strings always meet:

1. *Anchors.* Each string of ``SPAN`` bytes has as anchor its least ``GRAM``-byte
   substring by hash (the last of equals), so equal strings have equal anchors at
   equal places. Neighbouring strings mostly share one; such a run is a region, a
   piece of text of less than twice the span.
2. *Shared anchors.* Regions whose anchor occurs once hold no repeated string.
   Regions with equal bytes around their anchor are one class; all strings of a
   class with several members repeat, and one member represents it.
3. *Suffix sorting.* Representatives that share an anchor, and of which one stands
   alone, meet in one task. Their suffixes are sorted in two stages: those smaller
   than their successors directly, the rest induced from them by a scan of the
   buckets of first bytes. Adjacent common prefixes then show repeated strings.

Of a bucket with over ``MEMBERS`` representatives, one anchor's regions could fill
a task; there every string is a row, and counts of equal strings decide.

Edge cases: null and empty texts have no bytes and keep none; texts shorter than
the span stay; a repeated row repeats all its strings; rows with a null id and
repeated ids are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.common import mix, powers, slices, stage, text_bytes, text_of

SPAN = 200
GRAM = 64
MEMBERS = 4096
#: Bytes whose suffixes are sorted together, unless one anchor has more.
CHUNK = 1 << 18
#: Texts up to so many are picked by a broadcast of their keys; beyond it, texts shuffle.
BROADCAST_IDS = 1_000_000
_PLACE_BITS = 28
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


class Hashes:
    """Hashes of any substrings of some bytes."""

    cached: list[np.ndarray] = [powers(1, _BASE), powers(1, _INVERSE)]

    def __init__(self, data: np.ndarray):
        if len(self.cached[0]) <= len(data):
            size = 1 << len(data).bit_length()
            Hashes.cached = [powers(size, _BASE), powers(size, _INVERSE)]
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SYMBOLS[data] * self.cached[0][: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * self.cached[1][start]


def regions(data: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """Runs of strings with one anchor: text, first string, number of strings, anchor hash, class hash."""
    strings = len(data) - span + 1
    if strings <= 0:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    hashes = Hashes(data)
    n = len(data) - gram + 1
    grams = mix((hashes.prefix[gram:] - hashes.prefix[:-gram]) * hashes.cached[1][:n])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    # The least hash wins, then the last place.
    key = (grams & ~low) | (low - np.arange(n, dtype=np.uint64))
    width = span - gram + 1
    least, reach = key, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:strings], least[width - reach : width - reach + strings])
    anchor = (low - (least & low)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:strings]
    whole = np.arange(strings) + span <= offsets[text + 1]
    fresh = np.ones(strings, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh & whole)
    last = np.append(first[1:], strings) - 1
    # A run ends where the strings of its text end.
    last = np.minimum(last, offsets[text[first] + 1] - span)
    count = last - first + 1
    owner = text[first]
    place = (anchor[first] - first).astype(np.uint64)
    tag = mix(place << np.uint64(32) | count.astype(np.uint64))
    classes = mix(hashes.of(first, last + span) + tag)
    return owner, first - offsets[owner], count, grams[anchor[first]], classes


def _regions(span: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                owner, first, count, anchor, classes = regions(data, offsets, span, gram)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at), batch.column("tag").take(at), pa.array(first, pa.int32()),
                        pa.array(count, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(classes.view(np.int64)),
                    ],
                    ["id", "tag", "first", "count", "anchor", "class"],
                )

    return rows


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    rises = np.append(text[:-1] < text[1:], False)
    # Equal bytes decide as the next place does where they differ.
    following = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    return rises[following]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    direct = smaller_than_next(text)
    counts = np.bincount(text, minlength=256)
    start = np.cumsum(counts) - counts
    end = start + counts
    order = np.empty(n, np.int64)
    # Stage one: sort the suffixes that are smaller than their successors.
    chosen = np.flatnonzero(direct)
    if len(chosen):
        padded = np.append(text, np.zeros(depth, np.uint8))
        view = np.lib.stride_tricks.sliding_window_view(padded, depth)[chosen]
        keys = np.ascontiguousarray(view).view(f"S{depth}").ravel()
        ranked = chosen[np.argsort(keys, kind="stable")]
        # They are the last of their buckets.
        heads = text[ranked]
        number = np.bincount(heads, minlength=256)
        begin = np.cumsum(number) - number
        order[end[heads] - number[heads] + np.arange(len(ranked)) - begin[heads]] = ranked
    # Stage two: scan buckets from the left, each suffix placing its predecessor if that is larger.
    head = start.copy()
    order[head[text[-1]]] = n - 1
    head[text[-1]] += 1
    for c in np.flatnonzero(counts):
        at = start[c]
        while at < head[c]:
            # Predecessors with the same first byte come into this bucket, in rounds.
            before = order[at : head[c]] - 1
            at = head[c]
            before = before[before >= 0]
            before = before[(text[before] == c) & ~direct[before]]
            order[at : at + len(before)] = before
            head[c] = at + len(before)
        before = order[start[c] : end[c]] - 1
        before = before[before >= 0]
        before = before[(text[before] > c) & ~direct[before]]
        target = text[before]
        sort = np.argsort(target, kind="stable")
        before, target = before[sort], target[sort]
        number = np.bincount(target, minlength=256)
        begin = np.cumsum(number) - number
        order[head[target] + np.arange(len(before)) - begin[target]] = before
        head += number
    return order


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of common prefixes of pairs of suffixes, up to a limit that no suffix is shorter than."""
    length = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    wide = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8)
    for at in range(0, limit, 8):
        step = min(8, limit - at)
        same = wide[a[alive] + at] == wide[b[alive] + at]
        run = np.minimum(np.where(same.all(axis=1), 8, (~same).argmax(axis=1)), step)
        length[alive] += run
        alive = alive[run == step]
    return length


def repeated(texts: list[bytes], counts: list[int], span: int) -> list[np.ndarray]:
    """For each region, which of its first ``counts`` strings occur again among all of them."""
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    valid = np.zeros(len(text), bool)
    for b, n in zip(begin, counts):
        valid[b : b + n] = True
    order = suffix_array(text, span)
    order = order[valid[order]]
    found = np.zeros(len(text), bool)
    if len(order) > 1:
        equal = common_prefix(text, order[:-1], order[1:], span) >= span
        found[order[:-1][equal]] = True
        found[order[1:][equal]] = True
    return [found[b : b + n] for b, n in zip(begin, counts)]


_SPANS = "id long, tag long, start int, stop int"


def _spans_of(rows: list[tuple], flags: list[np.ndarray], span: int) -> pa.RecordBatch:
    found = []
    for (id, tag, first, alone), hit in zip(rows, flags):
        if alone and hit.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            found += [(id, tag, first + int(a), first + int(b) - 1 + span) for a, b in zip(edges[0::2], edges[1::2])]
    columns = list(zip(*found)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
        ["id", "tag", "start", "stop"],
    )


def _sort_suffixes(span: int):
    """Regions sorted by anchor to spans of repeated strings."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, size, texts, counts, kept = None, 0, [], [], []
        for batch in batches:
            for a, data, count, *rest in zip(
                *(batch.column(c).to_pylist() for c in ("anchor", "bytes", "count", "id", "tag", "first", "alone"))
            ):
                if a != anchor and size >= CHUNK:
                    yield _spans_of(kept, repeated(texts, counts, span), span)
                    size, texts, counts, kept = 0, [], [], []
                anchor = a
                size += len(data)
                texts.append(data)
                counts.append(count)
                kept.append(tuple(rest))
        if texts:
            yield _spans_of(kept, repeated(texts, counts, span), span)

    return rows


def _cut(span: int):
    """Bytes of the wanted regions of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "bytes", "count", "id", "tag", "first", "alone", "crowded"]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
        for batch in batches:
            found = []
            for id, tag, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "text", "wanted"))):
                data = text.encode()
                found += [
                    (w["anchor"], data[w["first"] : w["first"] + w["count"] - 1 + span], w["count"], id, tag, w["first"], w["alone"], w["crowded"])
                    for w in wanted
                ]
            columns = list(zip(*found)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans"))):
            data = np.frombuffer(text.encode(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int32)
            for s in spans or ():
                edge[s["start"]] += 1
                edge[s["stop"]] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            found.append((id, len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        columns = list(zip(*found)) or [[]] * 5
        types = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def repeated_spans(source: DataFrame, span: int = SPAN, gram: int = GRAM, members: int = MEMBERS) -> DataFrame:
    """Rows (id, tag, start, stop): byte spans of repeated strings; they may overlap.

    ``source`` has (id, tag, text); id and tag together name a row.
    """
    found = stage(
        source.mapInArrow(_regions(span, gram), "id long, tag long, first int, count int, anchor long, class long")
    )
    shared = stage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    kept = stage(found.join(shared, "anchor"))
    key = ["anchor", "class"]
    rep = F.min(F.struct("id", "tag", "first", "count")).alias("rep")
    classes = stage(kept.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), rep))
    several = kept.join(classes.filter("n > 1").select(*key), key, "left_semi")
    spans = several.select("id", "tag", F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + span).alias("stop"))

    # Anchors where a class stands alone among others: its strings may still repeat.
    sizes = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least"))
    unsure = stage(sizes.filter("classes > 1 AND least = 1").select("anchor", (F.col("classes") > members).alias("crowded")))
    wanted = (
        classes.join(unsure, "anchor")
        .select("rep.id", "rep.tag", F.struct("anchor", "rep.first", "rep.count", (F.col("n") == 1).alias("alone"), "crowded").alias("w"))
        .groupBy("id", "tag").agg(F.collect_list("w").alias("wanted"))
    )
    wanted = stage(wanted)
    few = wanted.count() <= BROADCAST_IDS
    texts = source.join(F.broadcast(wanted.select("id", "tag")), ["id", "tag"], "left_semi") if few else source
    cut = texts.join(wanted, ["id", "tag"]).mapInArrow(
        _cut(span), "anchor long, bytes binary, count int, id long, tag long, first int, alone boolean, crowded boolean"
    )
    cut = stage(cut)
    sorted_spans = (
        cut.filter("NOT crowded").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_suffixes(span), _SPANS)
    )
    # Crowded anchors: each string by itself, wherever it lies.
    strings = cut.filter("crowded").select(
        "anchor", "id", "tag", "alone", "first", "bytes", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("at")
    )
    strings = strings.select(
        "anchor", "id", "tag", "alone", (F.col("first") + F.col("at")).alias("start"),
        F.md5(F.expr(f"substring(bytes, at + 1, {span})")).alias("string"),
    )
    twice = strings.groupBy("anchor", "string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = strings.filter("alone").join(twice.select("anchor", "string"), ["anchor", "string"], "left_semi")
    return spans.unionAll(sorted_spans).unionAll(
        counted.select("id", "tag", "start", (F.col("start") + span).cast("int").alias("stop"))
    )


def deduplicated(docs: DataFrame, span: int = SPAN, gram: int = GRAM, members: int = MEMBERS, id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256): one for each row of ``docs``."""
    text = text_of()
    source = docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text, F.col(id).isNull()).alias("tag"), text.alias("text"), F.col(id).isNull().alias("missing"),
    )
    spans = stage(repeated_spans(source.select("id", "tag", "text"), span, gram, members))
    per_text = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = source.join(per_text, ["id", "tag"], "left")
    done = joined.select(F.when(~F.col("missing"), F.col("id")).alias("id"), "text", "spans").mapInArrow(
        _finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return done.withColumnRenamed("id", id)
