"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

A phrase is two to ``LONGEST`` words in a row within a piece of a text; it is a
candidate if it occurs at least ``least`` times in its language. Candidates are
found and scored in these steps, all over whole texts:

1. Words are counted exactly, per language.
2. Word pairs of frequent words are summed up in their tasks, dealt out by a hash
   over partitions, and merged there into one Misra-Gries summary per hash
   partition. The masses of a partition arrive before its counts, so its capacity
   is set above mass / ``least``: what the merges take off every counter is then
   below ``least``, and each frequent pair survives.
3. The same for longer phrases, of which all word pairs survived.
4. The second pass counts the survivors exactly, as texts, and drops the others.

Survivors go to the tasks as a bitmap of fixed size (2 ** ``BITS`` bits); where
more phrases are frequent than it tells apart, more are counted, with the same
result. A task holds ``ENTRIES`` counts at a time, a summary the counters of its
partition, of which there are more the more text there is.

A candidate's score is the lowest over its cuts into a first and a last part of
1000 * a * n / (l * r), rounded down, in exact decimal arithmetic. Candidates that
lie inside a longer candidate that is as frequent (``percent`` of their count)
are dropped.

Edge cases: null texts are empty, null languages ``und``; empty texts and pieces
without words have no phrases; a very long text is worked on alone, whole;
repeated rows count each; ties in score go to the more frequent and then to the
lower phrase by UTF-8 bytes; an empty table gives no rows; other columns are
ignored. Words meet by 64-bit hashes within a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbench.llm.common import _BASE, PIECE_ENDS, Words, dealt, mix, slices, stage, text_of

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bits of the maps of frequent words and of surviving phrases (16 MB).
BITS = 27
#: Counters that a summary needs at most, by the number of hash partitions.
CAPACITY = 1 << 19
#: Counts that a task holds before it hands them on, and bytes of their texts.
ENTRIES, ENTRY_BYTES = 1 << 18, 64 << 20
#: Phrases that a task sums up before it hands their counts on.
CHUNK = 1 << 21
_ENDS = np.isin(np.arange(256), np.frombuffer(PIECE_ENDS, np.uint8))
_SLICE_BITS = 4


class Text:
    """Words of a slice of texts: hashes that tell languages apart, and the piece each word is in."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = Words(batch.column("text"), "phrase")
        coded = batch.column("lang").dictionary_encode()
        self.languages = coded.dictionary.to_pylist()
        self.language = coded.indices.to_numpy()
        seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.languages]
        seed = np.array(seeds, np.uint64)[self.language]
        self.hash = mix(self.words.hash ^ seed[self.words.text])
        ends = np.concatenate([[0], np.cumsum(_ENDS[self.words.lower])])
        self.piece = ends[self.words.start] + self.words.text
        self.data = self.words.lower.tobytes()

    def label(self, at: int, size: int) -> tuple[str, str]:
        """Language and text of the phrase at a word; blanks between words become one space."""
        spans = zip(self.words.start[at : at + size].tolist(), self.words.end[at : at + size].tolist())
        text = b" ".join([self.data[a:b] for a, b in spans])
        return self.languages[self.language[self.words.text[at]]], text.decode("utf-8", "replace")


class Bitmap:
    """Which hashes may be in a set, by their leading bits; it has no false negatives."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def found(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        return (self.packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame) -> Bitmap:
    """The bitmap of a column ``hash``; built in 2 ** ``_SLICE_BITS`` parts, each of a fixed size."""
    width = 1 << (BITS - _SLICE_BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place, number = batch.column("place").to_numpy(), batch.column("part").to_numpy()
            for part in np.unique(number).tolist():
                held.setdefault(part, np.zeros(width, bool))[place[number == part] % width] = True
        for part, bits in held.items():
            packed = np.packbits(bits, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["part", "bits"])

    # Distinct places first: what the few tasks read is bounded by the bitmap, not by the hashes.
    place = F.shiftrightunsigned("hash", 64 - BITS).alias("place")
    numbered = hashes.select(place).distinct().withColumn("part", F.shiftright("place", BITS - _SLICE_BITS))
    parts = numbered.repartition(1 << _SLICE_BITS, "part").mapInArrow(build, "part int, bits binary").collect()
    packed = np.zeros(1 << (BITS - 3), np.uint8)
    for row in parts:
        at = row["part"] * width // 8
        packed[at : at + width // 8] = np.frombuffer(row["bits"], np.uint8)
    return Bitmap(packed)


def _grams(text: Text, frequent: Bitmap, pairs: Bitmap | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size from 2 on: hashes of the phrases of frequent words and their first words.

    With ``pairs``, longer phrases hold surviving word pairs only.
    """
    known = frequent.found(text.hash)
    value, valid, joined = text.hash, known, None
    for size in range(2, LONGEST + 1):
        n = len(text.hash) - size + 1
        if n <= 0:
            return
        last = size - 1
        value = mix(value[:n] * np.uint64(_BASE) + text.hash[last:])
        valid = valid[:n] & known[last:] & (text.piece[:n] == text.piece[last:])
        if pairs is not None:
            if size == 2:
                joined = pairs.found(value)
            valid = valid & joined[size - 2 : size - 2 + n]
        at = np.flatnonzero(valid)
        yield size, value[at], at
        if pairs is None and size == 2:
            return


def _counted(select: Callable[[Text], Iterator[tuple[int, np.ndarray, np.ndarray]]]):
    """Rows (lang, phrase, size, hash, n) of the selected phrases, summed up within a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        labels: dict[int, tuple[str, str, int]] = {}
        held = 0

        def out():
            keys = list(counts)
            lang, phrase, size = zip(*[labels[k] for k in keys]) if keys else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(size, pa.int32()),
                 pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([counts[k] for k in keys], pa.int64())],
                ["lang", "phrase", "size", "hash", "n"],
            )

        for whole in batches:
            for batch in slices(whole, "text"):
                text = Text(batch)
                for size, hashes, at in select(text):
                    keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
                    for key, place, more in zip(keys.tolist(), at[first].tolist(), n.tolist()):
                        if key in counts:
                            counts[key] += more
                        else:
                            lang, phrase = text.label(place, size)
                            counts[key], labels[key] = more, (lang, phrase, size)
                            held += len(phrase)
                if len(counts) >= ENTRIES or held >= ENTRY_BYTES:
                    yield out()
                    counts, labels, held = {}, {}, 0
        yield out()

    return rows


_COUNTED = "lang string, phrase string, size int, hash long, n long"


def _summaries(select: Callable[[Text], Iterator[tuple[int, np.ndarray, np.ndarray]]], parts: int):
    """Summaries of chunks, one per hash partition: a row of its mass (kind 0) and one of its counts (kind 1)."""

    def chunk(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        part = (keys % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order].astype(np.int32), part[order]
        present, starts = np.unique(part, return_index=True)
        ends = np.append(starts, len(part))[1:]
        mass = np.add.reduceat(n.astype(np.int64), starts)
        count = len(present)

        def binary(values: np.ndarray) -> pa.Array:
            width = values.itemsize
            offsets = np.concatenate([np.zeros(count + 1), ends * width]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), 2 * count, [None, pa.py_buffer(offsets), pa.py_buffer(values)])

        kind = np.repeat([0, 1], count).astype(np.int32)
        masses = np.concatenate([mass, np.zeros(count, np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(present, 2)), pa.array(kind), pa.array(masses), binary(keys), binary(n)],
            ["part", "kind", "mass", "hashes", "counts"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for _, hashes, _ in select(Text(batch)):
                    held.append(hashes)
                    size += len(hashes)
                if size >= CHUNK:
                    yield chunk(held)
                    held, size = [], 0
        if size:
            yield chunk(held)

    return rows


class MisraGries:
    """A summary of at most ``capacity`` counters; a true count is at most its counter plus ``lost``."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Add up what waits; of too many counters, all lose the count of the first one too many."""
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts)
        over = len(self.keys) - self.capacity
        if over > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            self.lost += cut
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut


def _merged(least: int):
    """Merge the summaries of each hash partition, whose masses come first; rows of hashes that may be frequent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def out():
            if summary is None:
                return
            summary.settle()
            kept = summary.keys[summary.counts + summary.lost >= least]
            yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64))], ["hash"])

        for batch in batches:
            columns = [batch.column(c) for c in ("part", "kind", "mass", "hashes", "counts")]
            for number, kind, more, keys, counts in zip(*[c.to_pylist() for c in columns]):
                if number != part:
                    yield from out()
                    part, mass, summary = number, 0, None
                if kind == 0:
                    mass += more
                    continue
                if summary is None:
                    summary = MisraGries(mass // least + 1)
                summary.merge(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64))
        yield from out()

    return rows


def survivors(docs: DataFrame, select, mass: int, least: int) -> DataFrame:
    """Hashes of all phrases that may occur ``least`` times; ``mass`` bounds the number of phrases."""
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(4 * shuffles, -(-mass // (least * CAPACITY)))
    schema = "part int, kind int, mass long, hashes binary, counts binary"
    summed = dealt(docs.mapInArrow(_summaries(select, parts), schema), "part").sortWithinPartitions("part", "kind")
    return stage(summed.mapInArrow(_merged(least), "hash long"))


def counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, size, n) of all words and phrases that occur ``least`` times, and words per language."""
    texts = docs.select(text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    key = ["lang", "phrase", "size"]
    found = texts.mapInArrow(_counted(lambda t: iter([(1, t.hash, np.arange(len(t.hash)))])), _COUNTED)
    words = stage(found.groupBy(*key, "hash").agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    mass = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = words.filter(F.col("n") >= least)
    known = bitmap(words)
    pairs = bitmap(survivors(texts, lambda t: _grams(t, known), mass, least))

    def longer(text: Text):
        return (x for x in _grams(text, known, pairs) if x[0] > 2)

    longs = bitmap(survivors(texts, longer, mass * (LONGEST - 2), least))

    def surviving(text: Text):
        for size, hashes, at in _grams(text, known, pairs):
            left = longs.found(hashes) if size > 2 else np.ones(len(hashes), bool)
            yield size, hashes[left], at[left]

    exact = texts.mapInArrow(_counted(surviving), _COUNTED).groupBy(*key).agg(F.sum("n").alias("n"))
    frequent = exact.filter(F.col("n") >= least).unionByName(words.select(*key, "n"))
    return stage(frequent), totals


def _joined(start, length):
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = 100, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations."""
    known, totals = counts(docs, least)
    phrases = known.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    k = F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.lit(1), k).alias("first"), _joined(k + 1, F.col("size") - k).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "total", "l", "r")}
    score = F.call_function("div", exact["a"] * exact["total"] * F.lit(1000).cast("decimal(4,0)"), exact["l"] * exact["r"])
    cuts = cuts.join(totals, "lang").withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("cut"))

    inner = phrases.filter("size > 2").withColumn("length", F.explode(F.expr("sequence(2, size - 1)")))
    inner = inner.withColumn("start", F.explode(F.expr("sequence(1, size - length + 1)")))
    inner = inner.groupBy("lang", _joined(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("a").alias("around"))
    rows = best.join(inner, ["lang", "phrase"], "left").select("lang", "phrase", "cut.*", "around")
    free = rows.filter(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
