"""Helpers that several operators share: text batches, word hashes, stage tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.session import bound_batches, tune
from pairbench.sources import files

# Batches of texts are worked on in slices of at most this many bytes (or one text, if it is longer).
SLICE_BYTES = 1 << 18

_MASK = (1 << 64) - 1


def prepare(spark: SparkSession) -> SparkSession:
    """Adaptive execution, Arrow batches that bound a worker's memory, and no shuffle files of ended queries."""
    bound_batches(spark)
    # Operators hand over in stage tables, so a query's shuffle files may go when it ends.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return tune(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write to a new folder below ``spark.checkpoint.dir`` and read back."""
    return files.stage(df)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Short rows that stand for much work, over as many tasks as a shuffle has.

    Without a number, adaptive execution would merge them by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def text_of(column: str = "text") -> Column:
    """A text column with nulls as empty texts."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece has over ``limit`` bytes in a text column, unless it is one row."""
    offsets = text_offsets(batch.column(column))
    at, rows = 0, batch.num_rows
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield batch.slice(at, end - at)
        at = end


def text_offsets(texts: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=width)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an array of texts without nulls, and the offsets of the texts in them."""
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one (the finisher of the splitmix generator)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0xD6E8FEB86659FD93
_LOW_BYTES = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)


def powers(count: int, base: int = _BASE) -> np.ndarray:
    steps = np.full(max(count, 1), base & _MASK, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


#: Bytes that end a piece of text, within which phrases lie.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"


def _inside(kind: str) -> bytes:
    """Which bytes belong to words: all but white space, or letters, digits and non-ASCII bytes, or all but blanks and ends of pieces."""
    if kind == "space":
        return bytes(0 if c == 32 or 9 <= c <= 13 else 1 for c in range(256))
    if kind == "phrase":
        return bytes(0 if c in b" \t" + PIECE_ENDS else 1 for c in range(256))
    return bytes(1 if c >= 128 or chr(c).isalnum() else 0 for c in range(256))


_INSIDE = {kind: _inside(kind) for kind in ("space", "letter", "phrase")}


class Words:
    """The words of an array of texts, in order: hash of the bytes in lower case, text number, byte span."""

    def __init__(self, texts: pa.Array, kind: str = "space"):
        data, self.offsets = text_bytes(texts)
        self.texts, size = len(texts), len(data)
        lower = data.tobytes().lower()
        self.lower = np.frombuffer(lower, np.uint8)
        inside = np.frombuffer(b"\0" + lower.translate(_INSIDE[kind]) + b"\0", bool)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        # A word ends with its text, also where the next text goes on at once.
        cuts = np.unique(self.offsets)
        cuts = cuts[inside[cuts] & inside[cuts + 1]]
        if len(cuts):
            edges = np.sort(np.concatenate([edges, cuts, cuts]))
        self.start, self.end = edges[0::2], edges[1::2]
        self.text = np.repeat(np.arange(self.texts), np.diff(np.searchsorted(self.start, self.offsets)))
        # Eight bytes at a time; most words need one step.
        blocks = np.lib.stride_tricks.as_strided(
            np.frombuffer(lower + bytes(8), np.uint8)[: size + 1], (size + 1, 8), (1, 1)
        ) if size else np.zeros((1, 8), np.uint8)
        length = self.end - self.start
        value = length.astype(np.uint64)
        todo = np.arange(len(length))
        at = 0
        while len(todo):
            word = blocks[self.start[todo] + at].view("<u8").ravel()
            word &= _LOW_BYTES[np.minimum(length[todo] - at, 8)]
            value[todo] = mix(value[todo] * np.uint64(_BASE) + word)
            at += 8
            todo = todo[length[todo] > at]
        self.hash = value

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.text, minlength=self.texts).astype(np.int64)


def chain(hashes: np.ndarray, text: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word sequences: word i with the words at i + gap, all within a text; and their texts."""
    reach = max(gaps, default=0)
    n = len(hashes) - reach
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = hashes[:n].copy()
    for gap in gaps:
        value = mix(value * np.uint64(_BASE) + hashes[gap : gap + n] + np.uint64(gap))
    whole = text[:n] == text[reach : reach + n]
    return value[whole], text[:n][whole]


def code_points(data: bytes, at: int) -> int:
    """Number of code points before a byte offset."""
    return len(data[:at].decode("utf-8", "replace"))
