"""Token-ID files: static range asymmetric numeral system over interleaved blocks.

Texts are put in order by a range shuffle, tokenised, and coded in segments of
about ``SEGMENT`` tokens. A segment is one file::

    header   magic, scale, counts of documents, table entries and blocks
    table    token ids and their frequencies, shared by all blocks of the file
    index    document ids and lengths; byte offset of each block
    blocks   each with its own states, checkpoints, words and checksum
    crc32    of header, table and index

A block is coded by itself: its tokens go in turn to ``LANES`` coders with
64-bit states that share one stream of 32-bit words. Every ``STRIDE`` steps a
checkpoint holds all states and the place in the stream, so that decoding can
begin there. Blocks and checkpoints make decoding parallel below the level of
files; each is checked by its crc32.

A writing task holds one segment at a time. Files have names of their own, and
only those in the returned manifest count, so an attempt that was lost leaves
nothing behind that is read.

Edge cases: null and empty texts have only the end id; rows with a null id come
first; repeated ids stand side by side, ordered by text; an empty table gives no
file. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairbench.llm import store
from pairbench.llm.common import dealt, slices, stage, text_of
from pairbench.session import shared_dir

END = 2
SEGMENT = 8 << 20
BLOCK = 2 << 20
LANES = 4096
STRIDE = 256
SCALE = 18
#: Words that a Python worker remembers with their ids, about 200 bytes each.
CACHE = 500_000
_LOW = np.uint64(1 << 31)
_SIGNS = ".,;:!?"
_GROUP = 100
_MAGIC = b"TIDRANS1"
_HEAD = struct.Struct("<8sIIII")
_BLOCK_HEAD = struct.Struct("<IIIII")


class Tokens:
    """Token ids of texts by a tokenizer that never joins across white space.

    Such a tokenizer gives a text the ids of its words one after another, so each
    distinct word is tokenised once per batch, or not at all if it is remembered.
    A word of letters alone has the same ids with or without the signs after it
    and whatever the case of its ASCII letters, if the tokenizer lower-cases; then
    many of them go to the tokenizer as one text, and the tokens that end a word
    part its ids again.
    """

    #: Kept by a worker for all its tasks.
    remembered: dict[str, dict[str, bytes]] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        self.tokenizer = Tokenizer.from_file(path)
        self.known = self.remembered.setdefault(path, {})
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ends = [i for token, i in vocabulary.items() if token.endswith("</w>")]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[ends] = True
        probe = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Word", "word", "word word", "word.", ".")]
        self.folds = bool(ends) and probe[0] == probe[1] and probe[2] == 2 * probe[1] and probe[3] == probe[1] + probe[4]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, np.uint32).tobytes() for f in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        groups = [words[i : i + _GROUP] for i in range(0, len(words), _GROUP)]
        found = []
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            values = np.frombuffer(ids, np.uint32)
            stops = 4 * (np.flatnonzero(self.ends[np.minimum(values, len(self.ends) - 1)]) + 1)
            if len(stops) == len(group) and stops[-1] == len(ids):
                stops = stops.tolist()
                found += [ids[a:b] for a, b in zip([0, *stops], stops)]
            else:
                found += self._encode(group)
        return found

    def _ids(self, units: pa.Array) -> list[bytes]:
        """Ids of distinct words, or of words of letters and of the signs after them."""
        names = units.to_numpy(zero_copy_only=False).tolist()
        fresh = [n for n in names if n not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = names
        letters = [n for n in fresh if n.isalpha()] if self.folds else []
        self.known.update(zip(letters, self._encode_words(letters)))
        rest = [n for n in fresh if n not in self.known]
        self.known.update(zip(rest, self._encode(rest)))
        return [self.known[n] for n in names]

    def _word_ids(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words."""
        if not self.folds:
            return self._ids(words)
        core = pc.ascii_rtrim(words, _SIGNS)
        plain = pc.utf8_is_alpha(core)
        units = pc.if_else(plain, pc.ascii_lower(core), words).dictionary_encode()
        found = self._ids(units.dictionary)
        cut = pc.if_else(plain, pc.subtract(pc.binary_length(words), pc.binary_length(core)), 0).to_numpy()
        signed = np.flatnonzero(cut)
        tails = [w[-c:] for w, c in zip(words.take(pa.array(signed)).to_numpy(zero_copy_only=False), cut[signed].tolist())]
        kinds = sorted(set(tails))
        coded = dict(zip(kinds, self._encode(kinds)))
        held = [found[u] for u in units.indices.to_numpy().tolist()]
        for at, tail in zip(signed.tolist(), tails):
            held[at] += coded[tail]
        return held

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        held = self._word_ids(coded.dictionary)
        length = np.array([len(h) for h in held], np.int64) // 4
        every = np.frombuffer(b"".join(held), np.uint32)
        first = np.cumsum(length) - length
        which = coded.indices.to_numpy()
        size = length[which]
        total = np.append(0, np.cumsum(size))
        ids = every[np.repeat(first[which] - total[:-1], size) + np.arange(total[-1])]
        offsets = words.offsets.to_numpy().astype(np.int64)
        return ids, np.diff(total[offsets - offsets[0]])


def frequencies(ids: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their frequencies, which sum to ``2 ** scale`` and are at least one."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    if not len(ids):
        return symbols.astype(np.uint32), counts.astype(np.uint32)
    spare = (1 << scale) - len(symbols)
    if spare < 0:
        raise ValueError("more distinct ids than frequencies")
    freq = 1 + counts * spare // max(counts.sum(), 1)
    freq[np.argmax(counts)] += (1 << scale) - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def encode_block(rank: np.ndarray, freq: np.ndarray, scale: int = SCALE, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """A block of ranks in the frequency table."""
    n = len(rank)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    f = freq.astype(np.uint64)
    c = np.cumsum(f) - f
    bits, most = np.uint64(scale), f << np.uint64(63 - scale)
    x = np.full(lanes, _LOW, np.uint64)
    words, counts, points = [], np.zeros(steps, np.int64), {}
    for step in range(steps - 1, -1, -1):
        symbol = rank[step * lanes : (step + 1) * lanes]
        part, fs = x[: len(symbol)], f[symbol]
        full = part >= most[symbol]
        out = part[full]
        if len(out):
            words.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            counts[step] = len(out)
            part[full] = out >> np.uint64(32)
        quotient = part // fs
        part[:] = (quotient << bits) + (part - quotient * fs) + c[symbol]
        if step % stride == 0:
            points[step] = x.copy()
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    before = np.cumsum(counts) - counts
    body = b"".join(struct.pack("<I", before[s]) + points[s].tobytes() for s in sorted(points))
    head = _BLOCK_HEAD.pack(n, lanes, stride, len(points), len(stream))
    block = head + body + stream.tobytes()
    return block + struct.pack("<I", zlib.crc32(block))


def decode_block(
    block: bytes, freq: np.ndarray, slots: np.ndarray, scale: int = SCALE, checkpoint: int = 0, last: int | None = None
) -> np.ndarray:
    """Ranks from a checkpoint on, up to another one (or the end)."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block's checksum is wrong")
    n, lanes, stride, points, size = _BLOCK_HEAD.unpack_from(block)
    if n == 0:
        return np.empty(0, np.int64)
    at = _BLOCK_HEAD.size + checkpoint * (4 + 8 * lanes)
    place = struct.unpack_from("<I", block, at)[0]
    x = np.frombuffer(block, np.uint64, lanes, at + 4).copy()
    stream = np.frombuffer(block, np.uint32, size, _BLOCK_HEAD.size + points * (4 + 8 * lanes))
    f = freq.astype(np.uint64)
    c = np.cumsum(f) - f
    mask, bits = np.uint64((1 << scale) - 1), np.uint64(scale)
    begin = checkpoint * stride
    end = -(-n // lanes) if last is None or last >= points else last * stride
    found = np.empty(min(n, end * lanes) - begin * lanes, np.int64)
    for step in range(begin, end):
        row = found[(step - begin) * lanes : (step - begin + 1) * lanes]
        part = x[: len(row)]
        low = part & mask
        row[:] = symbol = slots[low]
        part[:] = f[symbol] * (part >> bits) + low - c[symbol]
        hungry = part < _LOW
        k = int(np.count_nonzero(hungry))
        if k:
            part[hungry] = (part[hungry] << np.uint64(32)) | stream[place : place + k]
            place += k
    return found


def pack(ids: np.ndarray, docs: Sequence[int | None], lengths: np.ndarray, scale: int = SCALE, block: int = BLOCK) -> bytes:
    """A segment file."""
    symbols, freq = frequencies(ids, scale)
    place = np.zeros(int(symbols.max(initial=0)) + 1, np.uint32)
    place[symbols] = np.arange(len(symbols))
    rank = place[ids]
    blocks = [encode_block(rank[a : a + block], freq, scale) for a in range(0, len(rank), block)]
    known = np.array([d is not None for d in docs], np.uint8)
    names = np.array([d or 0 for d in docs], np.int64)
    index = zlib.compress(known.tobytes() + names.tobytes() + lengths.astype(np.uint32).tobytes())
    sizes = np.array([len(b) for b in blocks], np.uint32)
    head = _HEAD.pack(_MAGIC, scale, len(docs), len(symbols), len(blocks))
    table = zlib.compress(symbols.tobytes() + freq.tobytes())
    front = head + struct.pack("<II", len(table), len(index)) + table + index + sizes.tobytes()
    return front + struct.pack("<I", zlib.crc32(front)) + b"".join(blocks)


class Segment:
    """A segment file, read lazily block by block."""

    def __init__(self, data: bytes):
        magic, self.scale, docs, entries, blocks = _HEAD.unpack_from(data)
        table, index = struct.unpack_from("<II", data, _HEAD.size)
        at = _HEAD.size + 8
        end = at + table + index + 4 * blocks
        if magic != _MAGIC or end + 4 > len(data) or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError("not a token file, or its header's checksum is wrong")
        raw = zlib.decompress(data[at : at + table])
        self.symbols = np.frombuffer(raw, np.uint32, entries)
        self.freq = np.frombuffer(raw, np.uint32, entries, 4 * entries)
        self.slots = np.repeat(np.arange(entries, dtype=np.uint16 if entries <= 1 << 16 else np.uint32), self.freq)
        raw = zlib.decompress(data[at + table : at + table + index])
        known = np.frombuffer(raw, np.uint8, docs)
        names = np.frombuffer(raw, np.int64, docs, docs).tolist()
        self.docs = [n if k else None for n, k in zip(names, known)]
        self.lengths = np.frombuffer(raw, np.uint32, docs, 9 * docs).astype(np.int64)
        sizes = np.frombuffer(data, np.uint32, blocks, at + table + index).astype(np.int64)
        self.bounds = end + 4 + np.append(0, np.cumsum(sizes))
        self.data = data

    def block(self, number: int, checkpoint: int = 0, last: int | None = None) -> np.ndarray:
        data = self.data[self.bounds[number] : self.bounds[number + 1]]
        return self.symbols[decode_block(data, self.freq, self.slots, self.scale, checkpoint, last)]

    def ids(self) -> np.ndarray:
        blocks = [self.block(i) for i in range(len(self.bounds) - 1)]
        return np.concatenate(blocks) if blocks else np.empty(0, np.uint32)


def _writer(folder: str, tokens: Callable[[], Tokens], end: int, segment: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokens(), TaskContext.get().partitionId()
        held, docs, lengths, size, number = [], [], [], 0, 0

        def flush():
            path = store.new_file(folder, ".tid")
            data = pack(np.concatenate(held), docs, np.concatenate(lengths))
            store.write(path, data)
            names = ["part", "number", "path", "docs", "tokens", "bytes"]
            values = [part, number, path, len(docs), size, len(data)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.string()] + 3 * [pa.int64()])], names
            )

        for whole in batches:
            for batch in slices(whole, "text", 1 << 22):
                ids, counts = encode(batch.column("text"))
                # The end id of each text.
                ids = np.insert(ids, np.cumsum(counts), end)
                held.append(ids.astype(np.uint32))
                docs += batch.column("id").to_pylist()
                lengths.append(counts + 1)
                size += len(ids)
                if size >= segment:
                    yield flush()
                    held, docs, lengths, size, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    return rows


def write(
    docs: DataFrame, path: str, order: Sequence[str] = ("doc_id",), id: str = "doc_id", end: int = END, segment: int = SEGMENT
) -> DataFrame:
    """Write token files in the order of columns; returns the manifest, (path, start, docs, tokens, bytes).

    ``path`` is the tokenizer's file. ``start`` is the number of ids in all earlier files.
    """
    spark = docs.sparkSession
    folder = store.make_folder(shared_dir(spark) + "-tokens")
    keys = [f"key{i}" for i in range(len(order))]
    rows = docs.select(
        *[F.col(c).alias(k) for c, k in zip(order, keys)], F.col(id).alias("id"), text_of().alias("text")
    )
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "id", "text").select("id", "text")
    written = spread.mapInArrow(
        _writer(folder, lambda: Tokens(path), end, segment),
        "part int, number int, path string, docs long, tokens long, bytes long",
    )
    manifest = stage(written)
    # Parts are in order, so their totals come first, and there are few of them.
    totals = manifest.groupBy("part").agg(F.sum("tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shift"))
    inner = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("shift") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))
    return manifest.join(shifts, "part").select("path", start.alias("start"), "docs", "tokens", "bytes")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            segment = Segment(store.read(path))
            data = segment.ids().astype("<u4").tobytes()
            stops = np.cumsum(segment.lengths)
            starts = stops - segment.lengths
            checks = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(segment.docs, pa.int64()), pa.array(starts + start, pa.int64()),
                    pa.array(segment.lengths, pa.int64()), pa.array(checks, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), decoded from the files of a manifest, one task or more each."""
    files = dealt(manifest.select("path", "start"), "path")
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
