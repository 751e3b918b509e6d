"""Benchmark decontamination: random walks and sampled steps find candidates, exact edit verification decides.

Texts are normalised (ASCII letters in lower case, white space runs as one
space). From every place of a text or an item a CGK walk starts: at each of ``STEPS``
steps it notes the byte it stands on, and a random bit of (step, byte) says whether
it goes on to the next byte. Two places that begin alike are walked alike, and after
an edit walks fall into step again by chance, so few edits become few steps that
differ. LSH keys are sums over ``SAMPLES`` sampled steps, in ``TABLES`` tables; the two
bytes at a place pick one of ``WALKS`` walks. A walk covers about ten bytes, since its
differing steps grow with the square of the edits it meets; an item of n bytes is
covered by n such walks, each a chance for every copy, and the window around a shared
key that is then opened has the item's size. The number of repetitions is set by the
recall measured at the limit of ``EDITS``, for items of ``WALKED`` bytes on.

Shorter items have too few walks for that and are found by pieces without loss: an
item with k allowed edits is cut into k // 2 + 1 pieces of about equal size. Wherever a text holds the item within k edits, one piece has
at most one edit there (were there two in each, they would be more than k). A
piece of ``width`` + 1 bytes with at most one edit shares ``width`` of them with
the text: in a run, or with one byte of the text skipped, so ``width`` looks at
each place of a text find all of them. The same count holds for groups of pieces:
of all groups that are within twice their pieces less one edits, some hold a piece
with at most one, so a candidate, of either kind, goes on only while the groups of
``GROUPS`` pieces around it are that close. The exact edit distance of the whole item
to the best substring of the places that are left decides; it takes time in
proportion to both lengths.

The documents are read once, without a shuffle. Items go to all tasks in blocks
of bounded size (``BLOCK_BYTES`` of text); a larger benchmark means more passes,
not a larger broadcast.

Edge cases: null and empty texts match nothing, empty items are matched by
nothing; rows with null ids are left out of matches; an item that stands several
times in a document gives one row, its best place (least edits, then first);
repeated rows repeat no result row. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.common import _LOW_BYTES, Words, code_points, slices, text_bytes, text_of

#: Edits allowed, in percent of the item's bytes: similarity of 0.8 or more.
EDITS = 20
#: Items of at least this many bytes are found by walks, shorter ones by pieces.
WALKED = 64
#: Steps of a walk, sampled steps of a key, keys of a walk, and different walks.
STEPS, SAMPLES, TABLES, WALKS = 16, 12, 3, 4
#: Bytes of a piece that are looked up.
WIDTH = 8
#: Pieces in the groups that must be close around a candidate.
GROUPS = (2, 4)
#: Text of a block of items; its keys and filters take a few hundred bytes of a worker for each byte.
BLOCK_BYTES = 1 << 20
#: Places of a text, and candidates, that are worked on at once.
PLACES, STEP, CANDIDATES = 1 << 18, 1 << 15, 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Normal:
    """Normalised texts of an array, one after another, each ended by a zero byte; empty ones have none."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        raw, offsets = text_bytes(texts)
        # Of bytes, lower() takes ASCII letters only, and split() the white space of ``Words``.
        lower, places = raw.tobytes().lower(), offsets.tolist()
        plain = [b" ".join(lower[a:b].split()) for a, b in zip(places, places[1:])]
        parts = [text + b"\0" if text else text for text in plain]
        self.data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        self.bounds = np.cumsum([0, *map(len, parts)])

    def origin(self, number: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of an original text, and the place and size of each of its words."""
        words = Words(self.texts.slice(number, 1))
        return self.texts[number].as_py().encode(), words.start, words.end - words.start

    def text(self, number: int) -> bytes:
        return self.data[self.bounds[number] : max(self.bounds[number], self.bounds[number + 1] - 1)].tobytes()


@dataclass
class Look:
    """Item pieces by the ``width`` bytes that a text shares with them when its byte number ``skip`` is left out.

    Key number k belongs to ``pieces[first[k]:first[k + 1]]`` of the index.
    """

    width: int
    skip: int
    keys: np.ndarray
    first: np.ndarray


@dataclass
class Walk:
    """Random numbers of a walk for two steps at a time: what they add to its keys and, in the last column, to its place, by pair of bytes."""

    steps: list[np.ndarray]

    def keys(self, pairs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the walks from places on, by table, and the places where they end; ``pairs`` are the two bytes at each place."""
        state = np.zeros((len(start), TABLES + 1), np.uint32)
        state[:, TABLES] = start
        for step in self.steps:
            state += step.take(pairs.take(state[:, TABLES]), axis=0)
        return state[:, :TABLES].T, state[:, TABLES]


@functools.cache
def _walks() -> tuple[list[Walk], np.ndarray]:
    """All walks, and the number of the walk that a pair of bytes picks; each worker makes its own, as they have 32 MB."""
    rng = np.random.default_rng(5)
    walks = []
    for _ in range(WALKS):
        # Keys of 32 bits: one shared by chance costs a look at a candidate and no result.
        values = rng.integers(0, 1 << 64, (STEPS, 256), np.uint64).astype(np.uint32)
        # Opposite bits in pairs of steps: no walk rests on a byte for long.
        moves = rng.integers(0, 2, (STEPS // 2, 256)).astype(bool)
        tables = [set(rng.choice(STEPS, SAMPLES, replace=False).tolist()) for _ in range(TABLES)]
        steps = []
        for first, moved in zip(range(0, STEPS, 2), moves):
            step = np.zeros((256, 256, TABLES + 1), np.uint32)
            for number, table in enumerate(tables):
                if first in table:
                    step[:, :, number] += values[first][:, None]
                if first + 1 in table:
                    # A walk that went on stands on the second byte, one that did not still on the first.
                    step[:, :, number] += np.where(moved[:, None], values[first + 1], values[first + 1][:, None])
            step[:, :, TABLES] = 1 + (moved[:, None] & ~moved)
            steps.append(step.reshape(1 << 16, TABLES + 1))
        walks.append(Walk(steps))
    return walks, rng.integers(0, WALKS, 1 << 16).astype(np.int8)


def _pairs(data: np.ndarray) -> np.ndarray:
    """The two bytes from each place on, as a number; the last place is left out."""
    data = data.astype(np.intp)
    return data[:-1] << 8 | data[1:]


@dataclass
class Table:
    """Keys of the items' walks in one table; those of key number k are ``pieces[first[k]:first[k + 1]]`` of the index."""

    walk: int
    number: int
    keys: np.ndarray
    first: np.ndarray


@dataclass
class Index:
    """A block of items and their pieces: item, place in it, and the groups around (place in ``data``, size, edits)."""

    ids: list
    texts: list[bytes]
    data: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    groups: list[np.ndarray]
    looks: list[Look]
    tables: list[Table]
    #: Pieces of keys, and how far after the start of the piece the key's bytes begin.
    pieces: np.ndarray
    shift: np.ndarray
    #: Items of so many allowed edits that no piece of two bytes is left: tried on every text.
    loose: list[int]
    pad: int


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number; the last eight places are left out."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(len(data) - 8, 0),), "<u8", data, 0, (1,)).copy()


def _keys(words: np.ndarray, width: int, skip: int, at=None) -> np.ndarray:
    """``width`` bytes from each place on, without the byte number ``skip`` of ``width + 1``."""
    here, there = (words[:-1], words[1:]) if at is None else (words[at], words[at + 1])
    low, all_ = _LOW_BYTES[skip], _LOW_BYTES[width]
    return here & all_ if skip == width else (here & low) | (there & (low ^ all_))


def index(ids: list, texts: list[str], percent: int = EDITS) -> Index:
    normal = Normal(pa.array(texts, pa.string()))
    plain = [normal.text(i) for i in range(len(ids))]
    rows, loose = [], []
    for item, text in enumerate(plain):
        size, begin = len(text), int(normal.bounds[item])
        edits = size * percent // 100
        count = edits // 2 + 1
        width = min(size // count - (edits > 0), WIDTH)
        if not size:
            continue
        if width < 1:
            loose.append(item)
            continue
        cuts = [i * size // count for i in range(count + 1)]
        for i in range(count):
            row = [item, cuts[i], width, edits > 0]
            for group in GROUPS:
                a = i // group * group
                b = min(a + group, count)
                row += [begin + cuts[a], cuts[b] - cuts[a], min(2 * (b - a) - 1, edits)]
            rows.append(row)
    table = np.array(rows, np.int64).reshape(len(rows), 4 + 3 * len(GROUPS))
    item, offset, width, edited = table[:, :4].T
    begin = normal.bounds[item] + offset
    words = _words(np.concatenate([normal.data, np.zeros(WIDTH + 16, np.uint8)]))
    looks, pieces = [], [np.empty(0, np.int64)]
    known = 0
    short = np.diff(normal.bounds)[item] <= WALKED
    for size in np.unique(width[short]).tolist():
        own = np.flatnonzero((width == size) & short)
        some = own[edited[own] > 0]
        last = _keys(words, size, size, begin[own])
        for skip in range(1, size + 1):
            # In a run: without any one byte of the piece. With a byte skipped: it is another one, or one too many.
            parts = [(last, own)] if skip == size else [(_keys(words, size, size, begin[some]), some)]
            lost = range(size) if skip == size else [skip]
            parts += [(_keys(words, size, i, begin[some]), some) for i in lost]
            pairs = np.zeros(sum(len(k) for k, _ in parts), [("key", "<u8"), ("piece", "<i8")])
            pairs["key"] = np.concatenate([k for k, _ in parts])
            pairs["piece"] = np.concatenate([p for _, p in parts])
            pairs = np.unique(pairs)
            keys, first = np.unique(pairs["key"], return_index=True)
            if len(keys):
                looks.append(Look(size, skip, keys, np.append(first, len(pairs)) + known))
                pieces.append(pairs["piece"].copy())
                known += len(pairs)
    shift = [np.zeros(known, np.int64)]
    tables = _tables(normal, begin, np.flatnonzero(~short), pieces, shift)
    groups = [table[:, 4 + 3 * g : 7 + 3 * g].copy() for g in range(len(GROUPS))]
    pad = max([int(g[:, 1].max() + 2 * g[:, 2].max()) for g in groups if len(g)], default=0) + 2 * WIDTH + STEPS
    pieces, shift = (np.concatenate(c).astype(np.int32) for c in (pieces, shift))
    places = item.copy(), offset.copy()
    return Index(
        ids, plain, normal.data, begin, *places, groups, looks, tables, pieces, shift, loose, pad
    )


def _tables(normal: Normal, begin: np.ndarray, long: np.ndarray, pieces: list, shift: list) -> list[Table]:
    """Keys of the walks from all places of the items that have the pieces ``long``; adds their pieces and shifts."""
    if not len(long):
        return []
    ends = normal.bounds[1:] - 1
    owner = np.repeat(np.arange(len(ends)), np.diff(normal.bounds))
    place = np.arange(len(owner))
    # Pieces follow one another in an item, so that of a place is the last to begin before it.
    at = np.maximum(np.searchsorted(begin[long], place, side="right") - 1, 0)
    piece = long[at]
    inside = (np.diff(normal.bounds)[owner] > WALKED) & (place < ends[owner])
    walks, picked = _walks()
    pairs = _pairs(np.concatenate([normal.data, np.zeros(STEPS + 1, np.uint8)]))
    picks = picked[pairs[place]]
    found = []
    known = sum(map(len, pieces))
    for number, walk in enumerate(walks):
        start = np.flatnonzero(inside & (picks == number))
        keys, last = walk.keys(pairs, start)
        whole = last <= ends[owner[start]]
        for table, key in enumerate(keys):
            order = np.flatnonzero(whole)[np.argsort(key[whole], kind="stable")]
            values, first = np.unique(key[order], return_index=True)
            if len(values):
                found.append(Table(number, table, values, np.append(first, len(order)) + known))
                pieces.append(piece[start[order]])
                shift.append(start[order] - begin[piece[start[order]]])
                known += len(order)
    return found


def best_match(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the item to a substring of the text, and where the first such ends.

    Columns of the distance matrix are bit vectors (Myers), one step for each byte of the text.
    """
    if not item:
        return 0, 0
    full, high = (1 << len(item)) - 1, 1 << (len(item) - 1)
    match = defaultdict(int)
    for place, symbol in enumerate(item):
        match[symbol] |= 1 << place
    up, down, distance = full, 0, len(item)
    best, end = distance, 0
    for place, symbol in enumerate(text, 1):
        equal = match.get(symbol, 0)
        x = equal | down
        d = ((((equal & up) + up) ^ up) | equal) & full
        right = down | ~(d | up) & full
        left = up & d
        if right & high:
            distance += 1
        elif left & high:
            distance -= 1
        right = right << 1 & full
        up = (left << 1 & full) | ~(x | right) & full
        down = right & x
        if distance < best:
            best, end = distance, place
    return best, end


def _leading(keys: np.ndarray, bits: int) -> np.ndarray:
    """So many leading bits of keys; keys of walks are random numbers, those of looks are scrambled first."""
    if keys.dtype == np.uint32:
        return keys.astype(np.intp) >> (32 - bits)
    return ((keys * _ODD) >> np.uint64(64 - bits)).view(np.int64)


def _filter_bits(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A table of the leading bits of keys, and how many."""
    bits = min(max(16, int(len(keys)).bit_length() + 5), 25)
    table = np.zeros(1 << bits, bool)
    table[_leading(keys, bits)] = True
    return table, bits


def _find(block: Index, percent: int):
    """Rows (doc_id, item_id, edits, start, finish) for the items of a block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [_filter_bits(known.keys) for known in block.looks + block.tables]
        for whole in batches:
            for batch in slices(whole, "text"):
                found = _matches(batch.column("text"), block, filters, percent)
                ids = batch.column("id").to_pylist()
                names = ["doc_id", "item_id", "edits", "start", "finish"]
                values = [(ids[d], block.ids[i], *rest) for (d, i), rest in sorted(found.items())]
                values = [v for v in values if v[0] is not None]
                columns = list(zip(*values)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return rows


def _known(keys: np.ndarray, place: np.ndarray | None, at: int, known: Look | Table, bits: tuple) -> tuple:
    """Of keys at places (or at all in order), those that items have: place counted from ``at``, first, length."""
    seen, size = bits
    some = np.flatnonzero(seen.take(_leading(keys, size)))
    key = keys[some]
    slot = np.minimum(np.searchsorted(known.keys, key), len(known.keys) - 1)
    hit = known.keys[slot] == key
    some, slot = some[hit], slot[hit]
    return (some if place is None else place[some]) + at, known.first[slot], known.first[slot + 1] - known.first[slot]


def _candidates(data: np.ndarray, size: int, block: Index, filters: list) -> Iterator[tuple]:
    """Arrays (place in the texts, first, length): what an item holds that may stand there with few edits."""
    tables = defaultdict(list)
    for table, bits in zip(block.tables, filters[len(block.looks) :]):
        tables[table.walk].append((table, bits))
    walks, picked = _walks()
    for start in range(0, size, PLACES):
        found = []
        # One word more than places.
        words = _words(data[block.pad + start : block.pad + min(start + PLACES, size) + 9]) if block.looks else None
        for look, bits in zip(block.looks, filters):
            for at in range(0, len(words) - 1, STEP):
                keys = _keys(words[at : at + STEP + 1], look.width, look.skip)
                found.append(_known(keys, None, start + at, look, bits))
        if tables:
            count = min(PLACES, size - start)
            pairs = _pairs(data[block.pad + start : block.pad + start + count + STEPS + 1])
            picks = picked.take(pairs[:count])
            for number, own in tables.items():
                place = np.flatnonzero(picks == number)
                keys, _ = walks[number].keys(pairs, place)
                found += [_known(keys[table.number], place, start, table, bits) for table, bits in own]
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found))


def _close(data: np.ndarray, start: np.ndarray, items: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each group of pieces is within its edits of a stretch of the text that begins about ``start``."""
    begin, size, edits = group.T
    rows, band = int(size.max()), int(edits.max())
    wide = 2 * band + 1
    text = data[(start - band) + np.arange(rows + wide - 1)[:, None]]
    item = items[np.minimum(begin + np.arange(rows)[:, None], len(items) - 1)]
    # A byte that stands on none of the diagonals within reach is an edit.
    alone = np.zeros(len(start), np.int32)
    for row in range(rows):
        alone += ~(text[row : row + wide] == item[row]).any(axis=0) & (size > row)
    left = np.flatnonzero(alone <= edits)
    text, item, size = text[:, left], item[:, left], size[left]
    kind = np.int8 if rows + wide < 120 else np.int32
    cost, best = np.zeros((wide, len(left)), kind), np.zeros(len(left), kind)
    ends = set(np.unique(size).tolist())
    one = kind(1)
    for row in range(rows if len(left) else 0):
        # Along a diagonal a byte is kept or exchanged; next to it one is left out or put in.
        new = cost + (text[row : row + wide] != item[row]).view(np.int8)
        np.minimum(new[:-1], cost[1:] + one, out=new[:-1])
        for d in range(1, wide):
            np.minimum(new[d], new[d - 1] + one, out=new[d])
        cost = new
        if row + 1 in ends:
            here = size == row + 1
            best[here] = cost[:, here].min(axis=0)
    return left[best <= edits[left]]


def _places(data: np.ndarray, size: int, block: Index, filters: list) -> Iterator[tuple]:
    """Arrays (where a piece begins in the texts, a place inside it, piece) of candidates whose groups are close."""
    for place, first, length in _candidates(data, size, block, filters):
        total = np.cumsum(length)
        a = 0
        while a < len(place):
            before = total[a - 1] if a else 0
            b = max(int(np.searchsorted(total, before + CANDIDATES, side="right")), a + 1)
            many = length[a:b]
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            entry, spot = np.repeat(first[a:b], many) + inner, np.repeat(place[a:b], many)
            piece, at = block.pieces[entry].astype(np.int64), spot - block.shift[entry]
            a = b
            # Walks of one copy find each of its pieces many times.
            _, once = np.unique((at + block.pad) * len(block.item) + piece, return_index=True)
            at, spot, piece = at[once], spot[once], piece[once]
            for group in block.groups:
                if len(at):
                    own = group[piece]
                    near = _close(data, block.pad + at - (block.begin[piece] - own[:, 0]), block.data, own)
                    at, spot, piece = at[near], spot[near], piece[near]
            if len(at):
                yield at, spot, piece


def _matches(texts, block, filters, percent) -> dict:
    normal = Normal(texts)
    size = len(normal.data)
    data = np.zeros(size + 2 * block.pad + 16, np.uint8)
    data[block.pad : block.pad + size] = normal.data
    tries = {(text, item, 0, None) for item in block.loose for text in range(len(texts))}
    for at, spot, piece in _places(data, size, block, filters):
        text = np.searchsorted(normal.bounds, spot, side="right") - 1
        item = block.item[piece]
        tries.update(zip(text.tolist(), item.tolist(), (at - block.offset[piece]).tolist(), [True] * len(at)))
    spans = defaultdict(list)
    for text, item, start, placed in sorted(tries, key=lambda t: t[:3]):
        pattern = block.texts[item]
        # A piece's own edit may move it by one.
        allowed = len(pattern) * percent // 100 + 1
        if not 0 <= text < len(texts):
            continue
        first, end = int(normal.bounds[text]), int(normal.bounds[text + 1]) - 1
        low, high = (max(first, start - allowed), min(end, start + len(pattern) + allowed)) if placed else (first, end)
        known = spans[text, item]
        if known and low <= known[-1][1]:
            known[-1][1] = max(known[-1][1], high)
        else:
            known.append([low, high])
    found, origin = {}, functools.cache(normal.origin)
    for (text, item), known in spans.items():
        pattern = block.texts[item]
        for low, high in known:
            edits, stop = best_match(pattern, normal.data[low:high].tobytes())
            if edits <= len(pattern) * percent // 100:
                back, length = best_match(pattern[::-1], normal.data[low : low + stop][::-1].tobytes())
                begins, ends = low + stop - length, low + stop
                rank = (edits, *_span(origin(text), begins - normal.bounds[text], ends - normal.bounds[text]))
                found[text, item] = min(found.get((text, item), rank), rank)
    return found


def _span(origin: tuple[bytes, np.ndarray, np.ndarray], begins: int, ends: int) -> tuple[int, int]:
    """Code points of an original text for a span of the normalised one."""
    data, start, size = origin
    begin = np.cumsum(size + 1) - (size + 1)

    def place(at: int) -> int:
        word = np.searchsorted(begin, at, side="right") - 1
        return int(start[word] + min(at - begin[word], size[word]))

    return code_points(data, place(begins)), code_points(data, place(ends - 1) + 1)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = EDITS, id: str = "doc_id", item: str = "item_id"
) -> DataFrame:
    """Rows (doc_id, item_id, edits, start, finish): items found in documents, spans in code points."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item"), text_of().alias("text")).filter("item IS NOT NULL AND trim(text) <> ''")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)
    source = docs.select(F.col(id).alias("id"), text_of().alias("text"))
    schema = "doc_id long, item_id long, edits long, start long, finish long"
    found = spark.createDataFrame([], schema)
    for number in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).distinct().collect()
        if held:
            block = index([r["item"] for r in held], [r["text"] for r in held], percent)
            found = found.unionAll(source.mapInArrow(_find(block, percent), schema))
    best = F.min(F.struct("edits", "start", "finish")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
