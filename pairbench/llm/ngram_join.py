"""Jaccard join on word shingles with a token-group matrix, down to connected components.

Texts are sets of hashed word shingles. Equal sets are one class, and only class
representatives go on. Then, for a threshold t:

1. *Signatures.* Sets of similar size share a band. A pair that reaches t differs
   in at most D shingles (D by band), so of m > D parts, into which shingles fall
   by hash, at least m - D are equal in both. Each set has a signature per part;
   every linked pair shares one, and as many more as its own size demands. A part
   holds about 1 / (1 - t) shingles, so common lines or words alone make few shared
   signatures; sets that share too few for a link in their band are left out.
2. *Groups.* Of each shared signature, the set that shares most is the leader. A
   set is compared with its leaders, exactly, and joins the group of the leader
   that it shares most signatures with. Groups are cut into bounded pieces: those
   of one component are a unit, however many, and the small components of a group
   are dealt out to units of one piece.
3. *Token-group matrix.* Each piece stores the union of its members' shingles.
   Where units are of one group, or share as many signatures as a link demands, and hold
   several components, the members of one are queries to the other: a query's overlap with the union bounds its
   overlap with every member. Only pieces whose bound reaches what t demands are opened, and their
   members are compared exactly.

Step 3 leaves out nothing but pairs that are already in one component. Rows
stay linear in the input but for (query, piece) pairs; no pair of texts within
a group is ever a row unless it is a link that joins components.

Edge cases: null and empty texts have the empty set and link with nothing; a text
with fewer words than a shingle is one shingle; repeated texts are one class and
in one component; rows with a null id get a null component and link nothing;
repeated ids stay repeated rows, with the smallest id of their links. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.common import Words, chain, mix, powers, slices, stage, text_of
from pairbench.llm.graph import components
from pairbench.session import shared_dir
from pairbench.sources import files

#: Members of a piece of a group, about.
PIECE = 64
#: Queries of a piece under one salt, about.
QUERIES = 256
#: Ids up to this number are broadcast to pick their texts; beyond it, texts shuffle by id.
BROADCAST_IDS = 1_000_000
#: Rounds of dropping sets that share too few signatures.
ROUNDS = 2
_BAND_RATIO = 1.5
_BANDS = 64


class Bands:
    """Size bands of a threshold percent / 100: bounds, greatest difference of a pair, number of parts."""

    def __init__(self, percent: int):
        if not 67 <= percent <= 100:
            raise ValueError("the threshold must be between 67 and 100 percent")
        lows = [1]
        while len(lows) < _BANDS:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * _BAND_RATIO)))
        self.low = np.array(lows, np.int64)
        top = self.low[1:] - 1
        # A pair has its smaller set in the band and the larger up to 100 / percent times as large.
        both = top + top * 100 // percent
        self.top = np.append(top, np.iinfo(np.int64).max // 200)
        differ = both * (100 - percent) // (100 + percent)
        self.differ = np.append(differ, differ[-1])
        parts = self.differ + 1
        empty = parts * np.exp(-self.low / parts)
        self.parts = parts + np.ceil(2 * empty).astype(np.int64) + 1
        self.percent = percent

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def reached(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether sets can link with smaller ones of a band below their own."""
        return (sizes * self.percent + 99) // 100 <= self.top[band]


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the offsets of the texts."""
    found = Words(texts, "space")
    counts = found.counts()
    value, text = chain(found.hash, found.text, tuple(range(1, words)))
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        begin = np.cumsum(counts) - counts
        rest = []
        for t in short:  # a few words each
            h = found.hash[begin[t] : begin[t] + counts[t]]
            rest.append(np.bitwise_xor.reduce(mix(h * powers(len(h) + 1)[1:])) + np.uint64(len(h)))
        value = np.concatenate([value, mix(np.array(rest, np.uint64))])
        text = np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(value: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets, the set each is of, and how many a set shares with any that it links with.

    The last has a column for the set's own band and for each of the two below it. The band is in a
    signature's leading bits.
    """
    sizes = np.diff(offsets)
    own = bands.of(np.maximum(sizes, 1))
    found = []
    needs = np.ones((len(sizes), 3), np.int32)
    for below in (0, 1, 2):
        band = own - below
        which = np.flatnonzero((sizes > 0) & (band >= 0))
        which = which[bands.differ[band[which]] > 0]
        if below:
            which = which[bands.reached(sizes[which], band[which])]
        if len(which):
            signs, owner, needs[which, below] = _signatures(value, offsets, which, band[which], bands)
            found.append((signs, owner))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), needs
    return np.concatenate([s for s, _ in found]), np.concatenate([w for _, w in found]), needs


def _signatures(value, offsets, which, band, bands):
    sizes = (offsets[1:] - offsets[:-1])[which]
    parts = bands.parts[band]
    base = np.cumsum(parts) - parts
    rows = np.repeat(offsets[:-1][which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    hashes = value[rows]
    part = ((mix(hashes) >> np.uint64(33)).astype(np.int64)) % np.repeat(parts, sizes)
    slot = np.repeat(base, sizes) + part
    order = np.argsort(slot, kind="stable")
    slot, scrambled = slot[order], mix(hashes + np.uint64(0x51_7C_C1_B7))[order]
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    total = parts.sum()
    sums, filled = np.zeros(total, np.uint64), np.zeros(total, bool)
    sums[slot[first]] = np.add.reduceat(scrambled, first)
    filled[slot[first]] = True
    number = np.arange(total) - np.repeat(base, parts)
    tag = (np.repeat(band, parts) << 40 | number).astype(np.uint64)
    # Empty parts count only where so many are empty that no other part need be equal.
    empty = parts - np.add.reduceat(filled.astype(np.int64), base)
    keep = filled | np.repeat(empty >= parts - bands.differ[band], parts)
    signs = mix(sums * powers(2)[1] + mix(tag)) >> np.uint64(6) | np.repeat(band, parts).astype(np.uint64) << np.uint64(58)
    # Parts that a partner of the greatest size leaves equal, but for those that are empty.
    differ = (sizes + sizes * 100 // bands.percent) * (100 - bands.percent) // (100 + bands.percent)
    need = parts - np.minimum(differ, bands.differ[band]) - empty
    return signs[keep], np.repeat(which, parts)[keep], np.maximum(need, 1)


def _sets(words: int, bands: Bands):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                value, offsets = shingles(batch.column("text"), words)
                sizes = np.diff(offsets)
                sums = []
                for salt in (1, 2):  # an order-free hash of the set, 128 bits
                    total = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(mix(value + np.uint64(salt << 50)), out=total[1:])
                    sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
                signs, owner, needs = signatures(value, offsets, bands)
                order = np.argsort(owner, kind="stable")
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner[order], np.arange(batch.num_rows + 1)), pa.int32()),
                    pa.array(signs[order].view(np.int64)),
                )
                needed = pa.ListArray.from_arrays(
                    pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 3), pa.array(needs.ravel())
                )
                band = pa.array(bands.of(np.maximum(sizes, 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists, band, needed],
                    ["id", "n", "x", "y", "signatures", "band", "needs"],
                )

    return rows


def _set_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                value, offsets = shingles(batch.column("text"), words)
                sets = pa.array([value[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), sets], ["id", "shingles"])

    return rows


def _linked(common, a: int, b: int, percent: int):
    return common * 100 >= percent * (a + b - common)


class _Matrix:
    """Token-group matrix of a piece: its union of shingles, and who holds each."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.component = [c for c, _ in members]
        self.size = np.array([len(m) for _, m in members])
        every = np.concatenate([m for _, m in members])
        holder = np.repeat(np.arange(len(members)), self.size)
        order = np.argsort(every, kind="stable")
        self.union, first = np.unique(every[order], return_index=True)
        self.holder, self.first = holder[order], np.append(first, len(every))

    def open(self, component: int, query: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """One link for each other component that the query links with; none if the bound is too low."""
        at = np.searchsorted(self.union, query)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == query]
        # A linked member shares at least this much with the query.
        if len(at) * (100 + percent) < percent * (len(query) + self.size.min()):
            return []
        length = self.first[at + 1] - self.first[at]
        rows = np.repeat(self.first[at] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common = np.bincount(self.holder[rows], minlength=len(self.size))
        linked = np.flatnonzero(_linked(common, len(query), self.size, percent))
        return [(component, c) for c in {self.component[i] for i in linked} if c != component]


def _scan(percent: int):
    """Pieces and their queries, sorted so that a piece's members come before its queries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, members, matrix = None, [], None
        for batch in batches:
            links = []
            for key, query, component, held in zip(
                zip(*(batch.column(c).to_pylist() for c in ("leader", "cut", "salt"))),
                batch.column("query").to_pylist(),
                batch.column("component").to_pylist(),
                batch.column("shingles"),
            ):
                if key != piece:
                    piece, members, matrix = key, [], None
                value = np.frombuffer(held.as_buffer(), np.uint64)
                if not query:
                    members.append((component, value.copy()))
                elif members:
                    matrix = matrix or _Matrix(members)
                    links += matrix.open(component, value, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"]
            )

    return rows


def _meet(members: DataFrame, queries: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from queries to members of the same piece (leader, cut).

    Both have (leader, cut, rep, component). A piece with many queries is dealt
    out under several salts, and its members go to each of them. Sets move once:
    places of known and small number are broadcast to them.
    """
    sets = held.select(F.col("id").alias("rep"), "shingles")
    busy = queries.groupBy("leader", "cut").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("salts"))
    busy = stage(busy)
    asked = (
        queries.join(busy, ["leader", "cut"])
        .withColumn("salt", F.pmod(F.xxhash64("rep"), "salts")).withColumn("query", F.lit(True))
    )
    known = (
        members.join(busy, ["leader", "cut"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("query", F.lit(False))
    )
    columns = ["leader", "cut", "salt", "query", "component", "rep"]
    places = stage(asked.select(*columns).unionAll(known.select(*columns)))
    both = sets.join(_few(places), "rep").drop("rep")
    key = ["leader", "cut", "salt"]
    return (
        both.repartition(*key).sortWithinPartitions(*key, "query")
        .mapInArrow(_scan(percent), "a long, b long").distinct()
    )


def _few(rows: DataFrame) -> DataFrame:
    """A stage table of narrow rows, broadcast where it has ``BROADCAST_IDS`` rows at most."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def similar_components(
    docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (id, n_shingles, component_id): one for each row of ``docs``."""
    bands = Bands(percent)
    source = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    key = ["n", "x", "y"]
    # Signatures are most of this table; it goes as soon as those that are shared are known.
    wide = shared_dir(docs.sparkSession)
    schema = "id long, n long, x long, y long, signatures array<long>, band int, needs array<int>"
    signed = files.stage(source.mapInArrow(_sets(words, bands), schema), wide)
    sets = stage(signed.select("id", *key))
    known = "n > 0 AND id IS NOT NULL"
    classes = stage(sets.filter(known).groupBy(*key).agg(F.min("id").alias("rep")))
    with files.stages() as made:
        entries = _entries(signed.filter(known), classes)
        files.remove(docs.sparkSession, wide)
        links = stage(_links(source, entries, words, percent))
        made.keep()
    found = components(links).withColumnsRenamed({"node": "rep"})
    chosen = classes.join(found, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    result = sets.select("id", *key).join(chosen, key, "left")
    none = F.when(F.col("n") == 0, F.col("id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", none))
    return result.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _entries(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (sign, band, rep, need): signatures that several classes share, with those classes.

    A set that shares fewer signatures of a band than a link needs links with none there, so such
    entries go; what that leaves alone goes in a second round.
    """
    chosen = classes.select(F.col("rep").alias("id"), "n", "x", "y")
    signs = signed.join(_few(chosen), ["id", "n", "x", "y"]).select(
        F.col("id").alias("rep"), F.col("band").alias("own"), "needs", F.explode("signatures").alias("sign")
    )
    shared = signs.groupBy("sign").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    shared = stage(shared.filter("low <> high").select("sign"))
    band = F.shiftrightunsigned("sign", 58).cast("int")
    entries = signs.join(shared, "sign").select("sign", band.alias("band"), "rep", F.get("needs", F.col("own") - band).alias("need"))
    # Rows of several sets may share an id; the least need of them holds for it.
    entries = stage(entries.groupBy("sign", "band", "rep").agg(F.min("need").alias("need")))
    for _ in range(ROUNDS):
        enough = entries.groupBy("rep", "band").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
        able = entries.join(enough.filter("n >= need").select("rep", "band"), ["rep", "band"], "left_semi")
        several = able.groupBy("sign").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
        entries = stage(able.join(several.filter("low <> high").select("sign"), "sign", "left_semi"))
    return entries


def _links(source: DataFrame, entries: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between class representatives that suffice for the components."""
    # Who shares most leads.
    size = entries.groupBy("sign").agg(F.count(F.lit(1)).alias("size"))
    weight = entries.join(size, "sign").groupBy("rep").agg(F.sum("size").alias("weight"))
    placed = entries.join(weight, "rep")
    led = placed.groupBy("sign").agg((-F.max(F.struct("weight", (-F.col("rep")).alias("rep")))["rep"]).alias("leader"))
    pairs = entries.join(led, "sign").groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("signs"))
    best = pairs.groupBy("rep").agg((-F.max(F.struct("signs", (-F.col("leader")).alias("rep")))["rep"]).alias("leader"))
    groups = stage(best.select("rep", "leader"))

    chosen = source.join(_few(groups.select(F.col("rep").alias("id"))), "id", "left_semi")
    held = stage(chosen.mapInArrow(_set_rows(words), "id long, shingles binary"))

    # Each set against its leader.
    followers = groups.filter("rep <> leader").select("leader", F.lit(0).alias("cut"), "rep", F.col("rep").alias("component"))
    leaders = followers.select("leader", "cut", F.col("leader").alias("rep"), F.col("leader").alias("component")).distinct()
    first = stage(_meet(leaders, followers, held, percent))

    # Sets against pieces that hold members of other components.
    merged = components(first).withColumnRenamed("node", "rep")
    everyone = groups.join(merged, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    at = entries.join(stage(_cut(everyone)), "rep")
    several = at.groupBy("sign").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    at = stage(at.join(several.filter("low <> high").select("sign"), "sign"))
    members = stage(at.select("leader", "cut", "rep", "component").distinct())
    unit = F.struct("leader", "cut.own", "cut.unit")
    spans = members.groupBy("leader", "cut").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    spans = spans.withColumn("target", unit).withColumnsRenamed({"leader": "to_leader", "cut": "to_cut"})
    queries = stage(
        members.select(unit.alias("piece"), "rep", "component").join(_meetings(at).join(spans, "target"), "piece")
        .filter("low <> component OR high <> component")
        .select(F.col("to_leader").alias("leader"), F.col("to_cut").alias("cut"), "rep", "component")
    )
    return first.unionAll(_meet(members, queries, held, percent))


def _cut(everyone: DataFrame) -> DataFrame:
    """``everyone`` (rep, leader, component) with ``cut``, the piece of the group that a set is in.

    A component with ``PIECE`` sets in a group is a unit of its own, cut by a hash; smaller ones are dealt
    out whole to units of one piece. So what a large component meets does not grow with its pieces.
    """
    sizes = everyone.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("n"))
    rest = sizes.filter(F.col("n") < PIECE).groupBy("leader").agg(F.sum("n").alias("rest"))
    own = F.col("n") >= PIECE
    dealt = F.pmod(F.xxhash64("component"), F.ceil(F.col("rest") / PIECE))
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / PIECE))
    cut = F.struct(
        own.alias("own"), F.when(own, F.col("component")).otherwise(dealt).alias("unit"),
        F.when(own, part).otherwise(0).alias("part"),
    )
    placed = everyone.join(sizes, ["leader", "component"]).join(rest, "leader", "left")
    return placed.select("rep", "leader", "component", cut.alias("cut"))


def _meetings(at: DataFrame) -> DataFrame:
    """Pairs (piece, target) of units whose sets may link across components, each pair once.

    Units of a group have its signatures in common, so all of them meet. Those of different groups meet if
    they share as many signatures as a link of any of their sets needs.
    """
    held_by = at.groupBy("sign", "band", F.struct("leader", "cut.own", "cut.unit").alias("piece")).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("need").alias("need")
    )
    least = held_by.groupBy("piece", "band").agg(F.min("need").alias("least"))
    held_by = stage(held_by.drop("need").join(least, ["piece", "band"]))

    def targets(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({"piece": "target", "low": "target_low", "high": "target_high", "least": "target_least"})

    apart = "(low <> high OR low <> target_low OR low <> target_high)"
    units = stage(held_by.groupBy("piece").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("leader", F.col("piece.leader")))
    within = units.join(targets(units), "leader").filter(f"piece >= target AND {apart}").select("piece", "target")
    across = (
        held_by.join(targets(held_by).drop("band"), "sign")
        .filter(f"piece.leader > target.leader AND {apart}")
        .groupBy("piece", "target", "band").agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest("least", "target_least")).alias("need"))
        .filter("n >= need").select("piece", "target").distinct()
    )
    return within.unionAll(across)
