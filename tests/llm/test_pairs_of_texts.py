"""The n-gram join, substring deduplication and decontamination against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairbench.llm import decontaminate, ngram_join, suffix_dedup
from pairbench.llm.graph import components

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]


def near_copies(seed=1):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        text = words_of(rng, rng.choice([4, 12, 40, 150]))
        for copy in range(rng.choice([1, 3, 8, 40])):
            edited = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                edited[rng.randrange(len(edited))] = "x%d" % rng.randrange(9)
            rows.append(" ".join(edited))
    rows += [None, "", "  \n", "One", "one", "one two", "ONE  TWO", "a b c", "A\tb\nc", "É é"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (3, 80, 3)])
def test_similar_components(docs, k, percent, seed):
    rows = near_copies(seed)
    found = ngram_join.similar_components(docs(rows), words=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, k, percent)


def test_similar_components_with_small_pieces(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", 3)
    monkeypatch.setattr(ngram_join, "QUERIES", 2)
    rows = near_copies(4)
    found = ngram_join.similar_components(docs(rows), words=3, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 3, 80)


def test_pieces_of_one_component_meet_others_once(spark):
    # 2000 sets of one component and 100 that link with nothing, all with the same 30 signatures.
    everyone = spark.range(2100).selectExpr("id AS rep", "0L AS leader", "CASE WHEN id < 2000 THEN 0 ELSE id END AS component")
    placed = ngram_join._cut(everyone)
    at = placed.crossJoin(spark.range(30).selectExpr("id AS sign", "3 AS band", "5 AS need"))
    met = ngram_join._meetings(at).collect()
    units = {u for r in met for u in (r.piece, r.target)}
    mixed = {u for u in units if not u.own}
    assert 1 <= len(mixed) <= 2 and len(units) == len(mixed) + 1
    # Every two units, and each mixed one with itself.
    assert len(met) == len(set(met)) == len(units) * (len(units) + 1) // 2 - 1
    parts = placed.groupBy("cut").agg(F.countDistinct("component").alias("components"), F.count("rep").alias("sets")).collect()
    assert all(r.components == 1 for r in parts if r.cut.own) and max(r.sets for r in parts) < 3 * ngram_join.PIECE


def test_components_around_a_large_one(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", 8)
    rng = random.Random(7)
    base = words_of(rng, 120)
    rows = []
    for n in range(160):
        text = list(base)
        for _ in range(rng.choice([1, 2, 5, 8, 12])):
            text[rng.randrange(len(text))] = "x%d" % rng.randrange(40)
        rows.append((n, " ".join(text)))
    found = ngram_join.similar_components(docs(rows), words=5, percent=80).collect()
    want = brute_components(rows, 5, 80)
    assert len({c for _, c in want.values()}) > 20 and {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_similar_components_edges(docs):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (9, None), (9, None)]
    found = ngram_join.similar_components(docs(rows), words=3, percent=90).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in found) == [
        (-1, 2, -1), (2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 0, 9), (9, 0, 9)
    ]
    assert ngram_join.similar_components(docs([])).count() == 0


def test_a_linked_pair_shares_a_signature():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        bands = ngram_join.Bands(percent)
        for round in range(400):
            n = int(rng.integers(2, 300 if round % 4 else 3000))
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // 8 + 1))
            other = np.unique(np.append(base[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)))
            common = len(np.intersect1d(base, other))
            value, offsets = np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)])
            signs, owner, needs = ngram_join.signatures(value, offsets, bands)
            if 100 * common >= percent * (len(base) + len(other) - common) and len(base) + len(other) != 2 * common:
                shared = np.array(sorted(set(signs[owner == 0]) & set(signs[owner == 1])), np.uint64)
                own = bands.of(np.diff(offsets))
                # In the band of the smaller set they share what either of them needs.
                below = own - own.min()
                assert max(1, *needs[[0, 1], below]) <= (shared >> np.uint64(58) == own.min()).sum()


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_dedup(rows, span):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for i in range(len(d) - span + 1):
            seen[d[i : i + span]] = seen.get(d[i : i + span], 0) + 1
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - span + 1):
            if seen[d[k : k + span]] > 1:
                gone[k : k + span] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeating(seed):
    rng = random.Random(seed)
    line = "".join(rng.choice("abé ") for _ in range(400))
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice("abc \n") for _ in range(rng.randrange(80))) for _ in range(4)]
        if i % 2:
            a = rng.randrange(300)
            parts.insert(rng.randrange(4), line[a : a + rng.randrange(100)])
        if i % 5 == 0:
            parts.append("ab" * rng.randrange(60))
        rows.append((i, "".join(parts)))
    return [*rows, (60, None), (61, ""), (62, "x" * 300), (63, rows[3][1]), (63, rows[3][1]), (None, rows[4][1]), (None, "q" * 9)]


@pytest.mark.parametrize("members", [4096, 2])
def test_substring_dedup(docs, members):
    rows = repeating(5)
    found = suffix_dedup.deduplicated(docs(rows), span=20, gram=8, members=members).collect()
    assert sorted(map(tuple, found), key=str) == brute_dedup(rows, 20)


def test_substring_dedup_of_nothing(docs):
    assert suffix_dedup.deduplicated(docs([])).count() == 0


def test_two_stage_sorting():
    rng = random.Random(2)
    for size in (1, 2, 30, 500):
        for letters in ([97], [0, 97], [97, 98, 99], range(256)):
            text = np.array([rng.choice(list(letters)) for _ in range(size)], np.uint8)
            order = suffix_dedup.suffix_array(text, 40)
            keys = [(text[i:].tobytes() + bytes(40))[:40] for i in order]
            assert keys == sorted(keys) and sorted(order.tolist()) == list(range(size))
    text = np.frombuffer(b"banana banana", np.uint8)
    assert suffix_dedup.common_prefix(text, np.array([1, 0]), np.array([3, 7]), 6).tolist() == [3, 6]


def distance(item: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j - 1] + (a != b), above[j] + 1, row[-1] + 1))
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20)))
        assert decontaminate.best_match(item, text)[0] == distance(item, text)


def planted(spark, rate, seed=3):
    folder = "/root/testdata/sf0.01"
    rng = random.Random(seed)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    plain = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(120).collect()]
    plain = [t for t in plain if not any(re.sub(r"\s+", " ", i).lower() in re.sub(r"\s+", " ", t).lower() for _, i in items)]
    rows = [(i, t[:1500]) for i, t in enumerate(plain[:30])]
    for n, (_, text) in enumerate(items):
        letters = list(text)
        for _ in range(int(rate * len(letters))):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], ["q"], [letters[at], "z"]])
        rows.append((1000 + n, plain[n % 30][:300].upper() + "\n" + "".join(letters) + " tail " + plain[(n + 1) % 30][:100]))
    return items, rows


@pytest.mark.parametrize("rate, recall", [(0.0, 1.0), (0.03, 0.97), (0.08, 0.9)])
def test_planted_items_are_found(spark, docs, rate, recall):
    items, rows = planted(spark, rate)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs(rows), bench).collect()
    pairs = {(r.doc_id, r.item_id): r for r in found}
    want = {(1000 + n, item) for n, (item, _) in enumerate(items)}
    assert len(want & set(pairs)) >= recall * len(want)
    texts = dict(rows)
    # No pair is reported whose whole item is not within the allowed edits.
    normal = lambda t: re.sub(r"[ \t-\r]+", " ", t.translate(_LOWER)).strip().encode()
    for (doc, item), r in list(pairs.items())[:12]:
        pattern = normal(dict(items)[item])
        assert r.edits == distance(pattern, normal(texts[doc][max(0, r.start - 200) : r.finish + 200]))
        assert r.edits <= len(pattern) // 5
        assert abs(len(normal(texts[doc][r.start : r.finish])) - len(pattern)) <= r.edits
    assert not [d for d, _ in pairs if d < 1000]


def found_pairs(spark, docs, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.contaminated(docs(list(enumerate(texts))), bench).collect()
    return {(r.doc_id, r.item_id): r.edits for r in found}


def prose(rng, size):
    return " ".join("".join(rng.choice("etaoinshrdlu  ") for _ in range(size)).split())


def test_short_items_inside_a_text_are_found(spark, docs):
    rng = random.Random(11)
    for size in (3, 7, 12, 20, 30, 35, 40, 50):
        items = [(prose(rng, 2 * size).replace(" ", "") + "x" * size)[:size] for _ in range(30)]
        texts = [f"{prose(rng, 150)} {item} {prose(rng, 400)}" for item in items]
        found = found_pairs(spark, docs, items, texts)
        assert all(found.get((n, n)) == 0 for n in range(30))


@pytest.mark.parametrize("size", [25, 60, 150])
def test_every_item_within_the_allowed_edits_is_found(spark, docs, size):
    rng = random.Random(size)
    items = [prose(rng, size) for _ in range(40)]
    texts = []
    for item in items:
        letters = list(item)
        for _ in range(len(item) // 5):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], ["q"], [letters[at], "z"]])
        texts.append(f"{prose(rng, 80)} {''.join(letters)} {prose(rng, 80)}")
    found = found_pairs(spark, docs, items, texts)
    least = [distance(item.encode(), " ".join(text.split()).encode()) for item, text in zip(items, texts)]
    want = {n: edits for n, edits in enumerate(least) if edits <= len(items[n]) // 5}
    assert len(want) > 20 and {n: found[n, n] for n in range(len(items)) if (n, n) in found} == want


@pytest.mark.parametrize("size", [64, 81, 150, 400])
@pytest.mark.parametrize("share", [0, 10, 15, 20])
def test_walks_reach_their_recall(size, share):
    """All pairs of items and texts against exact distances; walks alone find long items."""
    rng = random.Random(100 * size + share)
    items = [prose(rng, 3 * size)[: size - 1] + "x" for _ in range(30)]
    texts = []
    for a, b in zip(items, items[1:] + items[:1]):
        edited = []
        for item in (a, b):
            letters = list(item)
            for _ in range(size * share // 100):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice([[], ["q"], [letters[at], "z"]])
            edited.append("".join(letters))
        texts.append(f"{prose(rng, 30)} {edited[0]} {prose(rng, 200)} {edited[1]}")
    block = decontaminate.index(list(range(30)), items)
    assert not block.looks and len(block.tables) == decontaminate.WALKS * decontaminate.TABLES
    found = decontaminate._matches(pa.array(texts), block, [decontaminate._filter_bits(t.keys) for t in block.tables], 20)
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(block.texts):
            edits, _ = decontaminate.best_match(item, " ".join(text.split()).encode())
            if edits <= len(item) // 5:
                want[d, i] = edits
    assert len(want) >= 50 and set(found) <= set(want)
    assert len(found) >= 0.95 * len(want)
    assert {pair: best[0] for pair, best in found.items()} == {pair: want[pair] for pair in found}


def test_walks_of_plain_texts(spark, docs):
    """Repeated bytes, an item at either end of a text, equal items, and items longer than texts."""
    item = "ab" * 50
    long = prose(random.Random(2), 500)
    items = [item, "x" * 90, long, long]
    texts = [item, "x" * 400, long, "y " + long, long + " y", long[:100], "", "x" * 80]
    assert found_pairs(spark, docs, items, texts) == {
        (0, 0): 0, (1, 1): 0, (7, 1): 10, **{(d, i): 0 for d in (2, 3, 4) for i in (2, 3)}
    }


def test_items_within_running_text_are_found(spark, docs):
    item = "\u6625\u7720\u4e0d\u89ba\u6653\u8655\u8655\u805e\u557c\u9ce5\u591c\u4f86\u98a8\u96e8\u8072\u82b1\u843d\u77e5\u591a\u5c11"
    quoted = "quotation marks may touch either side of this sentence"
    bench = spark.createDataFrame([(1, item), (2, quoted)], "item_id long, text string")
    edited = item[:4] + "\u4e00" + item[5:14] + item[15:]
    rows = [(1, f"\u8a69\u66f0{item}\u4e91\u4e91"), (2, f"\u8a69\u66f0{edited}\u4e91\u4e91"), (3, f"He said:\u00ab{quoted}\u00bb."), (4, "\u8a69\u66f0")]
    found = decontaminate.contaminated(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (3, 2)}
    exact = next(r for r in found if r.doc_id == 1)
    assert (exact.edits, exact.start, exact.finish) == (0, 2, 2 + len(item))


def test_contaminated_edges(spark, docs):
    item = "what is the capital city of the country where these words were written"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    rows = [(5, item + " and " + item), (5, item), (None, item), (6, None), (7, "")]
    found = decontaminate.contaminated(docs(rows), bench).collect()
    assert [tuple(r) for r in found] == [(5, 1, 0, 0, len(item))]
    assert decontaminate.contaminated(docs([]), bench).count() == 0
    assert decontaminate.contaminated(docs(rows), bench.limit(0)).count() == 0


def test_normalised_texts():
    texts = pa.array([" Ab  c\n", "", "é\tD", "x"])
    normal = decontaminate.Normal(texts)
    assert [normal.text(i).decode() for i in range(4)] == ["ab c", "", "é d", "x"]


def stepped(data, start, picked):
    """The walks one step at a time: keys in each table and last places, from the same random numbers."""
    rng = np.random.default_rng(5)
    steps, keys, last = decontaminate.STEPS, np.zeros((decontaminate.TABLES, len(start)), np.uint32), start.copy()
    for number in range(decontaminate.WALKS):
        values = rng.integers(0, 1 << 64, (steps, 256), np.uint64).astype(np.uint32)
        moves = rng.integers(0, 2, (steps // 2, 256)).astype(np.intp)
        sampled = [rng.choice(steps, decontaminate.SAMPLES, replace=False).tolist() for _ in range(decontaminate.TABLES)]
        own = np.flatnonzero(picked == number)
        place, sums = start[own], [np.zeros(len(own), np.uint32) for _ in sampled]
        for step in range(steps):
            symbol = data.take(place)
            value = values[step].take(symbol)
            for table in range(decontaminate.TABLES):
                if step in sampled[table]:
                    sums[table] += value
            move = moves[step // 2].take(symbol)
            place += 1 - move if step % 2 else move
        keys[:, own], last[own] = sums, place
    return keys, last


def in_pairs(data, start, picked):
    walks, _ = decontaminate._walks()
    pairs, keys, last = decontaminate._pairs(data), np.zeros((decontaminate.TABLES, len(start)), np.uint32), start.copy()
    for number, walk in enumerate(walks):
        own = np.flatnonzero(picked == number)
        keys[:, own], last[own] = walk.keys(pairs, start[own])
    return keys, last


def test_walks_by_pairs_of_bytes():
    """Two steps at a time are the same walks, in well under the CPU time of single steps."""
    rng = np.random.default_rng(7)
    text = rng.choice(np.frombuffer(b"etaoinshrdlu  ", np.uint8), 200_000)
    data = np.concatenate([text, rng.integers(0, 256, 50_000, np.uint8), np.zeros(decontaminate.STEPS + 2, np.uint8)])
    start = np.arange(250_000)
    _, numbers = decontaminate._walks()
    picked = numbers[decontaminate._pairs(data)[start]]
    assert set(picked.tolist()) == set(range(decontaminate.WALKS))
    took = {}
    for walk in (stepped, in_pairs):
        wide = data.astype(np.intp)
        times = []
        for _ in range(5):
            began = time.process_time()
            found = walk(wide, start, picked)
            times.append(time.process_time() - began)
        took[walk] = min(times), found
    (plain, (keys, last)), (quick, (keys2, last2)) = took[stepped], took[in_pairs]
    assert (keys == keys2).all() and (last == last2).all()
    assert quick < 0.7 * plain


def test_normalised_texts_of_any_bytes(spark, docs):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB\u00c9\u4e00 \t\n\x0b\x0c\r\x00\x1c\x85\u2003") for _ in range(rng.randrange(12))) for _ in range(300)]
    normal = decontaminate.Normal(pa.array(["cut off", *texts]).slice(1))
    for number, text in enumerate(texts):
        assert normal.text(number) == b" ".join(re.findall(rb"[^ \t-\r]+", text.translate(_LOWER).encode()))
    # Spans are those of the original text, whatever was left out before them.
    item = "what is the capital city of the country where these words were written"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    before = "\u00c9 \u4e00\n\n\t  x"
    rows = [(1, f"{before}  {item.replace(' ', ' \r\n').upper()} \u00c9"), (2, f"{before} {item}")]
    found = {r.doc_id: r for r in decontaminate.contaminated(docs(rows), bench).collect()}
    assert {i: dict(rows)[i][r.start : r.finish] for i, r in found.items()} == {1: item.replace(" ", " \r\n").upper(), 2: item}
