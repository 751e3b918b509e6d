"""Ranked lexical search against brute force, and the bounds of the ball trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbench.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, terms(t)) for i, t in docs]
    N, L = sum(1 for _, t in counted if t), sum(len(t) for _, t in counted)
    df = Counter(x for _, t in counted for x in set(t))
    w = {x: math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for x, d in df.items()}
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, t in counted:
            if doc is None:
                continue
            tf, m = Counter(t), 10 + (90 * len(t) * N // L if L else 0)
            s = sum(w[x] * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in wanted if tf[x])
            if s > 0:
                scores.append((-s, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(n=400):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(120)] + ["Größe", "日本語", "naïve", "x1", "ABC"]
    docs = []
    for i in range(n):
        own = words if i % 3 else words[:20]
        docs.append((i, " ".join(pick.choice(own) for _ in range(pick.randrange(60))) + pick.choice(["", "!", "..."])))
    # A third of all rows are alike, so many scores are equal; nulls, empty and very long texts.
    docs += [(1000 + i, "W1 w2, w3-Größe") for i in range(n // 2)] + [(None, "w1 w2"), (7000, None), (7001, ""), (7002, "!?")]
    docs += [(7003, "w5 日本語 " * 20_000), (3, docs[3][1])]
    items = [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(1, 30)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere-at-all"), (None, "w1"), (23, "w1 w1 w2 größe"), (24, "w7"), (24, "w9")]
    return docs, items


def tables(spark, docs, docs_of, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    for name in ("doc_id", "term", "score", "n"):
        asked = asked.withColumn(name, F.lit("x"))
    table = docs_of(docs).repartition(3)
    for name in ("item_id", "terms", "counts", "n", "rank"):
        table = table.withColumn(name, F.lit("x"))
    return table, asked


@pytest.mark.parametrize("entries,block,k", [(1 << 20, 4096, 10), (40, 64, 3)])
def test_against_brute_force(spark, docs, monkeypatch, entries, block, k):
    monkeypatch.setattr(lexical, "BLOCK", block)
    rows, items = corpus()
    table, asked = tables(spark, rows, docs, items)
    got = lexical.ranked(table, asked, k=k, entries=entries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, items, k)


def test_empty_tables(spark, docs):
    rows, items = corpus(30)
    for left, right in (([], items), (rows, []), ([], []), ([(1, None), (2, "...")], items)):
        assert lexical.ranked(*tables(spark, left, docs, right)).collect() == []


def test_bounds_hold_and_prune():
    """No node's bound is below a score of its rows, and groups of alike rows are left shut."""
    rng = np.random.default_rng(2)
    rows, width = 3000, 800
    group = rng.integers(0, 20, rows)
    offsets, terms_, values = [0], [], []
    for g in group:
        own = np.unique(rng.integers(0, 40, rng.integers(0, 25)) + 40 * g)
        terms_.append(own)
        values.append(rng.integers(1, 1_000_000, len(own)))
        offsets.append(offsets[-1] + len(own))
    offsets, terms_, values = np.array(offsets), np.concatenate(terms_).astype(np.int32), np.concatenate(values)
    tree = lexical.BallTree(offsets, terms_, values)
    assert sorted(tree.order.tolist()) == list(range(rows))
    dense_rows = np.zeros((rows, width), np.int64)
    for r in range(rows):
        dense_rows[r, terms_[offsets[r] : offsets[r + 1]]] = values[offsets[r] : offsets[r + 1]]
    opened, leaves = 0, sum(not c for c in tree.children)
    for asked in range(40):
        wanted = np.unique(rng.integers(0, 40, 12) + 40 * (asked % 20))
        weight = rng.integers(0, 30_000, len(wanted))
        dense = np.zeros(width, np.int64)
        dense[wanted] = weight
        scores = dense_rows @ dense
        bound = tree.bounds(wanted, weight)
        for node in range(len(tree.children)):
            inside = tree.order[tree.first[node] : tree.last[node]]
            assert scores[inside].max() <= bound[node]
        best = []
        opened += tree.search(wanted, weight, dense, np.arange(rows), best, 10)
        want = sorted(((int(s), -r) for r, s in enumerate(scores) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
    assert opened < 0.5 * 40 * leaves


def test_lengths_beyond_64_bits():
    n = np.array([5, 10**12])
    got = lexical.impacts(np.array([3, 4]), n, 4 * 10**10, 10**13, np.array([0, 1]))
    want = [10**9 * tf // (1000 * tf + 8 * (10 + 90 * int(x) * 4 * 10**10 // 10**13)) for tf, x in zip((3, 4), n)]
    assert got.tolist() == want
