"""Quality scores: held-out accuracy, statistics and trees against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairbench.llm import quality
from pairbench.llm.common import table

FOLDER = "/root/testdata/sf0.1"


def plain(text):
    """The statistics of one text, one at a time."""
    data = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    low = [w.lower() for w in words]
    lines = [tuple(w for w in re.split(rb"[\x20\x09-\x0d]+", line.lower()) if w) for line in data.split(b"\n")]
    lines = [x for x in lines if x]
    lengths = [len(w) for w in words]
    up, lo = [sum(a <= c <= b for c in data) for a, b in ((65, 90), (97, 122))]
    stops = sum(chr(c) in ".,;:!?" for c in data)

    def symbol(c):
        return c < 128 and not chr(c).isalnum() and chr(c) not in ".,;:!?" and not (c == 32 or 9 <= c <= 13)

    def share(a, b):
        return a / b if b else 0.0

    mean = share(sum(lengths), len(words))
    pairs = list(zip(low, low[1:]))
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(len(lines)), mean,
        math.sqrt(max(share(sum(x * x for x in lengths), len(words)) - mean**2, 0)), math.log1p(max(lengths, default=0)),
        share(up, up + lo), share(sum(48 <= c <= 57 for c in data), len(data)), share(stops, len(data)),
        share(sum(map(symbol, data)), len(data)), share(sum(c == 32 or 9 <= c <= 13 for c in data), len(data)),
        share(sum(c >= 128 for c in data), len(data)),
        -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()),
        share(len(set(low)), len(low)), share(max(Counter(low).values(), default=0), len(low)), share(len(set(pairs)), len(pairs)),
        share(sum(x <= 3 for x in lengths), len(words)), share(sum(symbol(w[-1]) for w in words), len(words)),
        share(sum(65 <= w[0] <= 90 for w in words), len(words)),
        share(sum(not re.search(rb"[a-z]", w) and len(re.findall(rb"[A-Z]", w)) > 1 for w in words), len(words)),
        math.log1p(share(len(words), len(lines))), 1 - len(set(lines)) / len(lines) if lines else 0.0,
        share(data.count(b"!") + data.count(b"?"), stops),
    ]


def texts():
    pick = random.Random(1)
    some = ["", " \n\t", "One line.", "A\nb\nA\nb c\n\n", "LOUD WORDS!! no???", "größe 日本語 ñ", "x" * 300_000, "### $$ a## b$", "12 34.5"]
    return some + ["".join(pick.choice("abcA B\n.!#9é") for _ in range(pick.randrange(400))) for _ in range(60)]


def test_statistics():
    got = quality.statistics(pa.array(texts(), pa.string()))
    assert got.shape[1] == len(quality.STATISTICS)
    for text, row in zip(texts(), got):
        assert row == pytest.approx(plain(text), abs=1e-9), text[:50]


def test_flat_trees_give_what_walks_down_them_give():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 23))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    model = quality.grow(x, y)
    fresh = rng.normal(size=(200, 23))
    got = model.predict(fresh)
    for row, p in zip(fresh, got):
        total = model.start
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert p == pytest.approx(1 / (1 + math.exp(-total)))
    truth = (fresh[:, 3] > 0.2) ^ (fresh[:, 7] > 0)
    assert ((got >= 0.5) == truth).mean() > 0.9


def test_trees_do_not_split_where_nothing_is_to_learn():
    model = quality.grow(np.zeros((100, 23)), np.ones(100))
    assert np.isinf(model.threshold).all() and (model.predict(np.zeros((2, 23))) > 0.99).all()


def test_held_out_accuracy(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    rows = scored.filter(quality.held_out()).join(labels, "doc_id").select("score", "quality").collect()
    s, y = (np.array([r[i] for r in rows]) for i in range(2))
    assert len(y) > 300
    bad, good = s[y == 0], s[y == 1]
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc > 0.9
    assert ((s >= quality.THRESHOLD) == y).mean() > 0.93
    assert (good >= quality.THRESHOLD).mean() > 0.97


@pytest.fixture
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, text string")


def test_edges(spark, docs, labels_of):
    good, bad = "A quiet line of words, and one more.\n" * 3, "buy### now$$$ BUY### NOW!!! " * 9
    rows = [(i, good + str(i) if i % 3 else bad * (1 + i % 5)) for i in range(240)]
    # One id has a third of all rows.
    rows += [(None, good), (900, None), (901, ""), (902, bad * 20_000)] + [(1, good)] * 120
    labels = [(i, int(i % 3 > 0), "x") for i in range(240)] + [(5, None, None), (None, 1, None), (4, 0, "x"), (77777, 1, "x")]
    table = docs(rows).withColumn("score", F.lit("mine")).withColumn("label", F.lit(9))
    learned = quality.training_rows(table, labels_of(labels)).collect()
    ids = [r["doc_id"] for r in learned]
    assert len(ids) == len(set(ids)) and None not in ids and 77777 not in ids
    assert not any(quality_held_out(i) for i in ids) and {r["doc_id"]: r["label"] for r in learned}.get(4, 1) == 1
    assert quality.training_rows(table, labels_of(labels), bound=10).count() <= 10
    model = quality.fit(table, labels_of(labels))
    got = quality.score(table, model, "found").collect()
    assert len(got) == len(rows) and got[0]["score"] == "mine"
    for r in got:
        assert 0 <= r["found"] <= 1
        if r["text"] and len(r["text"]) > 50:
            assert (r["found"] > 0.5) == r["text"].startswith("A quiet")


def quality_held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_no_labels_and_no_rows(spark, docs, labels_of):
    model = quality.fit(docs([(1, "x")]), labels_of([]))
    assert [r["score"] for r in quality.score(docs([(1, "x"), (None, None)]), model).collect()] == [0.0, 0.0]
    assert quality.score(docs([]), quality.fit(docs([]), labels_of([(1, 1, "x")]))).collect() == []
