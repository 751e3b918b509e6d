"""Phrase collocations against brute force, and the guarantee of the summaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairbench.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, percent=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        known = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        kept = []
        for p, a in known.items():
            around = [c for q, c in known.items() if len(q) > len(p)
                      and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= percent * a for c in around):
                continue
            score, _, l, r = min(
                (1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus():
    pick = random.Random(3)
    words = ["the", "The", "house", "größe", "日本", "a-b", "x", "ÄÖ", "end", "of", "new", "york"]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(pick.randrange(40)):
            text += pick.choice(words[: 3 + i % 10]) + pick.choice([" "] * 8 + ["\t", "  ", ", ", ".", "\n", "! ", "\x0c"])
        rows.append((text, pick.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", "en"), (" .,;\n", "fr"), (None, None), ("one", "one")]
    # A very long text, and one row that stands for a third of all.
    rows += [("New York City Hall " * 3000, "en")] + [("of the end of the house", "de")] * 150
    return rows


@pytest.mark.parametrize("percent,top", [(100, 2000), (60, 5)])
def test_against_brute_force(spark, docs, monkeypatch, percent, top):
    rows = corpus()
    table = docs([(i if i % 7 else None, text, lang) for i, (text, lang) in enumerate(rows)]).repartition(5)
    got = phrases.collocations(table, least=20, percent=percent, top=top)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20, percent, top)


def test_the_empty_table(spark, docs):
    assert phrases.collocations(docs([])).collect() == []
    assert phrases.collocations(docs([(1, None, None), (2, "...", "en")])).collect() == []


def test_columns_of_clashing_names(spark, docs):
    from pyspark.sql import functions as F

    table = docs([(i, "big data now", "en") for i in range(30)])
    for name in ("phrase", "n", "hash", "size", "words", "rank", "part", "k"):
        table = table.withColumn(name, F.lit("x"))
    got = phrases.collocations(table, least=30).collect()
    assert [tuple(r) for r in got] == [("en", 1, "big data now", 30, 30, 30, 90, 3000)]


def test_products_beyond_64_bits(spark):
    from unittest.mock import patch

    a, n = 3_000_000_000_000_000, 900_000_000_000_000_000
    known = spark.createDataFrame(
        [("en", "x y", 2, a), ("en", "x", 1, a + 7), ("en", "y", 1, a + 11)], "lang string, phrase string, size int, n long"
    )
    totals = spark.createDataFrame([("en", n)], "lang string, total long")
    with patch.object(phrases, "counts", lambda docs, least: (known, totals)):
        row = phrases.collocations(None).first()
    assert row["score"] == 1000 * a * n // ((a + 7) * (a + 11))


def test_summaries_keep_what_is_frequent():
    """Over any order of merges: true counts lie between counter and counter + lost, which stays below the threshold."""
    rng = np.random.default_rng(5)
    for least in (5, 40):
        values = np.concatenate([rng.integers(0, 1 << 40, 20_000), np.repeat(np.arange(30), least), rng.zipf(1.4, 20_000) % 5000])
        rng.shuffle(values)
        values = values.astype(np.uint64)
        summary = phrases.MisraGries(len(values) // least + 1)
        for chunk in np.array_split(values, 23):
            summary.merge(*np.unique(chunk, return_counts=True))
            summary.settle()
            assert len(summary.keys) <= summary.capacity
        true = dict(zip(*[x.tolist() for x in np.unique(values, return_counts=True)]))
        held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert 0 < summary.lost < least
        for key, count in true.items():
            assert held.get(key, 0) <= count <= held.get(key, 0) + summary.lost
            assert count < least or key in held
