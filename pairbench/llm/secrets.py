"""Secret scans: three patterns, and a battery of randomness tests under false-discovery control.

The patterns (assignments, access keys, long hexadecimal runs) are found as such.
Further secrets are tokens that look random. A candidate is a maximal run of
``MIN_CHARS`` or more characters of an encoding alphabet that is not all digits.
Its encoding is the narrowest of ``ENCODINGS`` that holds it, and on the positions
of its characters in that alphabet run

* a chi-squared test of uniformity (standardised by the exact moments for its length),
* a runs test about the middle of the alphabet,
* a test of lag-one serial correlation.

Fisher's method joins the three p-values; a high joint p-value says that nothing
tells the token from a random one. How high it must be depends on length: short
ordinary words can look random. So decoys - stretches of a text's ordinary letters
without their white space, one for each text and class of length - get the same
tests, and in each class the least threshold is taken at which the rate of decoys
over that of candidates stays within ``RATE`` (target-decoy control, with one decoy
added). Counts per class and score bin decide; they are of fixed size, cover all
texts, and are joined back by class.

Edge cases: null and empty texts have no spans; rows with null ids and repeated
rows are scanned like others; few candidates meet no threshold, so only the
patterns remain. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbench.llm.common import stage, text_of

KINDS = ("assign", "access", "hex", "random")
MIN_CHARS = 20
RATE = 0.05
BINS = 100
#: Lower bounds of the classes of length.
CLASSES = (20, 24, 28, 32, 40, 48, 64, 96)

# The patterns of the base kinds.
_WORDS = "password|passwd|secret|token|api_?key"
_EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in _WORDS)
ASSIGN = re.compile(rf"({_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
# A keyword ends in one of these letters, and what follows it is near.
_NEAR = re.compile(r"[dDtTnNyY][\"']?\x20*[:=]")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Alphabets in the order in which they are tried.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_=",
}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    member = np.zeros((len(ENCODINGS), 128), bool)
    place = np.zeros((len(ENCODINGS), 128), np.int16)
    for i, alphabet in enumerate(ENCODINGS.values()):
        codes = np.frombuffer(alphabet.encode(), np.uint8)
        member[i, codes], place[i, codes] = True, np.arange(len(codes))
    return member, place, np.array([len(a) for a in ENCODINGS.values()])


_MEMBER, _PLACE, _SIZE = _tables()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the three patterns."""
    found = []
    if _NEAR.search(text):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _two_sided(z: np.ndarray) -> np.ndarray:
    """Two-sided p-values of standard normal values (Abramowitz and Stegun, formula 7.1.26)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.clip(series * np.exp(-x * x), 1e-300, 1.0)


def battery(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Joint p-value of each token's tests for randomness, and the encoding it was tested in."""
    if not tokens:
        return np.empty(0), np.empty(0, np.int64)
    length = np.array([len(t) for t in tokens])
    codes = np.frombuffer("".join(tokens).encode("latin-1"), np.uint8)
    owner = np.repeat(np.arange(len(tokens)), length)
    begin = np.cumsum(length) - length
    fits = np.array([np.logical_and.reduceat(m[codes], begin) for m in _MEMBER])
    encoding = fits.argmax(axis=0)
    size = _SIZE[encoding]
    place = _PLACE[encoding[owner], codes].astype(np.int64)
    n = length.astype(float)
    # Uniformity.
    widest = int(_SIZE.max())
    counts = np.bincount(owner * widest + place, minlength=len(tokens) * widest).reshape(len(tokens), widest)
    chi = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    uniform = _two_sided((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n))
    # Too even is not held against a token.
    uniform = np.where(chi < size - 1, 1.0, uniform)
    # Runs about the middle.
    upper = place * 2 >= size[owner]
    n1 = np.bincount(owner, weights=upper, minlength=len(tokens))
    n0 = n - n1
    turn = np.append(True, upper[1:] != upper[:-1])
    turn[begin] = True
    runs = np.bincount(owner, weights=turn, minlength=len(tokens))
    expected = 1 + 2 * n0 * n1 / n
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    steady = _two_sided(np.where((n0 == 0) | (n1 == 0), 10.0, (runs - expected) / spread))
    # Serial correlation.
    mean = np.bincount(owner, weights=place, minlength=len(tokens)) / n
    off = place - mean[owner]
    variance = np.bincount(owner, weights=off * off, minlength=len(tokens))
    product = off[1:] * off[:-1]
    product[owner[1:] != owner[:-1]] = 0
    lag = np.bincount(owner[1:], weights=product, minlength=len(tokens)) / np.maximum(variance, 1e-9)
    serial = _two_sided(np.where(variance == 0, 10.0, (lag + 1 / n) * np.sqrt(n)))
    # Fisher's method: chi-squared with six degrees of freedom.
    half = -(np.log(uniform) + np.log(steady) + np.log(serial))
    joint = np.exp(-half) * (1 + half + half * half / 2)
    return np.clip(joint, 0.0, 1.0), encoding


def length_class(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, length, side="right") - 1


def score_bin(score: np.ndarray) -> np.ndarray:
    """Bins of the joint p-value, even in its logarithm down to e ** -20."""
    return np.clip((1 + np.log(np.maximum(score, 1e-12)) / 20) * BINS, 0, BINS - 1).astype(np.int64)


def _decoys(text: str, spans: list[tuple[int, int]], seed: int) -> list[str]:
    """For each class of length, a stretch of ordinary letters of the text, if it has enough."""
    rest, at = [], 0
    for a, b in spans:
        rest.append(text[at:a])
        at = b
    plain = "".join((*rest, text[at:])).encode("ascii", "ignore")
    letters = plain.translate(None, bytes(c for c in range(128) if not chr(c).isalnum() or chr(c).isdigit())).decode()
    found = []
    for low, high in zip(CLASSES, (*CLASSES[1:], 128)):
        size = low + seed % (high - low)
        if len(letters) >= size:
            place = seed * 7919 % (len(letters) - size + 1)
            found.append(letters[place : place + size])
    return found


_SCANNED = (
    "doc_id long, base array<struct<start:int,end:int,kind:string>>, "
    "candidates array<struct<start:int,end:int,class:int,bin:int>>, decoys array<struct<class:int,bin:int>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    tested = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())])
    decoy = pa.struct([("class", pa.int32()), ("bin", pa.int32())])
    for batch in batches:
        base, places, tokens, false = [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            spans = base_spans(text)
            base.append([dict(zip(("start", "end", "kind"), s)) for s in spans])
            taken = _apart([s[:2] for s in spans])
            first, near = len(places), 0
            for m in _TOKEN.finditer(text):
                a, b = m.span()
                # Both go on in the order of the text.
                while near < len(taken) and taken[near][1] <= a:
                    near += 1
                if not m[0].isdigit() and (near == len(taken) or b <= taken[near][0]):
                    places.append((row, a, b))
                    tokens.append(m[0])
            aside = sorted([*taken, *((a, b) for _, a, b in places[first:])])
            false += [(row, d) for d in _decoys(text, _apart(aside), len(text))]
        score, _ = battery(tokens + [d for _, d in false])
        bins = score_bin(score)
        classes = length_class(np.array([len(t) for t in tokens] + [len(d) for _, d in false], np.int64))
        candidates, decoys = [[] for _ in base], [[] for _ in base]
        for (row, a, b), c, s in zip(places, classes, bins):
            candidates[row].append({"start": a, "end": b, "class": int(c), "bin": int(s)})
        for (row, _), c, s in zip(false, classes[len(tokens) :], bins[len(tokens) :]):
            decoys[row].append({"class": int(c), "bin": int(s)})
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(candidates, pa.list_(tested)),
                pa.array(decoys, pa.list_(decoy)),
            ],
            ["doc_id", "base", "candidates", "decoys"],
        )


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in spans:
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def thresholds(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows (class, least): in each class of length, the least bin that keeps the rate of false discoveries.

    At most classes x bins counts.
    """
    def binned(column: str, into: str) -> DataFrame:
        return scanned.select(F.explode(column).alias("t")).groupBy("t.class", "t.bin").agg(F.count(F.lit(1)).alias(into))

    counts = binned("candidates", "candidates").join(binned("decoys", "decoys"), ["class", "bin"], "full").na.fill(0)
    above = Window.partitionBy("class").orderBy(F.desc("bin"))
    whole = Window.partitionBy("class")
    rates = counts.select(
        "class", "bin",
        (F.sum("decoys").over(above) + 1).alias("false"), F.sum("candidates").over(above).alias("found"),
        F.sum("decoys").over(whole).alias("all_decoys"), F.sum("candidates").over(whole).alias("all_candidates"),
    )
    # The decoys' rate, scaled to as many candidates as there are.
    expected = F.col("false") * F.col("all_candidates") / F.greatest("all_decoys", F.lit(1))
    good = rates.filter((F.col("found") > 0) & (F.col("all_decoys") > 0) & (expected <= rate * F.col("found")))
    return good.groupBy("class").agg(F.min("bin").alias("least"))


def scan(docs: DataFrame, rate: float = RATE, id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, spans): arrays of (start, end, kind) in code points, by start and kind."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), text_of().alias("text"))
    scanned = stage(source.mapInArrow(_scan, _SCANNED))
    least = thresholds(scanned, rate).agg(F.map_from_entries(F.collect_list(F.struct("class", "least")))).scalar()
    found = F.filter("candidates", lambda c: c.bin >= F.coalesce(F.try_element_at(F.col("least"), c["class"]), F.lit(BINS)))
    random = F.transform(found, lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), F.lit("random").alias("kind")))
    order = F.array(*[F.lit(k) for k in KINDS])

    def before(a, b):
        rank = lambda s: F.struct(s.start, F.array_position(order, s.kind))
        return F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)

    rows = scanned.withColumn("least", least)
    return rows.select(F.col("doc_id").alias(id), "base", F.array_sort(F.concat("base", random), before).alias("spans"))


def digest(spans, by_hash: bool):
    """kind:start:end of spans, joined by commas; as SHA-256 if asked for."""
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return F.sha2(joined, 256) if by_hash else joined
