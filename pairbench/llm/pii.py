"""Personal data: weak labelers vote, expectation-maximisation weighs them, a span classifier decides.

Four patterns (email, ip, card, phone) are found as such and always stay. Further
candidates are spans of a looser shape: obfuscated addresses, phone numbers
without a plus, identity numbers, bank accounts, long network addresses, pairs of
capitalised words. Five labelers look at each candidate, the four patterns' spans
included, and vote for (1), against (2) or not at all (0):

* ``pattern``: the kind's strict form and its checksum,
* ``gazetteer``: known domains, dial codes, issuers, countries, given names,
* ``before`` and ``after``: words and signs of the context that go with the kind, or against it,
* ``shape``: whether the digits or letters vary as real ones do.

Votes are counted over all texts; expectation-maximisation on these counts
estimates each labeler's reliability for each kind, without labels. Its posteriors
are then the soft labels of a logistic regression on features of the span (kind,
length, share of digits, neighbours, votes of the two context labelers), again on
counts over all texts. Both tables of counts have a fixed greatest size, which is
all that reaches the driver. Candidates stay if the classifier gives
``THRESHOLD`` or more and they overlap no pattern's span and no earlier candidate.

Edge cases: null and empty texts have no spans; rows with null ids and repeated
rows are scanned like others; without candidates there is no model and nothing is
added. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.common import stage, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_like", "phone_like", "id_number", "iban", "ip6", "name")
KINDS = (*BASE, *ADDED)
LABELERS = ("pattern", "gazetteer", "before", "after", "shape")
THRESHOLD = 0.5
CONTEXT = 32
ROUNDS = 50

# The patterns of the base kinds. A match can begin only where a
# run of digits does, which the look-behind says to keep the search linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# The looser shapes.
_AT, _DOT = r"\x20?[(\[{]at[)\]}]\x20?", r"\x20?(?:\.|[(\[{]dot[)\]}])\x20?"
SHAPES = {
    "email_like": re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}"),
    "phone_like": re.compile(
        r"(?<![0-9+.(-])(?:\([0-9]{2,4}\)\x20?|00[0-9]{1,3}[\x20.-]?[0-9]{2,4}[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9.-])"
    ),
    "id_number": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "name": re.compile(r"(?<![A-Za-z])[A-Z][a-z]{1,20}\x20[A-Z][a-z]{1,20}(?![A-Za-z])"),
}

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov int info io de fr es it uk us eu ch at nl be ca au jp in br mx".split())
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
              "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
IBAN_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split())
GIVEN_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica "
    "thomas sarah charles karen anna peter paul laura maria jose juan carlos pierre jean marie claude hans klaus "
    "anke sabine stefan julia luis carmen antonio lucia sophie camille".split()
)

# Words of the context, for and against.
FOR = {
    "email": "mail contact write address reach", "email_like": "mail contact write address reach",
    "ip": "ip host server address client from", "ip6": "ip host server address client from",
    "card": "card visa credit pay mastercard", "phone": "call phone tel mobile fax contact",
    "phone_like": "call phone tel mobile fax contact", "id_number": "ssn social security id number",
    "iban": "iban account bank transfer", "name": "mr mrs ms dr name contact dear signed by patient",
}
AGAINST = frozenset("version release isbn issn order invoice section chapter page build figure table vol no".split())
_UNITS = re.compile(r"\s{0,2}(?:%|\$|€|(?:kg|km|cm|mm|usd|eur|pages|items)\b)", re.I)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the four patterns, by kind and start."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append(("email", begin, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of looser shapes that overlap none of the patterns'; earlier kinds win."""
    # One byte for each character, so that a test costs the length of a span, however many there are.
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = bytes([1]) * (b - a)
    found = []
    low = text.lower() if "at" in text.lower() else ""
    for kind, shape in SHAPES.items():
        if kind == "email_like" and not any(mark in low for mark in ("(at)", "[at]", "{at}")):
            continue
        for m in shape.finditer(text):
            a, b = m.span()
            if taken.find(1, a, b) < 0:
                found.append((kind, a, b))
                taken[a:b] = bytes([1]) * (b - a)
    return found


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else 2 if no else 0


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """The labelers' votes on a span: 1 for, 2 against, 0 none."""
    span, digits = text[a:b], _digits(text[a:b])
    words = re.findall(r"[A-Za-z]+", text[max(0, a - CONTEXT) : a].lower())
    for_it, against = FOR[kind].split(), AGAINST
    before = _vote(any(w.startswith(c) if len(c) > 3 else w == c for w in words for c in for_it), any(w in against for w in words))
    after = _vote(False, bool(_UNITS.match(text, b)) or text[b : b + 1] in ("/", "_", "="))
    if kind in ("email", "email_like"):
        top = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}"))[-1].lower()
        strict = top.isalpha() and len(top) >= 2
        known, unknown, varied = top in TOP_DOMAINS, not strict, len(set(span.split("@")[0])) > 2
    elif kind == "ip":
        parts = [int(p) for p in span.split(".")]
        strict = all(str(int(p)) == p for p in span.split("."))
        known, unknown, varied = 0 < parts[0] < 224 and parts[0] != 127, parts[0] in (0, 127) or parts[0] >= 240, len(set(parts)) > 1
    elif kind == "ip6":
        strict, known, unknown, varied = True, span.startswith("2"), False, len(set(span)) > 4
    elif kind == "card":
        strict, known, unknown, varied = luhn(digits), digits[0] in "3456", digits[0] in "07", len(set(digits)) > 3
    elif kind in ("phone", "phone_like"):
        strict = 9 <= len(digits) <= 13
        national = digits.removeprefix("00") if kind == "phone_like" else digits
        coded = kind == "phone" or digits.startswith("00")
        known = coded and any(national.startswith(c) for c in DIAL_CODES)
        unknown, varied = coded and not known, len(set(digits)) > 3
    elif kind == "id_number":
        strict = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
        known, unknown, varied = False, not strict, len(set(digits)) > 3
    elif kind == "iban":
        plain = span.replace(" ", "")
        strict = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        known, unknown, varied = plain[:2] in IBAN_COUNTRIES, plain[:2] not in IBAN_COUNTRIES, len(set(digits)) > 3
    else:
        first, second = span.lower().split(" ")
        strict = first in GIVEN_NAMES
        known, unknown = strict, first not in GIVEN_NAMES and second not in GIVEN_NAMES
        varied = 2 < len(second) < 15
        before_it = a
        while before_it and text[before_it - 1] == " ":
            before_it -= 1
        if text[max(0, before_it - 1) : before_it] in ("", ".", "!", "?", "\n"):
            unknown = unknown or not known
    return _vote(strict, not strict), _vote(known, unknown), before, after, _vote(varied, not varied)


#: Levels of the classifier's features; their product bounds the table of counts.
LEVELS = (len(KINDS), 4, 4, 3, 3, 3, 3)


def features(text: str, kind: str, a: int, b: int, vote: tuple[int, ...]) -> tuple[int, ...]:
    """Kind, length, share of digits, kinds of the neighbour characters, and the context's votes."""
    def neighbour(c: str) -> int:
        return 0 if not c or c.isspace() else 1 if c.isalnum() else 2

    size = b - a
    return (
        KINDS.index(kind),
        0 if size < 12 else 1 if size < 18 else 2 if size < 28 else 3,
        min(3, 4 * len(_digits(text[a:b])) // size),
        neighbour(text[a - 1 : a]),
        neighbour(text[b : b + 1]),
        vote[2],
        vote[3],
    )


def packed(values: tuple[int, ...], levels: tuple[int, ...]) -> int:
    number = 0
    for v, n in zip(values, levels):
        number = number * n + v
    return number


def unpacked(number: int, levels: tuple[int, ...]) -> tuple[int, ...]:
    values = []
    for n in reversed(levels):
        number, v = divmod(number, n)
        values.append(v)
    return tuple(reversed(values))


_VOTE_LEVELS = (3,) * len(LABELERS)
_SCANNED = "doc_id long, spans array<struct<kind:int,start:int,end:int,votes:int,features:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "votes", "features")
    one = pa.struct([(n, pa.int32()) for n in names])
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            row = []
            for kind, a, b in [*base, *candidates(text, base)]:
                vote = votes(text, kind, a, b)
                code = packed(features(text, kind, a, b, vote), LEVELS)
                row.append(dict(zip(names, (KINDS.index(kind), a, b, packed(vote, _VOTE_LEVELS), code))))
            rows.append(row)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(one))], ["doc_id", "spans"])


def estimate(counts: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """Posterior that a span of a vote pattern is personal data, by expectation-maximisation.

    The labelers are independent given the truth; each has a table of vote
    probabilities for either truth, which starts in favour of its votes.
    """
    patterns = np.array([unpacked(c, _VOTE_LEVELS) for c in counts])
    weight = np.array([float(n) for n in counts.values()])
    table = np.tile(np.array([[0.4, 0.15, 0.45], [0.4, 0.45, 0.15]]), (len(LABELERS), 1, 1))
    prior = 0.5
    for _ in range(rounds):
        logs = np.log([1 - prior, prior]) + sum(np.log(table[i][:, patterns[:, i]]).T for i in range(len(LABELERS)))
        logs -= logs.max(axis=1, keepdims=True)
        posterior = np.exp(logs)
        posterior = (posterior / posterior.sum(axis=1, keepdims=True))[:, 1]
        sides = np.stack([weight * (1 - posterior), weight * posterior])
        prior = float(np.clip((sides[1].sum() + 1) / (weight.sum() + 2), 0.02, 0.98))
        for i in range(len(LABELERS)):
            seen = np.stack([np.bincount(patterns[:, i], weights=s, minlength=3) for s in sides])
            # The start counts as some observations, so that few spans do not turn a labeler around.
            seen += 20 * np.array([[0.4, 0.15, 0.45], [0.4, 0.45, 0.15]])
            table[i] = seen / seen.sum(axis=1, keepdims=True)
    return dict(zip(counts, posterior.tolist()))


def _design(codes: list[int]) -> np.ndarray:
    """One-hot features, and an intercept."""
    rows = np.array([unpacked(c, LEVELS) for c in codes])
    columns = [rows[:, [i]] == np.arange(n) for i, n in enumerate(LEVELS)]
    return np.hstack([np.ones((len(rows), 1)), *columns]).astype(float)


def train(soft: dict[int, tuple[float, float]], rounds: int = 30, ridge: float = 1.0) -> dict[int, float]:
    """Probability of each feature code, by logistic regression on (sum of posteriors, count) of each."""
    codes = list(soft)
    x = _design(codes)
    positive = np.array([soft[c][0] for c in codes])
    total = np.array([soft[c][1] for c in codes])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (positive - total * p) - ridge * w
        curve = (x * (total * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def scan(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, base, spans): arrays of (kind, start, end) in code points, by kind and start."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), text_of().alias("text"))
    scanned = stage(source.mapInArrow(_scan, _SCANNED))
    spans = scanned.select(F.explode("spans").alias("s")).select("s.*")
    # At most kinds x 3 ** labelers rows, and as many as feature codes.
    patterns = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    by_kind = {k: {r["votes"]: r["n"] for r in rows} for k, rows in itertools.groupby(sorted(patterns), lambda r: r["kind"])}
    posterior = {(k, v): p for k, counts in by_kind.items() for v, p in estimate(counts).items()}
    accepted: list[int] = []
    if posterior:
        entries = [F.lit(x) for k, v in posterior for x in (k * 3 ** len(LABELERS) + v, posterior[k, v])]
        label = F.element_at(F.create_map(*entries), F.col("kind") * 3 ** len(LABELERS) + F.col("votes"))
        sums = spans.groupBy("features").agg(F.sum(label).alias("positive"), F.count(F.lit(1)).alias("n")).collect()
        scores = train({r["features"]: (r["positive"], r["n"]) for r in sums})
        accepted = [c for c, p in scores.items() if p >= threshold]
    allowed = F.array(*[F.lit(c) for c in accepted]).cast("array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])

    def plain(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.kind.alias("number"), s.start.alias("start"), s.end.alias("end"))))
        return F.transform(ordered, lambda s: F.struct(F.get(names, s.number).alias("kind"), s.start.alias("start"), s.end.alias("end")))

    base = F.filter("spans", lambda s: s.kind < len(BASE))
    every = F.filter("spans", lambda s: (s.kind < len(BASE)) | F.array_contains(allowed, s.features))
    return scanned.select(F.col("doc_id").alias(id), plain(base).alias("base"), plain(every).alias("spans"))
