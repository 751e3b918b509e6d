"""Secret scans and personal data against plain patterns, and what the methods add."""

import hashlib
import random
import re
import string
import time

import numpy as np
import pyarrow as pa

from pairbench.llm import pii, secrets

ASSIGN = re.compile(
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
)
TRICKY = [
    None, "", "password=abc", "password=abcdef", "Api_Key : 'abcdef123'", "TOKEN\"= \"secret=abcdef", "apikey:x token=123456",
    "passwd  =  password=abcdef", "é password=ünicode", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B9" * 12,
    "deadbeef" * 3, "deadbeef" * 3 + "g" + "0" * 23, "secret:" + "0123456789abcdef" * 2, "paſsword=abcdef", "toKen=abcdef",
]


def plain_secrets(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for *_, s in sorted(found)]


def joined(spans, by_start=False):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]


def test_base_secrets(docs):
    rng = random.Random(1)
    pieces = ["password", "token", "=", ": ", "'", "AKIA", "abcdef12", "0" * 12, "api_key", " ", "\n", "é", "ABCDEFGH"]
    texts = TRICKY + ["".join(rng.choice(pieces) for _ in range(25)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "token=abcdef"), (3, texts[3])]
    found = secrets.scan(docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = "token=abcdef" if r.doc_id is None else texts[r.doc_id] or ""
        assert joined(r.base) == plain_secrets(text)
        assert set(joined(r.base)) <= set(joined(r.spans))
    assert secrets.scan(docs([])).count() == 0


def ordinary(rng, n):
    syllables = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_random_tokens_are_added_and_words_are_not(docs):
    rng = random.Random(4)
    alphabet = string.ascii_letters + string.digits + "+/"
    rows, planted = [], {}
    for i in range(400):
        text = ordinary(rng, 150)
        if i % 2:
            key = "".join(rng.choice(alphabet) for _ in range(rng.choice([40, 48, 64])))
            planted[i] = (len(text) + 1, len(text) + 1 + len(key))
            text += " " + key + " " + ordinary(rng, 20)
        else:
            text += " " + ordinary(rng, 30).replace(" ", "")[:50] + " end"
        rows.append((i, text))
    found = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in secrets.scan(docs(rows)).collect()}
    hits = sum(any((s.start, s.end) == planted[i] for s in found[i]) for i in planted)
    false = sum(bool(found[i]) for i in found if i not in planted)
    assert hits >= 0.85 * len(planted)
    assert false <= 0.08 * (hits + false)


def test_the_battery_tells_random_from_ordered():
    rng = np.random.default_rng(0)
    letters = np.array(list(string.ascii_letters + string.digits + "+/"))
    tokens = ["".join(rng.choice(letters, 48)) for _ in range(400)]
    random_scores, _ = secrets.battery(tokens)
    # Joint p-values of random tokens are about even.
    assert 0.02 <= (random_scores < 0.1).mean() <= 0.25
    ordered, _ = secrets.battery(["abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH", "ab" * 24, "a" * 40, "aaaaaaaaaaaaaaaaaaaaZZZZZZZZZZZZZZZZZZZZ"])
    assert (ordered < 1e-3).all()
    assert secrets.battery([])[0].size == 0


def test_encodings():
    _, encoding = secrets.battery(["0123456789abcdef0123", "ABCDEFGHIJKLMNOPQRST", "a1b2c3d4e5f6g7h8i9z0", "aB3+/aB3+/aB3+/aB3+/"])
    assert [list(secrets.ENCODINGS)[e] for e in encoding] == ["hex", "upper", "lower36", "base64"]


def plain_pii(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def test_base_pii(docs):
    rng = random.Random(2)
    pieces = ["a.b", "@", "x-y", ".", ".com", "1", "255", "300", "0", " ", "-", "+", "4111 1111 1111 1111", "(555)", "é", "\n", "٣"]
    texts = [None, "", "@", "a@b", "a@b.c@d.e", "a@@b.c", "+1 (555) 123-4567", "1.2.3.4.5", "0001.2.3.04", "4111111111111111"]
    texts += ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.c"), (5, texts[5])]
    found = pii.scan(docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = "a@b.c" if r.doc_id is None else texts[r.doc_id] or ""
        assert joined(r.base) == plain_pii(text)
        assert set(joined(r.base)) <= set(joined(r.spans))
    assert pii.scan(docs([])).count() == 0


def test_looser_spans_are_weighed(docs):
    rng = random.Random(7)
    rows, good, bad = [], {}, {}
    for i in range(600):
        head = ordinary(rng, 20)
        kind = i % 4
        if kind == 0:
            span, text = "jane.roe (at) example (dot) org", " please contact "
            good[i] = span
        elif kind == 1:
            span, text = f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", " call us on "
            good[i] = span
        elif kind == 2:
            span, text = f"{rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(100, 999)}", " version "
            span = span.replace(" ", "-", 1)
            bad[i] = span
        else:
            span, text = f"user{i}@mail.com", " mail "
        rows.append((i, head + text + span + ("%" if kind == 2 else " ") + ordinary(rng, 5)))
    texts = dict(rows)
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.scan(docs(rows)).collect()}
    assert sum(good[i] in found[i] for i in good) >= 0.9 * len(good)
    assert sum(bad[i] in found[i] for i in bad) <= 0.1 * len(bad)


def test_expectation_maximisation_finds_the_reliable():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.4
    accuracy = [0.95, 0.85, 0.7, 0.6, 0.55]
    votes = np.stack([np.where(rng.random(5000) < a, truth, ~truth) for a in accuracy], 1)
    votes = np.where(rng.random(votes.shape) < 0.2, 0, np.where(votes, 1, 2))
    codes = [pii.packed(tuple(v), (3,) * 5) for v in votes.tolist()]
    posterior = pii.estimate({c: codes.count(c) for c in set(codes)})
    found = (np.array([posterior[c] > 0.5 for c in codes]) == truth).mean()
    majority = ((votes == 1).sum(1) > (votes == 2).sum(1)) == truth
    assert found > 0.9 and found > majority.mean() + 0.03
    assert pii.unpacked(pii.packed((1, 2, 0, 1, 2), (3,) * 5), (3,) * 5) == (1, 2, 0, 1, 2)


def test_digests_of_spans(docs):
    row = secrets.scan(docs([(1, "token=abcdef")])).select(
        secrets.digest("base", True).alias("h"), secrets.digest("spans", False).alias("s")
    ).first()
    assert row.s == "assign:0:12" and row.h == hashlib.sha256(b"assign:0:12").hexdigest()


def test_decoys_hold_no_candidate(monkeypatch):
    rng = random.Random(4)
    keys = ["".join(rng.choice("QWRTZPSDFGHJKLqwrtzpsdfghjkl0123456789") for _ in range(40)) for _ in range(150)]
    seen = []
    monkeypatch.setattr(secrets, "_decoys", lambda text, spans, seed: seen.append((text, spans)) or [])
    batch = pa.record_batch([pa.array([1, 2]), pa.array([" ".join(keys), "plain words"])], ["doc_id", "text"])
    found = next(secrets._scan(iter([batch]))).column("candidates").to_pylist()[0]
    text, spans = seen[0]
    assert len(found) > 64 and all(any(a <= c["start"] and c["end"] <= b for a, b in spans) for c in found)
    assert seen[1][1] == []


def test_looser_spans_overlap_nothing():
    rng = random.Random(4)
    parts = ["Anna Smith", "555-1234 567", "123-45-6789", "a(at)b.com", "x@y.org", "+1 202 555 0143", "192.168.0.1", "Peter Paul Mary", "-", ".", " met "]
    for _ in range(300):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(12))).replace(" - ", "-")
        base = pii.base_spans(text)
        taken, want = [(a, b) for _, a, b in base], []
        low = text.lower()
        for kind, shape in pii.SHAPES.items():
            if kind == "email_like" and "(at)" not in low:
                continue
            for m in shape.finditer(text):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    want.append((kind, *m.span()))
                    taken.append(m.span())
        assert pii.candidates(text, base) == want


def scanned(scan, text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    return next(iter(scan(iter([batch])))).to_pylist()[0]


def test_long_texts_of_many_spans_take_time_in_proportion():
    def seconds(scan, text):
        begun = time.process_time()
        return scanned(scan, text), time.process_time() - begun

    few, many = 5000, 100_000
    names = lambda n: " ".join(f"Anna Smith{'abcdefghij'[i % 10]} met" for i in range(n))
    keys = lambda n: " ".join(f"password=abcdef{i} Zk3{i}qLmN8vXw2RtY7uPq" for i in range(n))
    for scan, text, column in ((pii._scan, names, "spans"), (secrets._scan, keys, "candidates")):
        _, short = seconds(scan, text(few))
        row, long = seconds(scan, text(many))
        assert len(row[column]) == many
        # Twenty times the spans; squares would be four hundred times.
        assert long < 100 * max(short, 0.05)
