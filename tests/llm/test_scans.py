"""Scans for secrets and personal data: places in very long texts, and bootstrapping against brute force."""

import collections
import math
import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from orrery.llm import pii, secrets, spans


def test_scan_and_apart(spark):
    rng = random.Random(1)
    some = lambda: [(x, x + rng.randint(1, 6)) for x in sorted(rng.randint(0, 60) for _ in range(rng.randint(0, 9)))]
    rows = [(some(), some()) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<struct<start:bigint,stop:bigint>>, b array<struct<start:bigint,stop:bigint>>")
    stops = F.transform("a", lambda s: s["stop"])
    for r in df.select("a", "b", spans.apart(F.col("a"), F.col("b")).alias("k"), spans.scan(stops, lambda x, y: x + y).alias("sums"), spans.scan(stops, F.greatest).alias("most")).collect():
        free = [(x.start, x.stop, i) for i, x in enumerate(r.a) if not any(y.start < x.stop and x.start < y.stop for y in r.b)]
        assert [tuple(k) for k in r.k] == sorted(free)
        assert r.sums == [sum(x.stop for x in r.a[: i + 1]) for i in range(len(r.a))]
        assert r.most == [max(x.stop for x in r.a[: i + 1]) for i in range(len(r.a))]


def test_long_texts_in_time(spark):
    """A text of 5 MB with 200,000 addresses and another with as many secrets: under a minute each."""
    mail = " ".join(f"ü user{i}@host{i % 9}.example" for i in range(200_000))
    key = " ".join(f"é secret=k{i:013d}z" for i in range(200_000))
    digits = "1 " * 1_000_000 + "7" * 1_000_000
    docs = spark.createDataFrame([(1, mail, "s"), (2, key, "s"), (3, digits, "s")], "doc_id long, text string, source string")
    assert len(mail) > 4_000_000
    began = time.time()
    found = {r["doc_id"]: r["n"] for r in pii.extract(docs).select("doc_id", F.size("spans").alias("n")).collect()}
    assert found == {1: 200_000, 2: 0, 3: 0} and time.time() - began < 60
    began = time.time()
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert redacted[1] == " ".join(["ü [EMAIL]"] * 200_000) and redacted[2] == key and time.time() - began < 60
    began = time.time()
    found = {r["doc_id"]: r["n"] for r in secrets.scan(docs, F.col("source"), F.col("source")).select("doc_id", F.size("spans").alias("n")).collect()}
    assert found[1] == 0 and found[2] >= 200_000 and time.time() - began < 60


# bootstrapping
LEFT, RIGHT = regex.compile(r"(?<!\p{L})(\p{L}++)[^\p{L}\p{N}]*+$"), regex.compile(r"^[^\p{L}\p{N}]*+(\p{L}++)")


def wilson(good, n, z=pii.Z):
    share = good / n
    return (share + z * z / (2 * n) - z * math.sqrt(max(share * (1 - share), 0) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def brute(texts, base, least=6, trust=0.8, accept=0.8):
    """{row: sorted spans of discovered instances}; `base` has each text's seeds."""
    each = []
    for row, (text, seeds) in enumerate(zip(texts, base, strict=True)):
        text = text or ""
        found = [(m.start(), m.end(), False) for m in regex.finditer(pii.TOKEN, text) if sum(c in "0123456789" for c in m.group()) >= least]
        found = [f for f in found if not any(a < f[1] and f[0] < b for a, b in seeds)]
        every, far = sorted([*found, *((a, b, True) for a, b in seeds)]), 0
        for k, (a, b, seed) in enumerate(every):
            until = every[k + 1][0] if k + 1 < len(every) else len(text)
            left, right = LEFT.search(text[far:a] if a > far else ""), RIGHT.search(text[b:until] if until > b else "")
            left, right = left and left[1].lower(), right and right[1].lower()
            far = max(far, b)
            each.append((row, a, b, text[a:b], seed, [p for p in (left and f"< {left}", right and f"> {right}", left and right and f"{left} <> {right}") if p]))
    edges = collections.defaultdict(dict)
    for _, _, _, value, seed, patterns in each:
        for p in patterns:
            edges[p][value] = edges[p].get(value, False) or seed
    accepted = {}
    while True:
        scores = {}
        for p, values in edges.items():
            s = round(wilson(sum(1 if seed else accepted.get(v, 0) for v, seed in values.items()), len(values)), 6)
            if s >= trust:
                for v, seed in values.items():
                    if not seed and v not in accepted:
                        scores[v] = scores.get(v, 1) * (1 - s)
        fresh = {v: round(1 - q, 6) for v, q in scores.items() if round(1 - q, 6) >= accept}
        if not fresh:
            break
        accepted |= fresh
    out = collections.defaultdict(list)
    for row, a, b, value, seed, _ in each:
        if not seed and value in accepted:
            out[row].append((a, b))
    return {r: sorted(v) for r, v in out.items()}


SEEDS, UNSEEN = 1500, 150
SECOND = SEEDS + 2 * UNSEEN  # the first text whose instance only the second round finds


def corpus():
    rng = random.Random(5)
    texts = [f"Our phone: +1 (555) 01{i // 100:02d}-{1000 + i} please" for i in range(SEEDS)]
    unseen = [f"555-010-{4400 + i}" for i in range(UNSEEN)]  # no seed has their form
    texts += [f"Our phone: {u} please" for u in unseen]
    texts += [f"Mobil {u} jetzt" for u in unseen]  # good only once the unseen ones are
    texts += ["Mobil 020 9911 2288 jetzt", "mobil (0800) 77-12x jetzt " + "9" * 400, f"MOBIL -- {'A1' * 300} jetzt"]
    texts += [f"serial {rng.randrange(10**9, 10**10)} of part" for _ in range(60)] + ["ref 1-2-3-4-5-6 x", "serial +1 555 0100 1234 of", None, "", "12345", "nothing 1999 here"]
    texts += ["phone: " + "x" * 5000 + " 123456789 please", texts[0], texts[SEEDS + 5], "é\n\nphone:\n\n7.7.7.7.7.7\n\nplease", "phone 004412345 bitte"]
    words = ["phone", "mobil", "serial", "please", "jetzt", "of", "x9", "…", "-", "+49 30 1234567", "a@b.de", "10.0.0.1", "123456", "(12) 34 56 78", "77/88/99", "№ 5551234"]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(40)]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s", "e", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, kept string, row int").repartition(3)
    return texts, docs, {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.extract(docs).collect()}


def test_bootstrapping_equals_brute_force(scanned):
    texts, _, got = scanned
    context = len(pii.KINDS) - 1
    base = [[(a, b) for a, k, b in got[i] if k < context] for i in range(len(texts))]
    want = brute(texts, base)
    assert {i: sorted((a, b) for a, k, b in s if k == context) for i, s in got.items() if any(k == context for _, k, _ in s)} == want
    assert {texts[SECOND][a:b] for a, b in want[SECOND]} == {"020 9911 2288"}
    assert all(want.get(i) for i in range(SEEDS, SECOND + 3)) and len(texts[SECOND + 2]) > 600
    assert not any(want.get(i) for i in range(SECOND + 3, SECOND + 63))  # serial numbers


def test_redacted_rows_keep_their_columns(scanned):
    texts, docs, got = scanned
    out = pii.redact(docs, size_col="row")
    assert out.columns == docs.columns
    for r in out.collect():
        text = texts[r["doc_id"]]
        if text is None:
            assert r["text"] is None and r["row"] is None
            continue
        want, at = "", 0
        for a, k, b in got[r["doc_id"]]:
            if a >= at:
                want += text[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        assert r["text"] == want + text[at:] and r["row"] == len(r["text"]) and r["spans"] == "s"
