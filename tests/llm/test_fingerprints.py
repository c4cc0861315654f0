"""Likeness of fingerprints against brute-force multisets of word runs, and the strength of equality."""

import collections
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orrery.llm import fingerprint


def runs(text, n=3):
    """The multiset of a text's word runs by paragraph, numbered within it: the counts the likeness is read from."""
    out = collections.Counter()
    for line in text.split("\n"):
        words = line.split()
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] if words else []
        seen = collections.Counter()
        for g in grams:
            out[(g, seen[g])] += 1
            seen[g] += 1
    return out


def overlap(a, b):
    """Multiset Jaccard: the sum of the smaller counts over that of the larger ones."""
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def pairs():
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table")
    texts = [t for t in pq.read_table(path)["text"].to_pylist()[:300]]
    rng = random.Random(2)
    out = []
    for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
        cut = int(len(a) * rng.random())
        out += [(a, b), (a, a[:cut] + b[: len(a) - cut]), (a, a)]
    return out


def test_likeness_is_near_the_overlap_of_multisets():
    made = pairs()
    v, w = (fingerprint.vectors(pa.array([p[k] for p in made], pa.large_string())) for k in (0, 1))
    got = fingerprint.likeness(v, w)
    want = np.array([overlap(runs(a), runs(b)) for a, b in made])
    error = np.abs(got - want)
    assert error.mean() <= 0.02 and np.quantile(error, 0.95) <= 0.08
    assert all(g == 1 for g, (a, b) in zip(got, made, strict=True) if a == b)


def test_lanes_are_independent():
    """No lane of a paragraph's vector follows from another: all differ, and sums don't collide lane by lane."""
    v, _ = fingerprint.vectors(pa.array([f"paragraph {k}" for k in range(2000)], pa.large_string()))
    assert v.shape[1] >= 8 and len(np.unique(v)) == v.size
    assert abs(np.corrcoef((v >> np.uint64(11)).astype(float).T) - np.eye(v.shape[1])).max() < 0.1


def test_repeats_and_order():
    a, b = "x y z w\nfive six seven eight", "nine ten eleven\nx y z w"
    made = [a, f"{a}\n{a}", f"{a}\n{b}", f"{b}\n{a}", "", " \n\t", "z z z z z z", "z z z z z z z"]
    v = fingerprint.vectors(pa.array(made, pa.large_string()))
    t = fingerprint.texts_of(v)
    assert t[2] == t[3] and t[4] == t[5] and len({t[0], t[1], t[2], t[4], t[6], t[7]}) == 6
    assert fingerprint.combine(t[0], t[0]) == t[1] and fingerprint.combine(t[1], t[0], -1) == t[0]
    near = fingerprint.likeness(tuple(x[6:7] for x in v), tuple(x[7:8] for x in v))[0]
    assert 0.5 < near < 1  # 4 of 5 numbered runs


def test_null_and_equal_ids(spark, tmp_path):
    rows = [(3, "b"), (3, "a"), (None, "last"), (None, None), (7, "first"), (7, "first")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["doc_id"], r["n_chars"]) for r in fingerprint.op2_fingerprints(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(i, len(t or "")) for i, t in rows], key=str)
