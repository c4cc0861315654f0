"""The ten operators against brute force, on whole texts with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import bpe, components, fingerprint, jaccard, language, licenses, packing, pii, registry, secrets, spans, topk, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, fp string, row string, spans int, kind string, label double, found string, fingerprint string, score string"
FRAGMENTS = ["a@b.c", "a@b.c_d@e.f.g", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "00001.2.3.4", "123456789012345678901.2.3.4", "+1 (017) 555-7713", "+12345678901234567890", "4111 1111 1111 1111", "4111-1111-1111-1111 22", "4111  1111", "password=", 'token = "', "abcdef0123456789abcdef", "PassWord:'", "apikey = ", "secret=x=", "AKIAABCDEFGH123456", "é", "日本", " ", "\n", "x", "Z9", "..", "%", "_", "==", '"', "'", "deadbeef", "token=secret:abcdefghijklmnop"]


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [None, "", "   ", "\t\n\r\x0b\x0c", "one", "one two", "ONE two", "....", "a" * 30_000, "1 " * 3000, "a.b@" * 2000, "<|endoftext|> x", "ΣΑΣ İ ſ K ﬁ 1２", "　x\xa0y\x85z"]
    out += ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    base = [sentence(rng, ["der", "die", "und", "haus", "nicht", "auch"], 40), sentence(rng, ["the", "house", "and", "not", "with", "also"], 60)]
    shared = sentence(rng, ["lorem", "ipsum", "dolor", "sit", "amet", "magna"], 55)
    for b in base:
        out += [b, b, b.upper(), b + " end", "start " + b, b.replace(" ", "\n")]
        for _ in range(12):  # near copies with edits at different places
            w = b.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["q", "w", "e"])
            out.append(" ".join(w))
    out += [sentence(rng, list("abcdefgh"), 30) + "\n" + shared + "\n" + sentence(rng, list("ijklmnop"), 60) for _ in range(10)]
    out += ["Some text.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."]
    out += [sentence(rng, ["the", "house", "and", "not", "with", "also", "of"], 5000)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts):
    d = str(tmp_path_factory.mktemp("docs"))
    langs = ["de", "en", None]
    rows = [(i * 3, t, langs[i % 3], f"s{i % 4}" if i % 5 else None, len(t or ""), "x", 1, "y", "z", 2, "k", 0.5, "f", "g", "h") for i, t in enumerate(texts)]
    rows += [rows[40], rows[40]]  # repeated rows
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def by_id(df, texts):
    rows = [r.asDict() for r in df.collect()]
    assert len(rows) == len(texts) + 2
    return {r["doc_id"] // 3: r for r in rows}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def test_pipeline_on_empty_and_odd(spark, empty, folder, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "duplicates", "privacy", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        before, docs = docs, out.persist()
        assert 0 < docs.count() <= before.count()
        if name == "duplicates":
            sets = [shingles(r["text"]) for r in docs.collect()]
            n_sets = len({r["component_id"] for r in jaccard.links_and_classes(before)[0].where("n_shingles > 0").collect()})
            assert sum(bool(x) for x in sets) == n_sets and before.count() - len(sets) > 0
        if name == "privacy":
            assert docs.count() == before.count()
            found = {r["doc_id"]: r for r in pii.extract(before).collect()}
            for r, s in ((r, found[r["doc_id"]]["spans"]) for r in docs.collect()):
                assert all(k in r["text"] for k in {f"[{pii.KINDS[x['kind']].upper()}]" for x in s[:1]})
                assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()


def test_registry_names():
    assert [sum(n.startswith(f"op{k}_") for n in registry.queries()) for k in range(1, 11)] == [1] * 10
    assert set(registry.oracle_sql()) <= set(registry.queries())


# 9 and 7
def test_bpe_equals_library(spark, folder, texts):
    t = Tokenizer.from_file(VOCABULARY)
    got = by_id(bpe.encode_decode(spark.read.parquet(f"{folder}/documents.parquet"), VOCABULARY), texts)
    digests = by_id(bpe.op9_bpe(spark, folder), texts)
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (got[i]["ids"], got[i]["decoded"], got[i]["n_tokens"]) == (ids, decoded, len(ids))
        assert digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_words_and_marks_encode_as_the_library():
    """Cases and marks at words' ends that the cache takes apart."""
    import pyarrow as pa

    t, rng = Tokenizer.from_file(VOCABULARY), random.Random(6)
    some = ["Word", "word", ".", ",", "a", "É", "é", "'S", "'s.", "don't,", "Don'T.", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "x1.", "1.", "..", "a.,", "İ.", "ΑΣ,", "Σ.", "ﬁ.", "\u0301", "e\u0301.", "A\u030a,", " ", "\n", "\xa0", "\u2003", "日.", "_.", "%,", "K."]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["Word. Word, word", "<|endoftext|>.", "", "."]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for known in (packing.cache(VOCABULARY), bpe.encoder(VOCABULARY)[1]):
        ids, bounds = known.tokens(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


def test_other_vocabularies_are_refused(tmp_path):
    import json

    good = json.load(open(VOCABULARY, encoding="utf-8"))
    for what, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", {"type": "ByteLevel"}), ("model", good["model"] | {"byte_fallback": True})):
        path = tmp_path / f"{what}.json"
        path.write_text(json.dumps(good | {what: value}))
        with pytest.raises(ValueError, match=what):
            bpe.TrieBPE(str(path))
    with pytest.raises(ValueError, match="normalizer|model"):
        bpe.TrieBPE(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_replaces_its_own_columns(spark):
    found = spark.createDataFrame([(1, 0, 5, "a", "b"), (1, 0, 5, "a", "b"), (2, 0, 2048, "a", "b")], "doc_id long, piece int, length long, sequence_id string, offset string")
    out = packing.pack(found)
    assert out.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    assert sorted((r["length"], r["offset"]) for r in out.collect()) == [(5, 0), (5, 5), (2048, 0)]


def test_packing(spark, folder, texts):
    t = Tokenizer.from_file(VOCABULARY)
    rows = packing.op7_packing(spark, folder).collect()
    bins, pieces = collections.defaultdict(list), collections.Counter()
    for r in rows:
        ids = t.encode(texts[r["doc_id"] // 3] or "", add_special_tokens=False).ids + [0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] == min(2048, len(ids) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += r["length"]
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.1 * total / 2048 + 1
    whole = packing.pieces(spark.read.parquet(f"{folder}/documents.parquet"), VOCABULARY, with_ids=True)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in whole.collect())


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 4, 5, 3, 5)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 7), (2, 5)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8, 3, 2)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8)]


# 2
def test_fingerprints(spark, folder, texts):
    got = by_id(fingerprint.op2_fingerprints(spark, folder), texts)
    rows = sorted(((i * 3, x or "") for i, x in [*enumerate(texts), (40, texts[40]), (40, texts[40])]), key=lambda r: -r[0])
    for k, (i, x) in enumerate(rows):
        y = rows[(k + 1) % len(rows)][1]
        cut = len(x) // 3
        if i != 120:
            edited = x[: len(x) - cut] + y[:cut]
            assert got[i // 3]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            same = fingerprint.texts_of(fingerprint.vectors(__import__("pyarrow").array([x, edited])))
            assert [got[i // 3]["fingerprint"], got[i // 3]["edited_fingerprint"]] == same
        assert got[i // 3]["n_chars"] == len(x) and 0 <= got[i // 3]["near_edited"] <= 1
    assert len({r["fingerprint"] for i, r in got.items() if texts[i] == texts[40]}) == 1


def test_fingerprint_is_homomorphic():
    import pyarrow as pa

    a, b = "one two three four\nfive six seven", "eight nine ten\neleven"
    v = fingerprint.texts_of(fingerprint.vectors(pa.array([a, b, f"{a}\n{b}", f"{b}\n\n  {a}"])))
    assert fingerprint.combine(v[0], v[1]) == v[2] == v[3] and fingerprint.combine(v[2], v[1], -1) == v[0] and v[0] != v[1]


# 3
def test_top_inner_products(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24)) * rng.gamma(1, 0.2, size=(3000, 1))
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in np.float32(row)], 0) for i, row in enumerate(v)]
    rows += [(3000, None, 0), (3020, [1.0, None], 0), (3040, [float("nan")] * 24, 0), (3060, [float("inf")] * 24, 0), (3080, [0.5] * 5, 0), (3100, [], 0), rows[20], rows[7]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = collections.defaultdict(list)
    for r in topk.op3_top_inner_products(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = {i: np.floor(64 * np.float64(np.float32(row))) for i, row in enumerate(v)} | {3080: np.array([32.0] * 5 + [0.0] * 19), 3100: np.zeros(24)}
    ids = np.array(sorted(q))
    m = np.stack([q[i] for i in ids]).astype(np.int64)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for i in got:
        s = m @ m[np.searchsorted(ids, i)]
        best = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:20]
        assert got[i] == [(r + 1, ids[k], s[k]) for r, k in enumerate(best)]


def test_top_inner_products_of_ties_and_large_numbers(spark, tmp_path, monkeypatch):
    """Small blocks; ties over all of them; repeated ids with different vectors; sums beyond 2**53."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 4)
    monkeypatch.setattr(topk, "GROUP", 3)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(400, 20)) * 1e6 + 3e6, 3)
    v[50:300] = v[50]
    order = rng.permutation(400)
    rows = [(int(i), v[i].tolist()) for i in order] + [(7, (v[7] - 1).tolist()), (7, (v[7] + 1).tolist()), (-20, (-v[3]).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = collections.defaultdict(list)
    for r in topk.op3_top_inner_products(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = {int(i): [int(np.floor(64 * x)) for x in vec] for i, vec in rows[:400]} | {-20: [int(np.floor(64 * x)) for x in -v[3]]}
    q[7] = [int(np.floor(64 * x)) for x in v[7] - 1]
    assert set(got) == {i for i in q if i % 20 == 0}
    for i in got:
        scores = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:20]
        assert got[i] == [(j, -s) for s, j in scores]


# 4
def test_language(spark, folder, texts, data):
    got = by_id(language.op4_language(spark, folder), texts)
    for i, x in enumerate(texts):
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i * 3).encode()) % 5 == 0)
        lettered = bool(x) and any(c.isalpha() for c in x)
        assert (r["lang_pred"] != "und") == lettered and 0 <= r["score"] <= 1
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out("doc_id")).toPandas()
    assert (out.lang_pred == out.lang).mean() >= 0.95 and out.rejected.mean() <= 0.05
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


# 5
def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group(0).lower(), text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_jaccard_join(spark, folder, texts):
    got = by_id(jaccard.op5_jaccard_join(spark, folder), texts)
    sizes, roots = brute_components(texts)
    assert [(got[i]["n_shingles"], got[i]["component_id"] // 3) for i in range(len(texts))] == list(zip(sizes, roots, strict=True))


def test_jaccard_join_of_a_large_group(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice("abcdefghijklmnop") for _ in range(60)]
    texts = []
    for _ in range(300):  # edits that leave some pairs over and others under the threshold
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"e{rng.randrange(30)}"
        texts.append(" ".join(w[rng.randint(0, 4) :]))
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.op5_jaccard_join(spark, str(tmp_path)).collect()}
    want = brute_components(texts)[1]
    assert [got[i] for i in range(300)] == want
    # few pivots and small blocks leave most pairs to the search in blocks
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "LONG", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    out, links = jaccard.links_and_classes(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == dict(enumerate(want))


def test_join_loses_no_link(spark, texts, monkeypatch):
    rng = random.Random(9)
    some = [t for t in texts if t is None or len(t) < 5000]
    base = [rng.choice("abcdefghijklmnop") for _ in range(50)]
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(50)] = f"e{rng.randrange(20)}"
        some.append(" ".join(w))
    monkeypatch.setattr(jaccard, "LONG", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    out, links = jaccard.join(docs)
    sets, want = [shingles(t) for t in some], collections.Counter()
    for a in range(len(some)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                want[a] += 1
                want[b] += 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: want[i] for i in range(len(some))}
    assert [got[i]["component_id"] for i in range(len(some))] == brute_components(some)[1]
    different = {frozenset((sets[i], sets[j])) for i in range(len(some)) for j in range(i) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and sets[i]}
    assert links.count() == len(different)


def test_equal_names_of_unequal_sets(spark, monkeypatch):
    """Where two sets share their 64-bit name, the further bits tell them apart."""
    real = jaccard.sets

    def weak(texts, size, clash=None):
        for first, h, bounds, fp, other in real(texts, size):
            named = fp & 3
            yield first, h, bounds, np.where(np.isin(named, clash), named ^ other, named) if clash is not None and len(clash) else named, other

    texts = [f"{w} one two three four five six" for w in "abcdefghijkl"] * 2
    hashes = [x for _, h, bounds, fp, other in weak(__import__("pyarrow").array(texts), 5) for x in fp.tolist()]
    assert len(set(hashes)) <= 4
    clash = np.array(sorted(set(hashes)))
    assert len({x for _, h, bounds, fp, other in weak(__import__("pyarrow").array(texts), 5, clash) for x in fp.tolist()}) == 12


def test_divide_skip_and_parities():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = np.sort(rng.choice(80, 60, replace=False)).astype(np.uint64)
        query = np.sort(rng.choice(pool, rng.integers(1, 50), replace=False))
        found = [np.sort(rng.choice(pool, rng.integers(1, 55), replace=False)) for _ in range(rng.integers(1, 9))]
        exact = [k for k, f in enumerate(found) if 100 * len(np.intersect1d(query, f)) >= 50 * len(np.union1d(query, f))]
        assert jaccard.divide_skip(query, found, 50).tolist() == exact
        flat, bounds = np.concatenate([query, *found]), np.cumsum([0, len(query), *map(len, found)])
        bits = jaccard.parities(flat, bounds).to_pylist()
        assert all(jaccard.apart(bits[0], b) <= len(np.setxor1d(query, f)) for b, f in zip(bits[1:], found, strict=True))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    want = {}
    for a, b in edges:
        ra, rb = want.setdefault(a, a), want.setdefault(b, b)
        low, high = min(ra, rb), max(ra, rb)
        want = {k: low if v == high else v for k, v in want.items()}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


# 1 and 8
def luhn(d):
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def number(m):
    return re.sub("[^0-9]", "", m.group(0))


def either(word):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


SECRETS = [("assign", f"({'|'.join(map(either, ('password', 'passwd', 'secret', 'token')))}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m.group(0)) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m.group(0)) >= 16)]
PRIVATE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group(0).split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(number(m)) <= 19 and luhn(number(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(number(m)) <= 15)]


@pytest.mark.parametrize(("query", "kinds"), [(secrets.op1_secrets, SECRETS), (pii.op8_pii, PRIVATE)])
def test_base_spans(spark, folder, texts, query, kinds):
    got = by_id(query(spark, folder), texts)
    for i, x in enumerate(texts):
        want = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, x or "") if ok(m))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(w[2] for w in want).encode()).hexdigest()
        assert {w[2] for w in want} <= {*got[i]["spans"].split(",")}
        assert all(got[i][f"n_{name}"] == sum(w[1] == k for w in want) for k, (name, _, _) in enumerate(kinds))


def test_ownership_separates_examples(spark):
    value, own = "Abcdefghij0123456789xyzQ", "Zyxwvutsrq9876543210abcP"
    rows = [(k, f"see {value} here", f"r{k}", f"o{k % 3}") for k in range(6)] + [(6, f"mine {own}", "r6", "o6"), (7, f"again {own}", "r7", "o6"), (8, f'token = "{value}"', "r8", None)]
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string"), F.col("repo"), F.col("owner")).collect()}
    assert all(not found[k] for k in range(6))  # widely copied
    assert [(s["kind"], s["live"], s["n_repositories"]) for s in found[6]] == [(3, True, 2)]
    assert [(s["kind"], s["live"], s["n_owners"]) for s in found[8]] == [(0, False, 4)]


def test_bootstrap_discovers(spark):
    def card(n):
        return next(f"{n}{c}" for c in range(10) if luhn(f"{n}{c}"))

    good = [card(400000000000000 + 7919 * k) for k in range(30)]
    bad = next(f"{400000000000777}{c}" for c in range(10) if not luhn(f"{400000000000777}{c}"))
    rows = [(k, f"pay with card: {c} now") for k, c in enumerate(good)] + [(90, f"pay with card: {bad} now"), (91, f"serial {bad[::-1]} x")]
    found = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == [(2, 15)] and found[90] == [(4, 15)] and found[91] == []
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert redacted[90] == "pay with card: [CONTEXT] now" and redacted[0] == "pay with card: [CARD] now" and redacted[91] == rows[-1][1]


def test_replaced_overlaps(spark):
    df = spark.createDataFrame([("é0123456789", [(1, 0, 4), (2, 1, 6), (8, 1, 9)])], "t string, s array<struct<start:bigint,kind:int,stop:bigint>>")
    assert df.select(spans.replaced(F.col("t"), F.col("s"), ("a", "b")).alias("x")).first()["x"] == "é[A]56[B]89"


# 6
def test_url_filter(spark):
    entries = spark.createDataFrame([("b.com", "ads", "2024-01-10", True), ("b.com", "ads", "2024-02-01", False), ("b.com", "ads", "2024-03-01", True), ("a.b.com", "malware", "2024-01-15", True), ("b.com", "ads", "2024-03-01", False), (None, "ads", "2024-01-01", True)], "suffix string, category string, day string, added boolean").withColumn("day", F.col("day").cast("date"))
    rows = [(1, "http://x.a.b.com/", "2024-01-20"), (2, "https://B.com:80/x", "2024-02-01"), (3, "http://b.com", "2024-03-01"), (4, "http://notb.com", "2024-03-01"), (5, None, "2024-03-01"), (6, "http://b.com", None), (7, "http://b.com", "2024-01-09"), (1, "http://x.a.b.com/", "2024-01-20")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("host", F.lit("clash"))
    for clash in ("category", "suffix", "valid_from", "valid_to", "row", "time", "kept", "n_active", "day"):
        got = urlfilter.judge(captures.withColumn(clash, F.lit(f"own {clash}")), entries)
        assert clash == "n_active" or {r[clash] for r in got.collect()} == {f"own {clash}"}
    for threshold in ("10MB", "-1"):  # with and without a broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = sorted((r["page_id"], r["n_active"], r["categories"], r["blocked"]) for r in urlfilter.judge(captures, entries).collect())
        assert got == [(1, 2, "ads,malware", True), (1, 2, "ads,malware", True), (2, 0, "", False), (3, 1, "ads", True), (4, 0, "", False), (5, 0, "", False), (6, 0, "", False), (7, 0, "", False)]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# 10
def test_licenses(spark, folder, texts):
    got = by_id(licenses.op10_licenses(spark, folder), texts)
    assert {i for i, r in got.items() if r["n_sentences"]} == {len(texts) - 2}
    assert got[len(texts) - 2]["licences"] == "Apache-2.0,MIT"
    rows = [(1, f"{licenses.MIT}, {licenses.SUBJECT}:\n\n{licenses.INCLUDED}."), (2, f"{licenses.MIT} {licenses.SUBJECT}!\n\n{licenses.RESERVED}\n\n{licenses.INCLUDED}"), (3, f"{licenses.BSD.upper()}.\nnoise here.\n{licenses.BSD_SOURCE}\n{licenses.BSD_NAMES}\n{licenses.BSD}\n{licenses.BSD_SOURCE}")]
    out = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ["MIT"], 2: ["proprietary"], 3: ["BSD-3-Clause", "BSD-2-Clause"]}
