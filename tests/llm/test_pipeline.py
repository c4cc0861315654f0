"""Stages of the pipeline row by row: repeated ids, null ids, copies that differ in other columns only."""

import collections
import hashlib

import pyarrow as pa
import pytest

from orrery import runtime
from orrery.llm import jaccard, language
from tests.llm.test_operators import brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
BODY = "the quick brown fox jumps over the lazy dog and runs away from the very big bear in the dark wood at night"
OTHER = "wer reitet so spaet durch nacht und wind es ist der vater mit seinem kind er hat den knaben wohl in dem arm"
ROWS = [
    (1, BODY, "a"), (5, BODY, "a"), (5, OTHER, "b"), (7, OTHER + " fest", "b"), (9, "nothing like the others here at all", "c"), (9, "some more words that nobody else has used", "c"),
    (9, "some more words that nobody else has used", "z"), (9, "some more words that nobody else has used", "c"), (None, BODY + " long", "d"), (None, "a null id of its own", "d"), (None, "a null id of its own", "d"), (11, "", "e"), (11, "", "e"), (11, None, "e"),
    (12, "...", "f"), (13, "... ", "f"), (2, OTHER.upper(), "g"), (3, "x y", "h"), (3, "X Y", "h"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "kept", i) for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, id long").repartition(4)


def test_duplicates_by_row(spark, docs):
    out = corpus_pipeline.duplicates_stage(spark, docs, "")
    assert out.columns == docs.columns
    texts = [t for _, t, _ in ROWS]
    sizes, roots = brute_components(texts)
    order = lambda k: (ROWS[k][0] is None, ROWS[k][0] or 0, hashlib.md5((texts[k] or "").encode()).hexdigest(), ROWS[k][2])
    groups = collections.defaultdict(list)
    for k, root in enumerate(roots):
        groups[root if sizes[k] else ("blank", k)].append(k)
    want = sorted(str(ROWS[min(g, key=order)]) for g in groups.values())
    assert sorted(str((r["doc_id"], r["text"], r["source"])) for r in out.collect()) == want
    assert str((5, OTHER, "b")) not in want and str((2, OTHER.upper(), "g")) in want


def test_different_texts_of_one_id_stay(spark):
    rows = spark.createDataFrame([(1, BODY), (5, BODY), (5, OTHER)], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.duplicates_stage(spark, rows, "").collect()) == [(1, BODY), (5, OTHER)]


def test_language_by_row(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(docs)
    want = collections.Counter()
    for r in docs.collect():
        lettered = any(c.isalpha() for c in r["text"] or "")
        if lettered and not model.predict(pa.array([r["text"]], pa.large_string()))[2][0]:
            want[r["doc_id"]] += 1
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, data).select("doc_id").collect()) == want


def test_shared_folder(spark, monkeypatch):
    table = runtime.materialize(spark.range(3), "test")
    assert table.count() == 3
    runtime.discard(table, spark.range(2))
    with pytest.raises(Exception, match="(?i)path|file"):
        table.count()

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Cluster)
    assert jaccard.links_and_classes(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
