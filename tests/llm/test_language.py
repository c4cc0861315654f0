"""Calibrated rejection of languages and scripts that were not learned, at samples of several sizes."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import language

UNSEEN = [
    "Regeringen har i dag besluttet at give flere penge til skolerne, fordi børnene skal lære mere og have bedre lærere i fremtiden.",
    "Hallitus päätti tänään antaa lisää rahaa kouluille, koska lasten pitää oppia enemmän ja heillä pitää olla parempia opettajia.",
    "Правительство сегодня решило выделить больше денег школам, потому что дети должны учиться лучше.",
    "政府は今日、学校にもっとお金を出すことを決めました。子供たちはもっと学ぶ必要があります。",
    "Rząd zdecydował dziś przeznaczyć więcej pieniędzy na szkoły, ponieważ dzieci powinny się lepiej uczyć.",
    "xqzv wkjr plmq zzxv bnrt qqwp lkjh gfds vbnm xcvz qwpl mnzx rtqp",
]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_unseen_languages_are_rejected(spark, size):
    path = f"/root/testdata/{size}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table")
    docs = spark.read.parquet(path)
    model = language.fit(docs)
    _, score, rejected = model.predict(pa.array(UNSEEN, pa.large_string()))
    assert rejected.all() and score.max() < 0.5
    assert 0.3 < model.temperature < 5 and 0 < model.reject_below < 1
    out = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held_out", language.held_out("doc_id")).toPandas()
    assert (out.lang_pred == out.lang)[out.held_out].mean() > 0.99 and out.rejected.mean() <= 0.02
    assert ((out.score >= 0) & (out.score <= 1)).all()
    assert language.keep_identified(docs, model).count() == int((~out.rejected).sum())


def test_sample_is_bounded_and_ties_are_defined(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 5)
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, labels: seen.append((texts, labels)))
    rows = [(i, f"text {i}", "xy"[i % 2]) for i in range(200)] + [(400 + i, "w" * 3000, "x") for i in range(40)] + [(3, "a text", "y"), (None, "t", "x"), (7, None, "x"), (11, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit(docs)
    texts, labels = seen.pop()
    assert len(texts) == 10 and sorted(labels) == ["x"] * 5 + ["y"] * 5
    # the first by the hash of the id, whatever the salt
    ids = docs.where(~language.held_out("doc_id") & F.col("lang").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("lang")).where("lang = 'x'").orderBy(F.xxhash64("doc_id")).limit(5).collect()
    by_id = {i: t for i, t, _ in rows[:240]}
    assert sorted(t for t, x in zip(texts, labels, strict=True) if x == "x") == sorted(by_id[r["doc_id"]] for r in ids)
    monkeypatch.setattr(language, "MARGIN", 0.01)  # a first bound that leaves too few
    language.fit(docs)
    assert seen.pop() == (texts, labels)
    monkeypatch.setattr(language, "SAMPLE_BYTES", 40)
    language.fit(docs)
    assert sum(map(len, seen.pop()[0])) <= 40


def test_equal_scores_go_to_the_first():
    model = language.Model(["a", "b"], np.zeros((3, language.BUCKETS)), np.zeros(3))
    best, score, _ = model.predict(pa.array(["some words", ""], pa.large_string()))
    assert best.tolist() == [0, 0] and np.allclose(score, 1 / 3)
