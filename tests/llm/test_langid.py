"""Language mixtures: held-out accuracy, mixtures, odd texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelflight.llm import langid
from tests.llm.helpers import by_id, docs_of

LABELLED = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = by_id(langid.identify(docs), "held_out", "lang_pred", "score")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, (h, _, _) in found.items())
    held = [d for d, (h, _, _) in found.items() if h]
    assert len(held) > 200
    assert np.mean([found[d][1] == truth[d] for d in held]) >= 0.98
    assert all(0 <= s <= 1 for _, _, s in found.values())


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.learn(langid._training(docs, "doc_id", "text", "lang"))


def test_mixtures_are_told_apart(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 1500")
    texts = {r.lang: r.text[:1500] for r in docs.orderBy("doc_id").collect()}
    for a, b in (("en", "fr"), ("de", "es")):
        lang, score, found, gain = model.classify(texts[a][:1400] + "\n" + texts[b][:600])
        assert lang == a and set(found) == {a, b} and 0.5 < score < 0.9 and gain > 0
        assert abs(sum(found.values()) - 1) < 1e-9


def test_noise_is_no_language(model):
    draw = random.Random(6)
    noise = "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(500))
    assert model.classify(noise)[3] < 0 < model.classify("the of and that with")[3]


def test_more_text_of_a_kind_changes_little(model, monkeypatch):
    text = "the reand of thatsh " * 40
    plain = model.classify(text)
    monkeypatch.setattr(langid, "PIECE", 100)
    weighted = model.classify(text)
    assert plain[0] == weighted[0] and abs(plain[1] - weighted[1]) < 1e-9


def test_prediction_uses_the_text_alone(spark, model):
    rows = [(i, "und der ie das des sich dieenheit " * 5, lang) for i, lang in enumerate(["en", None, "de", "fr"])]
    found = langid.identify(docs_of(spark, rows, LABELLED), model=model).collect()
    assert len({(r.lang_pred, r.score) for r in found}) == 1


def test_edge_cases(spark):
    rows = [
        (i, t, lang) for i, (t, lang) in enumerate([
            ("alpha beta gamma", "x"), ("uno dos tres", "y"), ("alpha gamma", "x"), ("dos uno", "y"),
            (None, "x"), ("", None), ("12 !?", None), ("alpha", None), ("É", None), ("dos tres " * 400_000, None),
        ] * 2)
    ] + [(None, "alpha beta", "x")]
    docs = docs_of(spark, rows, LABELLED).selectExpr("*", "1 as bucket", "2 as score")
    found = langid.identify(docs).collect()
    assert len(found) == len(rows)
    pred = {r.doc_id: r for r in found}
    assert all(pred[i].lang_pred == "und" and pred[i].score == 0 for i in (4, 5, 6))
    assert pred[7].lang_pred == "x" and pred[9].lang_pred == "y" and pred[None].lang_pred == "x"
    assert pred[8].lang_pred in ("x", "y")
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 8  # the lone accent is unknown
    assert langid.identify(docs_of(spark, [], LABELLED)).count() == 0
    unlabelled = docs_of(spark, [(1, "some text", None)], LABELLED)
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_counts_cover_all_rows(spark):
    draw = random.Random(1)
    rows = [(draw.choice("ab"), "".join(draw.choices("xyz ", k=30)).encode()) for _ in range(200)]
    found = langid.trigram_counts(spark.createDataFrame(rows, "lang string, text binary").repartition(7))
    total = {r.lang: r.n for r in found.groupBy("lang").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    for lang in "ab":
        # joined texts of one task share a separating space; trigrams differ at most there
        expected = sum(len(langid.trigrams(t.decode())) for name, t in rows if name == lang)
        assert abs(total[lang] - expected) <= 2 * 200


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [(i, "abc", str(i)) for i in range(20)]
    with pytest.raises(ValueError):
        langid.identify(docs_of(spark, rows, LABELLED))


def test_rejection_does_not_follow_the_size_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = langid._training(docs, "doc_id", "text", "lang")
    languages, counts = ["de", "en", "es", "fr"], np.zeros((langid.BUCKETS, 4))
    for r in langid.trigram_counts(labelled.where("lang is not null")).collect():
        counts[r.bucket, languages.index(r.lang)] += r.n
    noise = "".join(chr(random.Random(6).randrange(0x4E00, 0x9FFF)) for _ in range(500))
    gains = []
    for times in (1, 300):
        model = langid.LanguageModel(languages, counts * times, langid.BACKGROUND)
        for text in ("Try our new chocolate pudding recipe", "Please keep your ticket with you because"):
            lang, _, _, gain = model.classify(text)
            assert gain > 0
            gains.append(gain)
        assert model.classify(noise)[3] < 0
    assert np.allclose(gains[:2], gains[2:])


def test_stage_keeps_a_clean_sentence_of_new_words_in_a_large_corpus(spark, monkeypatch):
    rows = [(i, "our new recipe is the best of the year and try it", "en") for i in range(8)]
    rows += [(100, "try our pudding recipe", None)]
    docs, counted = docs_of(spark, rows, LABELLED), langid.trigram_counts
    monkeypatch.setattr(langid, "trigram_counts", lambda x: counted(x).selectExpr("lang", "bucket", "n * 1000000 as n"))
    assert 100 in {r.doc_id for r in langid.in_known_language(docs).collect()}


def test_counts_do_not_follow_the_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    labelled = docs.where("lang is not null").select("lang", F.col("text").cast("binary").alias("text"))
    found = [
        sorted(map(tuple, langid.trigram_counts(labelled.repartition(n)).collect())) for n in (1, 7, 50)
    ]
    assert found[0] == found[1] == found[2]
