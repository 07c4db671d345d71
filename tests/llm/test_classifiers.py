import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import quality_mil, toxicity
from shelfmark.llm.learning import best_cut, class_weights, in_training, labelled_sample


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    syllables = "an er th in ou re st ha ti on".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.randint(60, 300))]
        toxic, bad = int(i % 5 == 0), int(i % 4 == 0)
        if toxic:
            for _ in range(max(3, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["vilefoo", "grubble", "zonkhead"])
        if bad:
            at = rng.randrange(len(words) // 2)
            words[at : at + 40] = [w + "###" for w in words[at : at + 40]]
        rows.append((i, " ".join(words), toxic, 1 - bad))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int").cache()


def auc(rows, label, score):
    pos = [r[score] for r in rows if r[label] == 1]
    neg = [r[score] for r in rows if r[label] == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def held_out(labelled, model, column, label, cut):
    rows = labelled.where(~in_training("doc_id")).select(label, column(F.col("text"), model).alias("score")).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert auc(rows, label, "score") > 0.97
    assert np.mean([(r.score >= cut) == (r[label] == 1) for r in rows]) > 0.93


def test_toxicity_on_held_out_rows(labelled):
    train = labelled.where(in_training("doc_id"))
    held_out(labelled, toxicity.fit_toxicity(labelled, train.select("doc_id", "toxic")), toxicity.toxicity, "toxic", 0.5)


def test_quality_on_held_out_rows(labelled):
    train = labelled.where(in_training("doc_id"))
    held_out(labelled, quality_mil.fit_quality(labelled, train.select("doc_id", "quality")), quality_mil.quality, "quality", 0.3)


def test_odd_texts_are_scored(documents, labelled):
    train = labelled.select("doc_id", "text", "toxic", "quality")
    for model, column in ((toxicity.fit_toxicity(train, train), toxicity.toxicity), (quality_mil.fit_quality(train, train), quality_mil.quality)):
        scores = [r.s for r in documents.select(column(F.col("text"), model).alias("s")).collect()]
        assert len(scores) == documents.count() and all(0 <= s <= 1 for s in scores)
        assert documents.where("false").select(column(F.col("text"), model).alias("s")).count() == 0


def test_clashing_names_and_very_long_texts(spark, labelled):
    docs = labelled.select(F.col("doc_id").alias("label"), F.col("text").alias("score"), "toxic", "quality")
    train = docs.select("label", "toxic", "quality")
    long = "word idiot ### " * 60_000
    for fit, column in ((toxicity.fit_toxicity, toxicity.toxicity), (quality_mil.fit_quality, quality_mil.quality)):
        model = fit(docs.withColumnRenamed("label", "ident"), train.withColumnRenamed("label", "ident"), "ident", "score")
        rows = spark.createDataFrame([(1, long)], "score int, text string").select("score", column(F.col("text"), model).alias("s")).collect()
        assert rows[0].score == 1 and 0 <= rows[0].s <= 1


def test_a_sample_leaves_out_texts_beyond_its_bound(labelled):
    sample, _ = labelled_sample(labelled, labelled.select("doc_id", "toxic"), "doc_id", "text", "toxic", 10, 20, longest=600)
    assert 0 < len(sample) < 30 and all(len(t) <= 600 for t, _ in sample)


def test_without_labels_or_with_one(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(3, 1, 1), (4, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, toxic int, quality int")
    assert toxicity.score_text("x", toxicity.fit_toxicity(documents, none)) == 0.0
    assert quality_mil.score_text(None, quality_mil.fit_quality(documents, one)) == 1.0
    assert toxicity.drop_toxic(documents, toxicity.fit_toxicity(documents, none)).count() == documents.count()


def test_sample_is_bounded_and_counts_are_whole(labelled):
    sample, counts = labelled_sample(labelled, labelled.select("doc_id", "toxic"), "doc_id", "text", "toxic", 10, 20)
    assert sorted(y for _, y in sample) == [0] * 20 + [1] * 10
    assert counts == {0: 720, 1: 180}
    y = np.array([y for _, y in sample])
    assert class_weights(y, counts)[y == 1].sum() / 30 == pytest.approx(0.2)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 6), quality_mil.N_FEATURES)) for _ in range(60)]
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    p, _, _, out = quality_mil.train(bags, y, np.ones(60), steps=400)
    assert ((out > 0) == (y == 1)).mean() > 0.95


def test_best_cut():
    assert best_cut(np.array([0.1, 0.9, 0.8, 0.2]), np.array([0, 1, 1, 0]), np.ones(4)) == pytest.approx(0.5)
