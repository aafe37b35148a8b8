"""The samples of the toxicity classifier stay bounded whatever ids repeat."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxic int, mark long, id string"
LABELS = "doc_id long, quality int, toxic int"


def made():
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    docs = [(i, " ".join(r.choice(words) for _ in range(20)) + (" vile slur" if i % 5 == 0 else ""), "en", "s", 0, 9, 9, "x") for i in range(300)]
    return docs, [(i, 1, int(i % 5 == 0)) for i in range(300)]


def trained_rows(spark, monkeypatch, docs, labels, **options):
    """Rows of each class that reach the fit."""
    from tessera.llm import toxicity

    seen = {}
    whole = toxicity.fit_nnpu

    def fit(positive, unlabelled, *args, **more):
        seen.update(positive=len(positive), unlabelled=len(unlabelled))
        return whole(positive, unlabelled, *args, **more)

    monkeypatch.setattr(toxicity, "fit_nnpu", fit)
    toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), fold=None, **options)
    return seen


def test_an_id_of_many_rows_stays_within_the_bounds(spark, monkeypatch):
    docs, labels = made()
    many = [(7, f"row {k} under one id", "en", "s", 0, 0, 0, "x") for k in range(3000)] + [(10, f"vile slur {k}", "en", "s", 0, 0, 0, "x") for k in range(3000)]
    seen = trained_rows(spark, monkeypatch, docs + many, labels, unlabelled=50, positives=20)
    assert 0 < seen["unlabelled"] <= 50 and 0 < seen["positive"] <= 20


def test_same_row_many_times(spark, monkeypatch):
    docs, labels = made()
    seen = trained_rows(spark, monkeypatch, docs + [(5, "vile slur again", "en", "s", 0, 0, 0, "x")] * 2000, labels, unlabelled=60, positives=30)
    assert 0 < seen["unlabelled"] <= 60 and 0 < seen["positive"] <= 30


def test_unique_ids_are_sampled_as_by_id(spark, monkeypatch):
    docs, labels = made()
    assert trained_rows(spark, monkeypatch, docs, labels, unlabelled=100, positives=25) == {"positive": 25, "unlabelled": 100}


def test_scores_with_clashing_columns(spark):
    from tessera.llm.toxicity import toxicity

    docs, labels = made()
    got = toxicity(spark.createDataFrame([*docs, (None, None, None, None, None, None, None, None)], DOCS), spark.createDataFrame(labels, LABELS), fold=None).withColumn("y", F.col("doc_id") % 5 == 0)
    assert got.count() == 301 and got.where("y AND predicted = 1").count() > 50
