"""Bounded retrieval against the join over all postings."""

import random

import pytest

from pyspark.sql import functions as F
from tessera.operators import grams, retrieval


def texts(n=160, seed=3):
    """Texts over a small alphabet, so that most grams are frequent; families of near texts, equal ones, empty and null ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 7)))
    common, rows = [word() for _ in range(30)], []
    for i in range(n):
        own = [word() for _ in range(12)]
        base = [r.choice(common) if r.random() < 0.6 else r.choice(own) for _ in range(r.randrange(5, 60))]
        rows.append(" ".join(base))
        if i % 4 == 0:
            rows += [" ".join(base[:-1] + [word()]), " ".join(base[1:])]
        if i % 10 == 0:
            rows.append(" ".join(base))
    rows += ["", None, "ab", "zzzzzzzz qqqqqq", "zzzzzzzz qqqqqq"]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def corpus(spark):
    frame = spark.createDataFrame(texts(), "id long, text string")
    keys = frame.select("id", F.sha1(F.col("text").cast("binary")).alias("key"))
    postings, _ = grams.tfidf_index(grams.gram_counts(frame, "id", "text"), frame.agg(F.count("*").alias("n")))
    return postings.cache(), keys


def rows_of(df):
    return sorted((r.query, r.neighbour, round(r.similarity, 7), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 40])
def test_same_rows_as_the_whole_join(corpus, k):
    postings, keys = corpus
    queries = postings.where("id % 3 = 0")
    read = {}
    got = rows_of(retrieval.bounded_knn(queries, retrieval.build_index(postings), k, same=keys, read=read))
    assert got == rows_of(grams.knn(queries, postings, k, same=keys))
    assert 0 < read["read"] <= read["postings"]
    if k == 1:
        assert read["read"] < read["postings"]  # frequent grams were left alone


def test_own_id_and_equal_texts_may_count(corpus):
    postings, _ = corpus
    queries = postings.where("id < 30")
    index = retrieval.build_index(postings)
    assert rows_of(retrieval.bounded_knn(queries, index, 4, exclude_same_id=False)) == rows_of(grams.knn(queries, postings, 4, exclude_same_id=False))
    assert rows_of(retrieval.bounded_knn(queries, index, 4)) == rows_of(grams.knn(queries, postings, 4))


def test_work_settings_change_no_row(corpus, monkeypatch):
    postings, keys = corpus
    queries, index = postings.where("id % 7 = 0"), retrieval.build_index(postings)
    want = rows_of(grams.knn(queries, postings, 3, same=keys))
    for texts_a_gram, seeds in ((1, 1), (3, 2), (10_000, 50)):
        monkeypatch.setattr(retrieval, "SEED_TEXTS", texts_a_gram)
        monkeypatch.setattr(retrieval, "SEEDS", seeds)
        assert rows_of(retrieval.bounded_knn(queries, index, 3, same=keys)) == want


def test_no_queries_and_no_texts(spark, corpus):
    postings, _ = corpus
    none = postings.where("id < 0")
    assert retrieval.bounded_knn(none, retrieval.build_index(postings)).count() == 0
    assert retrieval.bounded_knn(postings, retrieval.build_index(none)).count() == 0


def test_a_stored_index_is_not_moved(spark, corpus, tmp_path):
    """Lookups of a new batch of queries exchange the queries alone; the index is read in its buckets."""
    from tessera.sources import sinks

    postings, keys = corpus
    frame = spark.createDataFrame(texts(), "id long, text string")
    _, idf = grams.tfidf_index(grams.gram_counts(frame, "id", "text"), frame.agg(F.count("*").alias("n")))
    path = str(tmp_path / "an index")
    sinks.save_search_index(postings, idf, path, 6)
    held, held_idf = sinks.open_search_index(spark, path)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, postings.collect())) and held_idf.count() == idf.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries = spark.createDataFrame([("abc", 1, 0.5), ("bcd", 1, 0.5)], "gram string, q long, qw double")
        plan = queries.join(held, "gram")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "Bucketed: true" in line)
    assert "SelectedBucketsCount: 6 out of 6" in scan
    assert plan.count("Exchange hashpartitioning") == 1  # of the queries
    assert rows_of(grams.knn(postings.where("id % 9 = 0"), held, 4, same=keys)) == rows_of(grams.knn(postings.where("id % 9 = 0"), postings, 4, same=keys))
    with pytest.raises(Exception, match="exist"):
        sinks.save_search_index(postings, idf, path, 6)
