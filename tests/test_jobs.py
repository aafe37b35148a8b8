"""The two jobs: reruns, growing input, failures, awkward tables, and their command lines."""

import json
import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import ingest_documents as ingest
from jobs import release_corpus as release

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def put(spark, path, rows, mode="append"):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).coalesce(1).write.mode(mode).parquet(str(path))


def put_labels(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").coalesce(1).write.mode("overwrite").parquet(str(path))


def rows_of(df):
    return sorted(df.collect(), key=str)


DOCUMENTS = [(i, f"Text number {i % 40} with  some words", f"s{i % 3}") for i in range(200)] + [(300, None, "s0"), (301, "", None), (302, "one two", "s1"), (303, "TEXT NUMBER 1, with some words", "s2"), (None, "no id here at all", "s0"), (304, "long " * 50_000, "s1"), (305, "Text number 1 with some words", "s1")] + [(306, "same row twice here", "s1")] * 2
LABELS = [(i, 1, int(i % 40 < 10)) for i in range(200) if i % 5] + [(i, 0, 0) for i in (300, 301, 302, 303, 304, 306)] + [(305, 0, 1), (None, 0, 1), (2, 0, 0)]


def test_release_against_a_count_by_hand(spark, tmp_path):
    put(spark, tmp_path / "docs", DOCUMENTS)
    put_labels(spark, tmp_path / "labels", LABELS)
    args = [str(tmp_path / x) for x in ("docs", "labels", "out")]
    counts = release.release_corpus(spark, *args)
    label = {}
    for i, _, y in LABELS:
        if i is not None:
            label[i] = min(y, label.get(i, y))
    groups = defaultdict(list)
    for i, t, s in DOCUMENTS:
        plain = " ".join((t or "").split()).lower()
        if i in label and len(plain.split()) >= 3:
            groups[plain].append((i, s or "unknown", label[i]))
    clean = {k: v for k, v in groups.items() if len({y for _, _, y in v}) == 1}
    got = {" ".join(r.text.split()).lower(): r for r in release.read_corpus(spark, args[2]).collect()}
    assert got.keys() == clean.keys() and counts["conflicts"] == len(groups) - len(clean) > 0
    assert all((r.doc_id, r.n_records, r.source_datasets, r.label) == (min(i for i, _, _ in clean[k]), len(clean[k]), ";".join(sorted({s for _, s, _ in clean[k]})), clean[k][0][2]) for k, r in got.items())
    split_of = defaultdict(set)
    for r in got.values():
        split_of[r.cluster_id].add(r.split)
    assert all(len(v) == 1 for v in split_of.values()) and {r.split for r in got.values()} <= {"train", "val", "test"}
    assert counts["read"] == len(DOCUMENTS) and sum(v for k, v in counts.items() if "/" in k) == len(clean)


def test_release_again_is_the_same_and_drops_what_is_stale(spark, tmp_path):
    put(spark, tmp_path / "docs", DOCUMENTS)
    put_labels(spark, tmp_path / "labels", LABELS)
    args = [str(tmp_path / x) for x in ("docs", "labels", "out")]
    first = release.release_corpus(spark, *args), rows_of(release.read_corpus(spark, args[2]))
    assert (release.release_corpus(spark, *args), rows_of(release.read_corpus(spark, args[2]))) == first
    put(spark, tmp_path / "docs", DOCUMENTS[:4], "overwrite")
    assert sum(v for k, v in release.release_corpus(spark, *args).items() if "/" in k) == release.read_corpus(spark, args[2]).count() <= 4


def test_release_of_nothing(spark, tmp_path):
    put(spark, tmp_path / "docs", [])
    put_labels(spark, tmp_path / "labels", [])
    counts = release.release_corpus(spark, *[str(tmp_path / x) for x in ("docs", "labels", "out")])
    assert counts == {"read": 0, "kept": 0, "without_label": 0, "too_short": 0, "conflicts": 0}
    assert release.read_corpus(spark, str(tmp_path / "out")).count() == 0


def state(spark, out):
    return rows_of(ingest.read_catalogue(spark, str(out)))


def catalogue_by_hand(documents, labels):
    label = {}
    for i, _, y in labels:
        if i is not None:
            label[i] = min(y, label.get(i, y))
    groups = defaultdict(list)
    for i, t, s in documents:
        if plain := " ".join((t or "").split()).lower():
            groups[plain].append((i, s or "unknown", label.get(i)))
    known = lambda v: sorted({y for _, _, y in v} - {None})
    return Counter((min((i for i, _, _ in v if i is not None), default=None), tuple(known(v)), len(v), ";".join(sorted({s for _, s, _ in v})), len(known(v)) > 1) for v in groups.values())


def as_counter(spark, out):
    return Counter((r.doc_id, tuple(r.labels), r.n_records, r.source_datasets, r.conflict) for r in ingest.read_catalogue(spark, str(out)).collect())


def test_ingest_of_growing_input(spark, tmp_path):
    put_labels(spark, tmp_path / "labels", LABELS)
    args = [str(tmp_path / x) for x in ("docs", "labels", "out", "checkpoint")]
    put(spark, tmp_path / "docs", DOCUMENTS[:90])
    assert ingest.ingest_documents(spark, *args) == {"batches": 1, "documents": 90}
    assert as_counter(spark, args[2]) == catalogue_by_hand(DOCUMENTS[:90], LABELS)
    before = state(spark, args[2])
    assert ingest.ingest_documents(spark, *args) == {"batches": 0, "documents": 0}
    assert state(spark, args[2]) == before
    put(spark, tmp_path / "docs", DOCUMENTS[90:])
    assert ingest.ingest_documents(spark, *args) == {"batches": 1, "documents": len(DOCUMENTS) - 90}
    assert as_counter(spark, args[2]) == catalogue_by_hand(DOCUMENTS, LABELS)
    # The same files all at once give the same catalogue.
    ingest.ingest_documents(spark, args[0], args[1], str(tmp_path / "out2"), str(tmp_path / "checkpoint2"), {"max_files_per_batch": 1})
    assert state(spark, tmp_path / "out2") == state(spark, args[2])
    assert any(r.conflict for r in state(spark, args[2]))


def test_only_touched_buckets_are_written(spark, tmp_path):
    put_labels(spark, tmp_path / "labels", LABELS)
    args = [str(tmp_path / x) for x in ("docs", "labels", "out", "checkpoint")]
    put(spark, tmp_path / "docs", DOCUMENTS)
    ingest.ingest_documents(spark, *args)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "out/catalogue") for f in names if f.endswith(".parquet")}
    before = files()
    put(spark, tmp_path / "docs", [(999, "one more text", "s9")])
    ingest.ingest_documents(spark, *args)
    gone = {os.path.dirname(f) for f in before - files()}
    assert len(gone) <= 1 and len(files() & before) >= len(before) - 1


def test_a_batch_that_failed_is_taken_again(spark, tmp_path, monkeypatch):
    put_labels(spark, tmp_path / "labels", LABELS)
    args = [str(tmp_path / x) for x in ("docs", "labels", "out", "checkpoint")]
    put(spark, tmp_path / "docs", DOCUMENTS[:100])
    ingest.ingest_documents(spark, *args)
    put(spark, tmp_path / "docs", DOCUMENTS[100:])
    whole = ingest.catalogue
    monkeypatch.setattr(ingest, "catalogue", lambda ledger: 1 / 0)  # after the ledger and the counters were written
    with pytest.raises(Exception, match="division"):
        ingest.ingest_documents(spark, *args)
    monkeypatch.setattr(ingest, "catalogue", whole)
    assert ingest.ingest_documents(spark, *args)["documents"] == len(DOCUMENTS) - 100
    assert as_counter(spark, args[2]) == catalogue_by_hand(DOCUMENTS, LABELS)
    batch = spark.read.parquet(args[0])
    ingest.take_batch(batch, 5, args[1], args[2], ingest.load_config())
    once = state(spark, args[2])
    ingest.take_batch(batch, 5, args[1], args[2], ingest.load_config())
    assert state(spark, args[2]) == once


def test_ingest_of_nothing(spark, tmp_path):
    put(spark, tmp_path / "docs", [(1, None, None), (2, " ", "s")])
    put_labels(spark, tmp_path / "labels", [])
    args = [str(tmp_path / x) for x in ("docs", "labels", "out", "checkpoint")]
    assert ingest.ingest_documents(spark, *args) == {"batches": 1, "documents": 2}
    assert ingest.read_catalogue(spark, args[2]).count() == 0


def test_settings_stay(spark, tmp_path):
    put(spark, tmp_path / "docs", DOCUMENTS[:5])
    put_labels(spark, tmp_path / "labels", LABELS)
    before = dict(spark.conf.getAll)
    ingest.ingest_documents(spark, *[str(tmp_path / x) for x in ("docs", "labels", "out", "checkpoint")])
    release.release_corpus(spark, *[str(tmp_path / x) for x in ("docs", "labels", "out1")])
    assert dict(spark.conf.getAll) == before


def test_command_line(spark, tmp_path):
    put(spark, tmp_path / "docs", DOCUMENTS)
    put_labels(spark, tmp_path / "labels", LABELS)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({**release.load_config(), "splits": ["a", "b", "c"]}))
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    run = subprocess.run([sys.executable, f"{ROOT}/jobs/release_corpus.py", "--documents", str(tmp_path / "docs"), "--labels", str(tmp_path / "labels"), "--output", str(tmp_path / "out"), "--config", str(config)], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert f"read {len(DOCUMENTS)} documents" in run.stderr
    assert {r.split for r in release.read_corpus(spark, str(tmp_path / "out")).select("split").distinct().collect()} <= {"a", "b", "c"}


def test_release_normalises_each_text_once(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "docs", DOCUMENTS)
    put_labels(spark, tmp_path / "labels", LABELS)
    seen, plain = spark.sparkContext.accumulator(0), release.normalize_whitespace

    def counted(text):
        def told(t):
            seen.add(1)
            return t

        return plain(F.udf(told, "string")(text))

    monkeypatch.setattr(release, "normalize_whitespace", counted)
    counts = release.release_corpus(spark, *[str(tmp_path / x) for x in ("docs", "labels", "out")])
    assert counts["read"] == len(DOCUMENTS) and seen.value <= len(DOCUMENTS)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
