"""Searches that are resumed, sequences in stretches, and the queries of plans/saved.py on small tables."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import evidential
from tessera.sources import papers


def _service(pages, log, fails_at=None):
    """Answers from pages (name: lists of ids); each question is a line in the log, one of them fails."""

    def answer(request, cursor, size):
        n = 0 if cursor == "*" else int(cursor)
        with open(log, "a") as f:
            f.write(f"{request} {n} {size}\n")
        if fails_at == (request, n):
            raise OSError("no route")
        found = pages[request]
        return {"resultList": {"result": [{"id": i, "pubYear": 2020} for i in found[n]]} if n < len(found) else {}, "nextCursorMark": str(n + 1) if n < len(found) else None}

    return answer


def _rows(df):
    return sorted((r.search, r.nth, r.page, r.id) for r in df.collect())


def test_searches_go_on_where_they_broke_off(spark, tmp_path):
    pages = {"a": [[1, 2, 3], [4, 5, 6], [7]], "b": [[8, 9]], "c": []}
    searches = spark.createDataFrame([("a", "a"), ("a", "a"), ("b/ä", "b"), ("none", "c"), (None, "a"), ("d", None)], "search string, request string")
    saved, log = f"file://{tmp_path}/saved", str(tmp_path / "log")
    with pytest.raises(Exception, match="no route"):
        papers.searched(searches, _service(pages, log, ("a", 2)), saved, page_size=3).collect()
    asked = open(log).read().split("\n")
    assert "a 0 3" in asked and "a 1 3" in asked
    open(log, "w").close()
    want = sorted([("a", i, i // 3, str(i + 1)) for i in range(7)] + [("b/ä", 0, 0, "8"), ("b/ä", 1, 0, "9")])
    assert _rows(papers.searched(searches, _service(pages, log), saved, page_size=3)) == want
    again = open(log).read().split("\n")
    assert "a 0 3" not in again and "a 1 3" not in again and again.count("a 2 3") == 1
    # Saved pages are not asked for, even where the service would now say something else; ends are.
    changed = {"a": [[0]], "b": [[0], [10]], "c": [[11]]}
    assert _rows(papers.searched(searches, _service(changed, log), saved, page_size=3)) == sorted([*want, ("b/ä", 2, 1, "10"), ("none", 0, 0, "11")])
    assert not [p for p in (tmp_path / "saved").rglob("*") if p.name.endswith(".part")]


def test_searches_stop_at_the_most(spark, tmp_path):
    pages = {"a": [[1, 2, 3], [4, 5, 6], [7]]}
    searches = spark.createDataFrame([("a", "a")], "search string, request string")
    saved, log = f"file://{tmp_path}/saved", str(tmp_path / "log")
    few = papers.searched(searches, _service(pages, log), saved, most=4, page_size=3)
    assert [r[3] for r in _rows(few)] == ["1", "2", "3", "4"]
    assert [r[3] for r in _rows(papers.searched(searches, _service(pages, log), saved, most=50, page_size=3))] == [str(i) for i in range(1, 8)]
    assert [r[3] for r in _rows(papers.searched(searches, _service(pages, log), saved, most=2, page_size=3))] == ["1", "2"]
    assert papers.searched(searches.limit(0), _service(pages, log), saved).count() == 0


def test_sequences_in_stretches_equal_the_whole(spark):
    r = np.random.default_rng(3)
    weights = {"embedding": r.normal(size=(5, 3)), "kernels": [(r.normal(size=(w, 3, 2)), r.normal(size=2)) for w in (3, 5, 7)], "head": [(r.normal(size=(6, 2)), r.normal(size=2))]}
    texts = ["".join(r.choice(list("ABCDé"), n)) for n in (0, 1, 2, 6, 7, 8, 13, 40, 41, 100)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    found = lambda **o: {x.id: x.prediction.alphas for x in evidential.encode_batches(df, "s", weights, "ABCD", **o).collect()}
    whole, cut = found(), found(rows=3, stretch=7)
    for i, text in enumerate(texts):
        tokens = np.array([["ABCD".find(c) + 1 for c in text or "x"]])
        f = evidential.conv_encoder(tokens, np.array([len(text or "")]), weights["embedding"], weights["kernels"])
        z = evidential.mlp(weights["head"])(np.where(np.isfinite(f), f, 0.0))[0]
        want = np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) + 1
        assert np.allclose(whole[i], want, rtol=1e-12) and np.allclose(cut[i], want, rtol=1e-12)


def test_queries_on_small_tables(spark, tmp_path):
    """Nulls, empty and long texts, and tables without rows."""
    import __spark_entry__ as entry

    docs = [(1, "ACD", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (600, "k" * 50_000 + "ACDW", "de", "b|c")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/in/documents.parquet")
    pages = [(i, "u", h) for i, h in enumerate(["<html>x", "<p>y", "z", "w" * 30_000, None, "gone", "busy", None, "", "", "t"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/in/pages.parquet")
    run = lambda name: entry.queries()[name](spark, f"{tmp_path}/in").collect()
    assert {(r.search, r.id) for r in run("s21_paged_searches")} == {("a-0", "1"), ("none-0", "2"), ("a-0", "3"), ("b|c-0", "600")}
    status = {r.page_id: r.status for r in run("s24_downloads")}
    assert status == {0: "stored", 1: "not_pdf", 2: "not_file", 3: "too_large", 4: "stored", 5: "http_error", 6: "stored", 7: "stored", 8: "empty_response", 9: "empty_response", 10: "stored"}
    text = "\n".join(r.text for r in sorted(run("k9_report")))
    assert "- Texts: 4" in text and "| x\\|b\\|c | 1 |" in text and "| x\\| | 1 |" in text
    assert {r.doc_id for r in run("n1_sequence_model")} == {1, 2, 3, 600}
    spark.read.parquet(f"{tmp_path}/in/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert entry.queries()["s21_paged_searches"](spark, f"{tmp_path}/empty").count() == 0
    assert entry.queries()["n1_sequence_model"](spark, f"{tmp_path}/empty").count() == 0


def test_the_made_service_keeps_no_urls():
    from tessera.plans.saved import _service

    fetch = _service()
    urls = [f"6,{base64.b64encode(bytes([i]) * 3000).decode()}" for i in range(50)]
    assert [fetch(u).status for u in urls] == [429] * 50
    kept = fetch.__closure__[0].cell_contents
    assert sum(map(len, kept)) <= 50 * 32
    assert [fetch(u).status for u in urls] == [200] * 50 and not kept


def test_saved_pages_are_json(spark, tmp_path):
    searches = spark.createDataFrame([("../x y", "a")], "search string, request string")
    papers.searched(searches, _service({"a": [[1]]}, str(tmp_path / "log")), f"file://{tmp_path}/saved").collect()
    assert json.loads((tmp_path / "saved" / "search-..%2Fx%20y" / "000000.json").read_text())["nextCursorMark"] == "1"


def test_damaged_supplements_are_told(spark, tmp_path):
    import io
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.csv", "x,y\n1,2\n")
        z.writestr("b.xlsx", "no workbook")
        z.writestr("c.bin", "other")
        z.writestr("d.csv", "0123456789" * 20)
    broken = packed.getvalue().replace(b"0123456789" * 20, b"0123456789" * 19 + b"0123456780")  # its checksum is wrong
    for name, data in {"p.zip": broken, "q.docx": b"PK", "r.csv": b"k\n", "s.bin": b"?", "t.zip": b"PK cut"}.items():
        (tmp_path / "doc1").mkdir(exist_ok=True)
        (tmp_path / "doc1" / name).write_bytes(data)
    told = {r.table_id: (r.problem or "").partition(":")[0] for r in papers.read_supplements(spark, str(tmp_path), damaged=True).collect()}
    assert told == {"p.zip/a.csv": "", "p.zip/b.xlsx": "BadZipFile", "p.zip/d.csv": "BadZipFile", "q.docx": "BadZipFile", "r.csv": "", "t.zip": "BadZipFile"}
    plain = papers.read_supplements(spark, str(tmp_path))
    assert "problem" not in plain.columns and {r.table_id for r in plain.collect()} == {"p.zip/a.csv", "r.csv"}
