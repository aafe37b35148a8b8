"""Readers and writers on small files, and streams on a folder of events."""

import datetime
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators.similarity import parse_clusters
from tessera.sources import papers, records, sinks
from tessera.streaming import events


def test_fasta_split_anywhere(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"lost text\nmore\n>pos_1 x > y|1\nAC\nDE\r\n\n>neg2|0\nKK \xff\n>other\n" + b"".join(b">n%d|1\n%s\n" % (i, b"A" * i) for i in range(50)))
    for split in (7, 64, 10_000):
        got = records.read_records(spark, str(tmp_path), split).collect()
        assert len(got) == 53 and len({r.offset for r in got}) == 53
    f = records.read_fasta(spark, str(tmp_path))
    first = f.orderBy("offset").limit(3).select("header", "sequence", records.LABELS["prefix"](F.col("header")).alias("p"), records.LABELS["suffix"](F.col("header")).alias("s")).collect()
    assert [tuple(r) for r in first] == [("pos_1 x > y|1", "ACDE", 1, 1), ("neg2|0", "KK", 0, 0), ("other", "", None, None)]


def test_sources_by_rule(spark, tmp_path):
    (tmp_path / "l.fa").write_text(">id1 1\nAC\n>id2 0\nKK\n>id3 x\nKK\n")
    (tmp_path / "c.csv").write_text("sequence,label\nACD,1\nKK,0\n")
    spec = lambda name, rule: {"dataset_id": name, "project": "p", "level": "l", "split": "s", "file_path": str(tmp_path / name), "label_rule": rule}
    got = records.load_sources(spark, [spec("l.fa", "last_token"), spec("c.csv", "csv"), spec("l.fa", "constant:1")]).collect()
    assert [(r.sequence, r.label, r.source_id) for r in got][:5] == [("AC", 1, "id1"), ("KK", 0, "id2"), ("KK", None, "id3"), ("ACD", 1, "row_0"), ("KK", 0, "row_1")]
    with pytest.raises(ValueError):
        records.load_source(spark, spec("l.fa", "guess"))
    (tmp_path / "bad.csv").write_text("sequence,label\nA,7\n")
    with pytest.raises(PySparkException, match="label is not"):
        records.read_labelled_csv(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError, match="label"):
        records.require_columns(spark.range(1), "label")


def test_alignment_and_clusters(spark, tmp_path):
    (tmp_path / "x.a3m").write_text(">q\nAC.D*\n>h1\nACaa-\n>h2\nAB-Z\n>h3\nA\n")
    got = records.read_alignment(spark, str(tmp_path / "x.a3m")).orderBy("row").collect()
    assert [(r.row, r.aligned) for r in got] == [(0, "AC-D"), (2, "A---")] or [(r.row, r.aligned) for r in got] == [(0, "AC-D"), (2, "A--" + "-")]
    (tmp_path / "y.clstr").write_text(">Cluster 0\n0\t12aa, >a_1... *\n1\t11aa, >b_2... at 95%\n>Cluster 1\n0\t9aa, >c... *\n")
    c = parse_clusters(records.read_records(spark, str(tmp_path / "y.clstr"))).collect()
    assert {(r.cluster_id, r.seq_id, r.is_representative) for r in c} == {("0", "a_1", True), ("0", "b_2", False), ("1", "c", True)}


def test_identifiers_and_links(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# no\n\nPMC12\n123\n10.1000/ab\nhttps://doi.org/10.1000/cd\nhttp://x.org/a\n2101.00001\n?\n")
    assert [(r.kind, r.value) for r in papers.read_identifiers(spark, str(tmp_path / "ids.txt")).collect()] == [("pmcid", "PMC12"), ("pmid", "123"), ("doi", "10.1000/ab"), ("doi", "10.1000/cd"), ("url", "http://x.org/a"), ("arxiv", "2101.00001"), ("unknown", "?")]
    html = '<a class=x href="s1.pdf?x=1">a</a> <a href="/suppl/t">b</a> <A HREF=\'//y.org/z.zip\'>c</A> <a href="#n">d</a> <a href="s1.pdf?x=1">e</a>'
    row = spark.createDataFrame([("http://x.org/d/page.html?q", html)], "u string, h string").select(papers.supplementary_links(F.col("u"), F.col("h")).alias("l"), F.size(papers.page_links(F.col("h"))).alias("n")).first()
    assert row.n == 4 and row.l == ["http://x.org/suppl/t", "http://y.org/z.zip"]
    x = '<supplementary-material><media xlink:href="a.pdf"/></supplementary-material><x xlink:href="no"/><supplementary-material><m xlink:href="a.pdf"/><m xlink:href="b"/></supplementary-material>'
    assert spark.createDataFrame([(x,)], "x string").select(papers.jats_supplements(F.col("x")).alias("y")).first().y == ["a.pdf", "b"]
    assert spark.createDataFrame([('<link href="ftp://h/pub/pmc/oa_package/1.tar.gz"/>',)], "x string").select(papers.package_url(F.col("x")).alias("y")).first().y == "https://h/pub/pmc/oa_package/1.tar.gz"
    assert spark.createDataFrame([(b"%PDF-1.4",), (b" <!DOCTYPE html>",), (b"x",)], "b binary").select(papers.sniff(F.col("b")).alias("k")).collect() == [("pdf",), ("html",), ("other",)]
    assert spark.range(1).select(papers.candidate_url(F.lit("http://a/"), F.lit("b c.pdf")).alias("u")).first().u == "http://a/b%20c.pdf"


def test_manifest(spark, tmp_path):
    rec = lambda i, ok, doi, extra=0: json.dumps({"input": i, "normalized": i, "id_type": "pmcid", "actions": [{"kind": "xml", "download": {"status": ok}, "meta": {"doi": doi}}, {"kind": "pmc_oa_package", "download": {"status": "ok"}, "extract": {"extracted_pdf": True, "extracted_supp_files": extra}}]})
    (tmp_path / "m.jsonl").write_text("\n".join([rec("PMC1", "failed", ""), "not json {", rec("PMC2", "ok", "10.1/b"), rec("PMC1", "ok", "10.1/a", 2)]))
    latest = papers.read_manifest(spark, str(tmp_path / "m.jsonl"))
    s = {r.key: r for r in papers.manifest_summary(latest).collect()}
    assert set(s) == {"PMC1", "PMC2"} and s["PMC1"].doi == "10.1/a" and s["PMC1"].xml_ok and s["PMC1"].pdf_ok and s["PMC1"].supp_ok and not s["PMC2"].supp_ok
    files = spark.createDataFrame([("PMC2", 3)], "stem string, n int")
    assert {r.key: r.supp_ok for r in papers.manifest_summary(latest, files).collect()}["PMC2"]
    cat = papers.paper_catalogue(spark.createDataFrame([("/x/PMC1.xml",), ("/x/y.txt",)], "path string"), papers.manifest_summary(latest))
    assert {r.key: r.path for r in cat.collect()} == {"PMC1": "/x/PMC1.xml", "PMC2": None}


def test_supplements(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "t.csv").write_text("id,sequence\na,NA\n")
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:tbl><w:tr><w:tc><w:p><w:t>x</w:t></w:p></w:tc><w:tc><w:t>y</w:t></w:tc></w:tr></w:tbl></w:document>')
    with zipfile.ZipFile(tmp_path / "d1" / "s.zip", "w") as z:
        z.writestr("in.fasta", ">p1\nAC\nDE\n")
        z.writestr("in.docx", doc.getvalue())
        z.writestr("deep.zip", b"PK")
    (tmp_path / "d1" / "broken.docx").write_bytes(b"no")
    got = {r.table_id: r.rows for r in papers.read_supplements(spark, str(tmp_path)).collect()}
    assert got == {"t.csv": [["id", "sequence"], ["a", "NA"]], "s.zip/in.fasta": [["id", "sequence"], ["p1", "ACDE"]], "s.zip/in.docx#table0": [["x", "y"]]}
    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as t:
        for name, size in (("a.pdf", 5), ("b.pdf", 9), ("c.csv", 1), ("d.bin", 1)):
            info = tarfile.TarInfo(name)
            info.size = size
            t.addfile(info, io.BytesIO(b"x" * size))
    assert {r.member: r.role for r in papers.archive_members(spark, str(tmp_path / "p.tar.gz")).collect()} == {"a.pdf": "supplement", "b.pdf": "main", "c.csv": "supplement", "d.bin": "other"}


def test_search_and_fetch(spark, tmp_path):
    answer = lambda *ids: json.dumps({"resultList": {"result": [{"pmcid": i, "isOpenAccess": "Y", "inPMC": "Y" if i else "N", "title": f"MIC {i}", "pubYear": "2020"} for i in ids]}})
    (tmp_path / "p1.json").write_text(answer("PMC1", "PMC2"))
    (tmp_path / "p2.json").write_text(answer("PMC2", "", "PMC3"))
    found = papers.search_results(spark, str(tmp_path), 4)
    assert found.count() == 4
    kept = papers.open_access(found.withColumn("score", F.length("title")), 5)
    assert [r.pmcid for r in kept.collect()] == ["PMC1", "PMC2"]

    pages = {"*": {"resultList": {"result": [{"id": str(i), "pmcid": f"PMC{i}"} for i in range(3)]}, "nextCursorMark": "b/2"}, "b/2": {"resultList": {"result": [{"id": "9"}]}, "nextCursorMark": "c"}, "c": {"resultList": {"result": []}, "nextCursorMark": "d"}}
    asked = []

    def ask(cursor, size):
        asked.append((cursor, size))
        return pages[cursor]

    assert [r.id for r in papers.search_rows(spark, ask, 10, 3).collect()] == ["0", "1", "2", "9"] and asked == [("*", 3), ("b/2", 3), ("c", 3)]
    assert papers.search_rows(spark, ask, 2, 100).count() == 2 and asked[-1] == ("*", 2)
    (tmp_path / "saved").mkdir()
    for cursor, page in pages.items():
        (tmp_path / "saved" / f"page-{papers.quote(cursor, safe='')}.json").write_text(json.dumps(page))
    assert papers.search_rows(spark, papers.saved_answers(str(tmp_path / "saved"))).count() == 4


def test_open_access_keeps_the_best_row(spark):
    rows = [("PMC1", "Y", "Y", 3, "2020", "a"), ("PMC1", "Y", "Y", 7, "2021", "b"), ("PMC1", "y", "Y", 7, "2019", "c"), ("PMC2", "Y", "Y", 9, None, "d"), ("PMC3", "N", "Y", 10, "2020", "e"), ("", "Y", "Y", 10, "2020", "f")]
    df = spark.createDataFrame(rows, "pmcid string, isOpenAccess string, inPMC string, score int, pubYear string, title string")
    assert [r.title for r in papers.open_access(df).collect()] == ["d", "c"] and [r.title for r in papers.open_access(df, 1).collect()] == ["d"]


def test_downloads(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "have.pdf").write_bytes(b"old")
    (tmp_path / "tries").mkdir()
    count = str(tmp_path / "tries")

    def fetch(url):
        import os
        import uuid

        kind, _, name = url.partition(":")
        open(os.path.join(count, f"{name}-{uuid.uuid4().hex}"), "w").close()
        tried = sum(f.startswith(f"{name}-") for f in os.listdir(count))
        if kind == "broken":
            raise OSError("no route")
        if kind == "busy" and tried < 3:
            return papers.Answer(503 if tried == 1 else 429, {}, [])
        bodies = {"pdf": [b"%PDF-1", b"", b".4 body"], "busy": [b"%PDF x"], "html": [b" <!DOCTYPE html><p>"], "none": [], "gone": [b"x"], "big": [b"x" * 60] * 3, "said": [b"x"], "text": [b"<article/>"]}
        return papers.Answer(404 if kind == "gone" else 200, {"content-length": "999"} if kind == "said" else {"content-type": "text/html"} if kind == "html" else {}, bodies[kind])

    asked = [("a", "pdf:a", "a.pdf", "pdf"), ("b", "pdf:b", "have.pdf", "pdf"), ("c", "busy:c", "c.pdf", "pdf"), ("d", "html:d", "d.pdf", "pdf"), ("e", "html:e", "e.zip", "binary"), ("f", "none:f", "f.pdf", "pdf"), ("g", "gone:g", "g.pdf", "pdf"), ("h", "big:h", "h.zip", "binary"), ("i", "said:i", "i.zip", "binary"), ("j", "broken:j", "j.pdf", "pdf"), ("k", "text:k", "sub/k.xml", "text")]
    requests = spark.createDataFrame([(k, u, f"{folder}/{p}", t) for k, u, p, t in asked], "key string, url string, path string, kind string").repartition(3)
    run = lambda **o: {r.key: r for r in papers.download(requests, fetch, max_bytes=100, most_wait=0.01, **o).collect()}
    got = run()
    assert {k: r.status for k, r in got.items()} == {"a": "downloaded", "b": "skipped_exists", "c": "downloaded", "d": "not_pdf", "e": "not_file", "f": "empty_response", "g": "http_error", "h": "too_large", "i": "too_large", "j": "error: no route", "k": "downloaded"}
    assert got["c"].attempts == 3 and got["g"].attempts == 1 and got["j"].attempts == 3 and got["a"].bytes == 13
    assert sorted(p.name for p in (tmp_path / "d").rglob("*") if p.is_file()) == ["a.pdf", "c.pdf", "have.pdf", "k.xml"]
    assert (tmp_path / "d" / "a.pdf").read_bytes() == b"%PDF-1.4 body" and (tmp_path / "d" / "have.pdf").read_bytes() == b"old"
    again = run()
    assert again["a"].status == again["c"].status == "skipped_exists"
    assert run(overwrite=True)["b"].status == "downloaded" and (tmp_path / "d" / "have.pdf").read_bytes() == b"%PDF-1.4 body"
    assert all(papers.wait_before(n) <= 60 for n in range(20)) and 4 <= papers.wait_before(2) <= 5


def test_csv_of_any_text(spark, tmp_path):
    """Quotes, separators and line ends in cells come back through every writer and reader."""
    rows = [("AC", 1, 'say "hi", x'), ("KK", 0, "two\nlines, and \"\""), ("D", 1, "back\\slash"), ("E", 0, "plain")]
    df = spark.createDataFrame(rows, "sequence string, label int, note string")
    want = sorted((s, str(y), n) for s, y, n in rows)
    sinks.write_csv(df, str(tmp_path / "a"))
    sinks.write_once(df, str(tmp_path / "b"))
    sinks.append_csv(df, str(tmp_path / "c"))
    sinks.write_by_split(df.withColumn("split", F.lit("train")), str(tmp_path / "d"))
    for name in ("a", "b", "c", "d/split=train"):
        assert sorted(tuple(r) for r in records.read_text_table(spark, str(tmp_path / name)).collect()) == want
    back = records.read_labelled_csv(spark, str(tmp_path / "a"))
    assert sorted((r.sequence, str(r.label), r.note) for r in back.collect()) == want
    (tmp_path / "e.csv").write_text("".join(["sequence,label,note\n", *(f'S{i},{i % 2},"a ""{i}""\nb"\n' for i in range(500))]))
    spec = {"dataset_id": "d", "project": "p", "level": "l", "split": "s", "file_path": str(tmp_path / "e.csv"), "label_rule": "csv"}
    assert {r.sequence: r.source_id for r in records.load_source(spark, spec).collect()} == {f"S{i}": f"row_{i}" for i in range(500)}


def test_links_as_browsers_read_them(spark):
    """Hand-made: unquoted and single-quoted values, other attributes that end in href, references, dot segments, fragments."""
    html = "<a href=foo.pdf>a</a><a data-href='no.pdf' href=\"../up/s.zip?x=1&amp;y=2\">b</a><A HREF='//h.org/x.csv'>c</A><a name=q>d</a><link href=l.pdf><a href='#f'>e</a><a href='?q=1'>f</a><a href=foo.pdf>g</a><a href='mailto:x@y'>h</a><a href='./a/./b/../SUPPL'>i</a>"
    df = spark.createDataFrame([("http://x.org/d/e/page.html?k", html), ("http://x.org", None), (None, "<a href='y.pdf'>")], "u string, h string")
    got = df.select(papers.page_links(F.col("h")).alias("n"), papers.absolute_links(F.col("u"), F.col("h")).alias("l"), papers.supplementary_links(F.col("u"), F.col("h")).alias("s")).collect()
    assert got[0].n == ["foo.pdf", "../up/s.zip?x=1&y=2", "//h.org/x.csv", "#f", "?q=1", "mailto:x@y", "./a/./b/../SUPPL"]
    assert got[0].l == ["http://x.org/d/e/foo.pdf", "http://x.org/d/up/s.zip?x=1&y=2", "http://h.org/x.csv", "http://x.org/d/e/page.html?k#f", "http://x.org/d/e/page.html?q=1", "mailto:x@y", "http://x.org/d/e/a/SUPPL"]
    assert got[0].s == ["http://x.org/d/e/foo.pdf", "http://h.org/x.csv", "http://x.org/d/e/a/SUPPL"]
    assert got[1].n == [] and got[2].l == ["y.pdf"]
    one = df.limit(1).select(papers.absolute_url(F.col("u"), F.lit("../z")).alias("z"), papers.absolute_url(F.col("u"), F.lit(None).cast("string")).alias("n")).first()
    assert one.z == "http://x.org/d/z" and one.n is None


def test_resolvers(spark):
    first = lambda c: spark.range(1).select(c.alias("x")).first().x
    u = lambda d: tuple(first(papers.unpaywall_pdf(F.lit(json.dumps(d)))))
    assert u({"is_oa": True, "best_oa_location": {"url_for_pdf": "a"}}) == ("unpaywall", "a")
    assert u({"is_oa": True, "best_oa_location": {"url_for_pdf": "", "url": "c.PDF"}, "oa_locations": [{"url_for_pdf": None}, {"url_for_pdf": "b"}]})[1] == "b"
    assert u({"is_oa": True, "best_oa_location": {"url": "c.PDF"}, "oa_locations": []})[1] == "c.PDF" and u({"is_oa": False, "best_oa_location": {"url_for_pdf": "a"}})[1] is None and u({"is_oa": True, "best_oa_location": {"url": "page"}})[1] is None
    o = lambda d: first(papers.openalex_pdf(F.lit(json.dumps(d)))).url
    assert o({"open_access": {"is_oa": True}, "locations": [{"pdf_url": ""}, {"pdf_url": "x"}], "primary_location": {"pdf_url": "p"}}) == "x" and o({"open_access": {"is_oa": True}, "primary_location": {"pdf_url": "p"}}) == "p" and o({"open_access": {"is_oa": False}, "locations": [{"pdf_url": "x"}]}) is None
    assert first(papers.openalex_landing(F.lit('{"primary_location": {"landing_page_url": "l"}}'))) == "l"
    assert first(papers.arxiv_pdf(F.lit("arXiv:2101.00001v2"))).url == "https://arxiv.org/pdf/2101.00001v2.pdf" and first(papers.arxiv_pdf(F.lit("x"))).url is None
    assert tuple(first(papers.first_resolved(papers.unpaywall_pdf(F.lit(None).cast("string")), papers.openalex_pdf(F.lit("{}")), papers.arxiv_pdf(F.lit("2101.00001"))))) == ("arxiv", "https://arxiv.org/pdf/2101.00001.pdf")
    assert first(papers.article_files_base(F.lit("pmc12"))).endswith("/instance/12/bin/") and first(papers.article_files_base(F.lit("12"))) is None


def test_xlsx(tmp_path):
    ns = 'xmlns="m" xmlns:r="r"'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>1.5</v></c><c r="AB3" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>x</t></is></c><c t="str"><f>A</f><v>y</v></c></row></sheetData></worksheet>')
    got = dict(papers.supplement_tables("b.xlsx", book.getvalue()))
    assert got["b.xlsx#Two"] == [["x", "y"]]
    one = got["b.xlsx#One"]
    assert [len(r) for r in one] == [28] * 3 and one[0][:3] == ["id", "", "rich"] and one[2][1] == "1.5" and one[2][27] == "TRUE"
    assert papers.supplement_tables("b.xlsx", b"PK no") == []


def test_literature_run_with_report(spark, tmp_path):
    from tessera.plans.literature import literature_run

    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    xml = f'<article><body><p>A dose of 5 is the cutoff.</p></body><table-wrap id="a"><table>{row("Peptide", "Sequence")}{row("P1", "ACDEFGHK")}{row("P2", "KKLLKWLL")}</table></table-wrap><table-wrap id="b"><table>{row("Peptide", "MIC (µM)")}{row("P1", "4")}{row("P2", "&gt;128")}</table></table-wrap></article>'
    df = spark.createDataFrame([("d1", xml), ("d2", "<article/>"), ("d3", None)], "doc string, xml string")
    (tmp_path / "m.jsonl").write_text(json.dumps({"input": "d1", "actions": [{"kind": "xml", "download": {"status": "ok"}, "meta": {"doi": "10.1/a|b"}}]}))
    run = literature_run(df, papers.read_manifest(spark, str(tmp_path / "m.jsonl")), out=f"file://{tmp_path}/out")
    assert sorted((r.sequence, r.cmp, r.value, r.train_ready_strict) for r in run["records"].collect()) == [("ACDEFGHK", "", 4.0, True), ("KKLLKWLL", ">", 128.0, False)]
    assert sorted(r.doc for r in run["without"].collect()) == ["d2", "d3"] and run["thresholds"].count() == 1
    report = "".join(p.read_text() for p in (tmp_path / "out" / "report").glob("part-*"))
    assert "- Papers: 1" in report and "- Records: 2" in report and "- Ready, strict: 1" in report and "10.1/a\\|b" in report and "| MIC | 2 |" in report and "d3" in report
    back = records.read_text_table(spark, f"file://{tmp_path}/out/records").collect()
    assert len(back) == 2 and {r.endpoint for r in back} == {"MIC"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "AC", "train", "x" * 3000), ("b", "D|E", "test", "y")], "seq_id string, sequence string, split string, snippet string")
    sinks.write_fasta(df, str(tmp_path / "f"))
    assert records.read_fasta(spark, str(tmp_path / "f")).count() == 2
    sinks.write_by_split(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=test"}
    sinks.write_once(df, str(tmp_path / "o"))
    sinks.write_once(df.limit(0), str(tmp_path / "o"))
    sinks.append_csv(df, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 4
    assert len(sinks.clipped(df).first().snippet) == 2014
    sinks.write_jsonl(df.select(F.struct("seq_id", "split").alias("source")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().source.seq_id in ("a", "b")
    assert "D\\|E" in sinks.markdown_table(df.select("seq_id", "sequence")) and json.loads(sinks.stats_json(df.agg(F.count("*").alias("n")))) == {"n": 2}
    assert sinks.file_digests(spark, str(tmp_path / "f" / "part*")).count() >= 1
    sinks.write_catalogue(spark, [{"dataset_id": "d", "project": "p", "level": "l", "split": "s", "file_path": "f", "label_rule": "csv"}], str(tmp_path / "c"))
    sinks.save_index(spark.createDataFrame([("g", 1, 0.5)], "gram string, id int, weight double"), spark.createDataFrame([("g", 1.0)], "gram string, idf double"), str(tmp_path / "i"))
    assert sinks.load_index(spark, str(tmp_path / "i"))[0].count() == 1


def test_streams_agree_with_batches(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], 1.0) for i in range(100)] + [(1000, t0 + datetime.timedelta(days=9), 0, "a", 0.0)]
    spark.createDataFrame(rows + rows[:5], "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "e"))
    for name, f in (("counts", events.tumbling_counts), ("sessions", events.sessions)):
        q = f(events.distinct_events(events.read_events(spark, str(tmp_path / "e")), "20 days")) if name == "none" else f(events.read_events(spark, str(tmp_path / "e")))
        run = q.writeStream.outputMode("append").format("memory").queryName(name).start()
        run.processAllAvailable()
        run.stop()
        batch = f(spark.read.parquet(str(tmp_path / "e")))
        done = {tuple(r) for r in spark.table(name).collect()}
        assert done and done <= {tuple(r) for r in batch.collect()}
    run = events.distinct_events(events.read_events(spark, str(tmp_path / "e")), "20 days").writeStream.outputMode("append").format("memory").queryName("once").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("once").count() == 101
