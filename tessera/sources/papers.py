"""Identifiers, links, manifests, supplementary files: what a literature run reads, offline."""

from __future__ import annotations

import csv
import io
import json
import os
import random
import re
import tarfile
import time
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from itertools import chain
from typing import NamedTuple
from urllib.parse import quote, urljoin

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import safe_stem

#: Words and file endings of supplementary links; size of a zip member beyond which it is passed over.
LINK_WORDS = ["supplement", "supporting", "additional", "moesm", "esm", "suppl", "source-data", "source_data"]
FILE_ENDINGS = [".zip", ".pdf", ".csv", ".tsv", ".txt", ".xlsx", ".xls", ".doc", ".docx", ".rtf", ".fa", ".fasta", ".json", ".xml", ".tif", ".tiff", ".png", ".jpg", ".jpeg", ".svg"]
MEMBER_BYTES = 200_000_000
DOI = r"^10\.\d{4,9}/\S+$"
ARXIV = r"^(?:arxiv:)?\d{4}\.\d{4,5}(?:v\d+)?$"
MANIFEST = (
    "retrieved_at string, input string, id_type string, normalized string, error string, actions array<struct<kind:string,via:string,url:string,status:string,path:string,sha256:string,"
    "download:struct<status:string,http_status:int>,meta:struct<doi:string,pmid:string,pmcid:string>,extract:struct<extracted_pdf:boolean,extracted_supp_files:int>>>"
)
_ENDING = "(" + "|".join(re.escape(e) for e in FILE_ENDINGS) + ")$"


def classify_identifier(raw: Column) -> Column:
    """struct(kind, value): empty, doi (also as a URL), url, pmcid, pmid, arxiv or unknown."""
    s = F.trim(raw)
    bare = F.regexp_replace(s, r"(?i)^https?://(dx\.)?doi\.org/", "")
    is_url = s.rlike("(?i)^https?://")
    kind = F.when(s == "", "empty").when(is_url & bare.rlike("(?i)" + DOI), "doi").when(is_url, "url").when(s.rlike(r"(?i)^PMC\d+$"), "pmcid").when(s.rlike(r"^\d+$"), "pmid").when(s.rlike("(?i)" + DOI), "doi").when(s.rlike("(?i)" + ARXIV), "arxiv").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.when(is_url & (kind == "doi"), bare).when(kind == "pmcid", F.upper(s)).otherwise(s).alias("value"))


def normalize_pmcid(raw: Column) -> Column:
    s = F.upper(F.trim(raw))
    return F.when(s.rlike(r"^PMC\d+$"), s).when(s.rlike(r"^\d+$"), F.concat(F.lit("PMC"), s))


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """An id list: blank lines and those with # left out."""
    return spark.read.text(path).select(F.trim("value").alias("input")).where("input <> '' AND NOT startswith(input, '#')").select("input", classify_identifier(F.col("input")).alias("id")).select("input", "id.*")


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, None] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.found |= dict.fromkeys(v for k, v in attrs if k == "href" and v)


def hrefs(html: str | None) -> list[str]:
    """Distinct hrefs of <a>, in order, character references decoded."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return list(parser.found)


def resolved_url(base: str | None, href: str | None) -> str | None:
    """href against a page's url; as it stands where the two make no url."""
    try:
        return urljoin(base or "", href) if href is not None else None
    except ValueError:
        return href


def page_links(html: Column) -> Column:
    """Distinct hrefs of <a> in order (HTML is parsed in Arrow batches)."""
    return F.pandas_udf(lambda s: s.map(hrefs), "array<string>")(html)


def absolute_url(base: Column, href: Column) -> Column:
    """href resolved against a page's url."""
    return F.pandas_udf(lambda b, h: pd.Series([resolved_url(x, y) for x, y in zip(b, h, strict=True)], dtype=object), "string")(base, href)


def _absolute_links(base: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([list(dict.fromkeys(resolved_url(b, h) for h in hrefs(x))) for b, x in zip(base, html, strict=True)], dtype=object)


def absolute_links(base: Column, html: Column) -> Column:
    """Distinct absolute urls of a page's links, in order."""
    return F.pandas_udf(_absolute_links, "array<string>")(base, html)


def looks_like_file(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(_ENDING)


def supplementary_links(base: Column, html: Column) -> Column:
    """Absolute links whose text has a word for supplements or ends like a file."""
    return F.filter(absolute_links(base, html), lambda u: F.lower(u).rlike("|".join(LINK_WORDS)) | F.lower(u).rlike(_ENDING))


def jats_supplements(xml: Column) -> Column:
    blocks = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)(<supplementary-material\b.*?</supplementary-material>)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'xlink:href="([^"]+)"'), F.lit(1)))))


def package_url(xml: Column, path: str = "/pub/pmc/oa_package/") -> Column:
    """First quoted link below the package path, with https for ftp and http."""
    return F.regexp_replace(F.regexp_extract(xml, rf'href="([^"]*{re.escape(path)}[^"]*)"', 1), "^(ftp|http)://", "https://")


def file_name(url: Column) -> Column:
    return safe_stem(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1), 180)


def candidate_url(base: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))


def first_resolved(*candidates: Column) -> Column:
    """The first resolver's struct (via, url) that has a url."""
    return F.coalesce(*[F.when(F.coalesce(c["url"], F.lit("")) != "", c) for c in candidates])


def _via(name: str, url: Column) -> Column:
    return F.struct(F.lit(name).alias("via"), F.nullif(url, F.lit("")).alias("url"))


def unpaywall_pdf(answer: Column) -> Column:
    """struct(via, url) from a DOI's answer (JSON) on open locations: the best one's PDF, else the first with one, else the best one's url if it ends in .pdf."""
    a = F.from_json(answer, "is_oa boolean, best_oa_location struct<url:string,url_for_pdf:string>, oa_locations array<struct<url_for_pdf:string>>")
    some = lambda c: F.nullif(c, F.lit(""))
    others = F.filter(F.transform(a["oa_locations"], lambda x: x["url_for_pdf"]), lambda u: F.coalesce(u, F.lit("")) != "")
    best = a["best_oa_location"]
    url = F.coalesce(some(best["url_for_pdf"]), F.get(others, F.lit(0)), F.when(F.lower(best["url"]).endswith(".pdf"), best["url"]))
    return _via("unpaywall", F.when(a["is_oa"], url))


def openalex_pdf(answer: Column) -> Column:
    """struct(via, url) from a work's record (JSON): the first location's PDF, else the primary one's, of open works."""
    a = F.from_json(answer, "open_access struct<is_oa:boolean>, primary_location struct<pdf_url:string>, locations array<struct<pdf_url:string>>")
    found = F.filter(F.transform(a["locations"], lambda x: x["pdf_url"]), lambda u: F.coalesce(u, F.lit("")) != "")
    return _via("openalex", F.when(a["open_access"]["is_oa"], F.coalesce(F.get(found, F.lit(0)), a["primary_location"]["pdf_url"])))


def openalex_landing(answer: Column) -> Column:
    """The primary location's page, from a work's record (JSON)."""
    return F.nullif(F.get_json_object(answer, "$.primary_location.landing_page_url"), F.lit(""))


def arxiv_pdf(identifier: Column) -> Column:
    """struct(via, url) of an arXiv id; null url if it is none."""
    bare = F.regexp_extract(F.trim(identifier), r"(?i)^(?:arxiv:)?(\d{4}\.\d{4,5}(?:v\d+)?)$", 1)
    return _via("arxiv", F.when(bare != "", F.concat(F.lit("https://arxiv.org/pdf/"), bare, F.lit(".pdf"))))


def fulltext_url(pmcid: Column) -> Column:
    """Where the archive serves an article's XML."""
    return F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/"), pmcid, F.lit("/fullTextXML"))


def article_files_base(pmcid: Column) -> Column:
    """The folder of an archived article's files; null for other ids."""
    digits = F.regexp_extract(pmcid, r"(?i)^PMC(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/instance/"), digits, F.lit("/bin/")))


def sniff(content: Column) -> Column:
    """pdf, html, empty or other, by the first bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    return F.when(F.length(content) == 0, "empty").when(head.startswith("%pdf"), "pdf").when(head.rlike(r"^\s*<(!doctype html|html|head|script)"), "html").otherwise("other")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines: malformed ones left out, of each normalized (else input) the last record."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("place"))
    return latest_records(lines.select(F.from_json("value", MANIFEST).alias("rec"), "place").where("rec IS NOT NULL AND (rec.normalized IS NOT NULL OR rec.input IS NOT NULL)"))


def latest_records(records: DataFrame) -> DataFrame:
    """Of each key the record with the greatest place."""
    key = F.trim(F.coalesce(F.nullif(F.col("rec.normalized"), F.lit("")), F.col("rec.input"), F.lit("")))
    return records.groupBy(key.alias("key")).agg(F.max_by("rec", "place").alias("rec")).select("key", "rec.*")


def manifest_summary(latest: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per key: first ids, what was fetched, what came out of packages. files: (stem, n) of files on disk, which count too."""
    a = latest.select("key", "input", "id_type", F.posexplode_outer("actions").alias("nth", "a"))
    ok = lambda kind: F.coalesce(F.bool_or((F.col("a.kind") == kind) & F.coalesce(F.col("a.download.status"), F.col("a.status")).isin("ok", "downloaded", "skipped_exists")), F.lit(False))
    first = lambda c: F.min_by(F.col(f"a.meta.{c}"), F.when(F.coalesce(F.col(f"a.meta.{c}"), F.lit("")) != "", F.col("nth")))
    s = a.groupBy("key", "input", "id_type").agg(
        first("doi").alias("doi"), first("pmid").alias("pmid"), first("pmcid").alias("pmcid"), ok("pdf").alias("pdf_ok"), ok("xml").alias("xml_ok"), ok("supplementary").alias("supp_ok"), ok("pmc_oa_package").alias("package_ok"),
        F.coalesce(F.bool_or("a.extract.extracted_pdf"), F.lit(False)).alias("pdf_extracted"), F.coalesce(F.max("a.extract.extracted_supp_files"), F.lit(0)).alias("supp_extracted"),
    )
    s = s.withColumn("stem", safe_stem(F.col("key")))
    if files is not None:
        s = s.join(files, "stem", "left").withColumn("supp_extracted", F.greatest("supp_extracted", F.coalesce("n", F.lit(0)))).drop("n")
    return s.withColumn("pdf_ok", F.col("pdf_ok") | F.col("pdf_extracted")).withColumn("supp_ok", F.col("supp_ok") | (F.col("supp_extracted") > 0))


def paper_catalogue(files: DataFrame, summary: DataFrame | None) -> DataFrame:
    """(stem, path[, ids]): the manifest's papers with their XML, or all XML files where there is no manifest. files: path."""
    stems = files.where("lower(path) like '%.xml'").select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.xml$", "").alias("stem"), "path")
    return stems if summary is None else summary.join(stems, "stem", "left")


def _docx_tables(data: bytes) -> list[list[list[str]]]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    name = lambda e: e.tag.rpartition("}")[2]
    cell = lambda c: " ".join("".join(t.text or "" for t in c.iter() if name(t) == "t").split())
    return [[[cell(c) for c in r if name(c) == "tc"] for r in t if name(r) == "tr"] for t in root.iter() if name(t) == "tbl"]


def _xlsx_tables(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, matrix) of a workbook: shared and inline strings, numbers as written, truth values as words; cells that are left out are empty."""
    book = zipfile.ZipFile(io.BytesIO(data))
    name = lambda e: e.tag.rpartition("}")[2]
    own = lambda e, k: next((v for a, v in e.attrib.items() if a.rpartition("}")[2] == k), "")
    texts = lambda e: "".join(t.text or "" for t in e.iter() if name(t) == "t")
    shared = [texts(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml")) if name(si) == "si"] if "xl/sharedStrings.xml" in book.namelist() else []
    targets = {own(r, "Id"): own(r, "Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(e.get("name") or "", next(v for a, v in e.attrib.items() if a.endswith("}id"))) for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if name(e) == "sheet"]

    def value(c: ET.Element) -> str:
        if c.get("t") == "inlineStr":
            return texts(c)
        v = next((x.text or "" for x in c if name(x) == "v"), "")
        if c.get("t") == "s":
            return shared[int(v)] if v else ""
        return {"1": "TRUE", "0": "FALSE"}.get(v, v) if c.get("t") == "b" else v

    out = []
    for title, key in sheets:
        target = targets[key].lstrip("/")
        rows: dict[int, dict[int, str]] = {}
        for row in (e for e in ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if name(e) == "row"):
            at = int(row.get("r") or len(rows) + 1)
            line = rows.setdefault(at, {})
            for c in (e for e in row if name(e) == "c"):
                letters = re.match("[A-Z]*", c.get("r") or "")[0]
                column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else max(line, default=-1) + 1
                line[column] = value(c)
        width = max((max(r, default=-1) for r in rows.values()), default=-1) + 1
        out.append((title, [[rows.get(i, {}).get(c, "") for c in range(width)] for i in range(1, max(rows, default=0) + 1)]))
    return out


class Damaged(NamedTuple):
    """A file, or a member of an archive, that could not be read, and why."""

    place: str
    problem: str


def supplement_contents(name: str, data: bytes, inside: bool = False) -> list[tuple[str, list[list[str]]] | Damaged]:
    """(place, matrix) of a file by its ending: csv, tsv, docx, xlsx, txt and fasta (a row a record), and zip, one level deep. What can't be read is Damaged, by member; other kinds have no entry."""
    low = name.lower()
    try:
        if low.endswith((".csv", ".tsv")):
            return [(name, list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace")), delimiter="\t" if low.endswith(".tsv") else ",")))]
        if low.endswith((".txt", ".fa", ".fasta")):
            text = data.decode("utf-8", "ignore")
            if re.search(r"(?m)^>", text):
                parts = [p.partition("\n") for p in re.split(r"(?m)^>", text)[1:]]
                return [(name, [["id", "sequence"], *([h.strip(), re.sub(r"\s+", "", b)] for h, _, b in parts)])]
            return [(name, [[line] for line in text.splitlines() if line.strip()])]
        if low.endswith(".docx"):
            return [(f"{name}#table{i}", t) for i, t in enumerate(_docx_tables(data))]
        if low.endswith(".xlsx"):
            return [(f"{name}#{sheet}", t) for sheet, t in _xlsx_tables(data)]
        if low.endswith(".zip") and not inside:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [t for m in z.infolist() if not m.is_dir() for t in _member_contents(z, m, f"{name}/{m.filename}")]
    except _UNREADABLE as e:
        return [Damaged(name, f"{type(e).__name__}: {e}"[:200])]
    return []


#: What reading a damaged file may raise; encrypted members are RuntimeErrors.
_UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, ET.ParseError, LookupError, StopIteration, ValueError, NotImplementedError, RuntimeError, csv.Error)


def _member_contents(archive: zipfile.ZipFile, member: zipfile.ZipInfo, place: str) -> list[tuple[str, list[list[str]]] | Damaged]:
    if member.file_size > MEMBER_BYTES:
        return [Damaged(place, f"over {MEMBER_BYTES} bytes")]
    try:
        data = archive.read(member)
    except _UNREADABLE as e:
        return [Damaged(place, f"{type(e).__name__}: {e}"[:200])]
    return supplement_contents(place, data, True)


def supplement_tables(name: str, data: bytes) -> list[tuple[str, list[list[str]]]]:
    """The tables of supplement_contents(); a damaged file has none."""
    return [t for t in supplement_contents(name, data) if not isinstance(t, Damaged)]


def read_supplements(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """Tables of supplementary files: doc (the folder's name), table_id, label, caption, foot, rows. damaged: also a row, without rows, for each file or member that can't be read, with the reason as problem (else null). Spark passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    kind = pa.schema([*((c, pa.string()) for c in ("doc", "table_id", "label", "caption", "foot")), ("rows", pa.list_(pa.list_(pa.string()))), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1).to_pylist()[0]
                folder, _, name = one["path"].rpartition("/")
                found = []
                for t in supplement_contents(name, one["content"]):
                    bad = isinstance(t, Damaged)
                    found.append({"doc": folder.rpartition("/")[2], "table_id": t[0], "label": "", "caption": "", "foot": "", "rows": [] if bad else t[1], "problem": t.problem if bad else None})
                yield pa.RecordBatch.from_pylist(found, schema=kind)

    found = files.mapInArrow(run, "doc string, table_id string, label string, caption string, foot string, rows array<array<string>>, problem string")
    return found if damaged else found.where("problem IS NULL").drop("problem")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, role) of tar.gz packages: the largest PDF is main, other listed kinds are supplements."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64())])
        for batch in batches:
            for one in batch.to_pylist():
                with tarfile.open(fileobj=io.BytesIO(one["content"])) as t:
                    yield pa.RecordBatch.from_pylist([{"archive": one["path"], "member": m.name, "size": m.size} for m in t.getmembers() if m.isfile()], schema=kind)

    m = files.mapInArrow(run, "archive string, member string, size long")
    pdf = F.lower("member").endswith(".pdf")
    rank = F.row_number().over(W.partitionBy("archive", pdf).orderBy(F.desc("size"), "member"))
    return m.withColumn("r", rank).select("archive", "member", "size", F.when(pdf & (F.col("r") == 1), "main").when(F.lower("member").rlike(_ENDING), "supplement").otherwise("other").alias("role"))


def page_text(pages: DataFrame, most: int = 25) -> DataFrame:
    """(doc, page, text) of the first pages of documents whose text is already extracted."""
    return pages.where(F.col("page") < most)


#: What is kept of a search's result.
SEARCH_FIELDS = ["id", "pmcid", "doi", "pmid", "title", "pubYear", "journalTitle", "isOpenAccess", "inPMC", "hasSuppl", "hasPDF"]


def search_results(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """Rows of saved search answers (JSON with resultList.result), page by page in the order of the files, up to `most`."""
    schema = "resultList struct<result:array<struct<id:string,pmcid:string,doi:string,pmid:string,title:string,pubYear:string,journalTitle:string,isOpenAccess:string,inPMC:string,hasSuppl:string,hasPDF:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("page"), F.posexplode("resultList.result").alias("nth", "r"))
    return raw.orderBy("page", "nth").limit(most).select("r.*")


def search_rows(spark: SparkSession, answer: Callable[[str, int], dict], most: int = 200, page_size: int = 100) -> DataFrame:
    """Results of one search that is answered page by page (many, or long ones: searched()): answer(cursor, size) gives one, as the service's JSON.

    Starts with the cursor *, asks for no more than is wanted, and stops at `most` results, an empty page, or one without a next cursor. A cursor is known only
    from the page before, so this runs on the driver; `most` bounds it.
    """
    found, cursor = [], "*"
    while cursor and len(found) < most:
        page = answer(cursor, min(page_size, most - len(found)))
        results = ((page.get("resultList") or {}).get("result")) or []
        if not results:
            break
        found += results[: most - len(found)]
        cursor = page.get("nextCursorMark") or ""
    return spark.createDataFrame([tuple(_search_fields(r).values()) for r in found], ", ".join(f"{n} string" for n in SEARCH_FIELDS))


def _search_fields(result: dict) -> dict[str, str | None]:
    return {n: None if result.get(n) is None else str(result[n]) for n in SEARCH_FIELDS}


def _saved_page(where: fs.FileSystem, path: str, ask: Callable[[], dict]) -> dict:
    """The page at path; where there is none, the answer, which is saved there first unless it is without results."""
    if where.get_file_info(path).type == fs.FileType.NotFound:
        page = ask()
        if not (page.get("resultList") or {}).get("result"):
            return page
        where.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with where.open_output_stream(part, compression=None) as out:
            out.write(json.dumps(page).encode())
        if where.get_file_info(path).type == fs.FileType.NotFound:
            where.move(part, path)
        else:  # another attempt of this task was first
            where.delete_file(part)
    with where.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


def searched(searches: DataFrame, answer: Callable[[str, str, int], dict], saved: str, most: int = 200, page_size: int = 100, tasks: int = 32) -> DataFrame:
    """(search, page, nth, and the fields of a result) of many searches that are answered page by page. searches: search (a name), request; answer(request, cursor, size) gives one page.

    Tasks take whole searches, as a cursor is known only from the page before; many searches run at once. Each starts with the cursor *, asks for whole pages, and stops
    at `most` results, an empty page, or one without a next cursor. A page is saved below `saved` (a folder that the executors share) before the next one is
    asked for, and a saved page is never asked for again: a run that broke off, a task that is tried again, and a later run with a larger `most` go on from the last page
    with the same rows, in the same places. The ends of searches are asked for again, so a later run finds what came after an empty page. Of searches of the same name one is made; null names
    and null requests are left out.
    """
    kind = pa.schema([("search", pa.string()), ("page", pa.int32()), ("nth", pa.int32()), *((n, pa.string()) for n in SEARCH_FIELDS)])

    def walk(search: str, request: str) -> Iterator[list[dict]]:
        where, base = fs.FileSystem.from_uri(saved)
        folder = f"{base}/search-{quote(search, safe='')}"
        cursor, page, held = "*", 0, 0
        while cursor and held < most:
            got = _saved_page(where, f"{folder}/{page:06d}.json", lambda c=cursor: answer(request, c, page_size))
            results = ((got.get("resultList") or {}).get("result") or [])[: most - held]
            if not results:
                return
            yield [{"search": search, "page": page, "nth": held + i} | _search_fields(r) for i, r in enumerate(results)]
            held, page, cursor = held + len(results), page + 1, got.get("nextCursorMark") or ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                for rows in walk(batch.column("search")[at].as_py(), batch.column("request")[at].as_py()):
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    each = searches.where("search IS NOT NULL AND request IS NOT NULL").groupBy("search").agg(F.min("request").alias("request"))
    columns = ", ".join(["search string", "page int", "nth int", *(f"{n} string" for n in SEARCH_FIELDS)])
    return each.repartition(tasks, "search").mapInArrow(run, columns)


def saved_answers(folder: str) -> Callable[[str, int], dict]:
    """answer() for search_rows() from files page-<cursor, quoted>.json."""

    def answer(cursor: str, size: int) -> dict:
        path = os.path.join(folder, f"page-{quote(cursor, safe='')}.json")
        if not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    return answer


def open_access(results: DataFrame, keep: int | None = None, require_oa: bool = True) -> DataFrame:
    """Open, in the archive, with an id; of an id the row of the highest score, then the first by year and id; highest score first, then year and id."""
    rows = results.where(F.col("pmcid").isNotNull() & (F.col("pmcid") != ""))
    rows = rows.where((F.upper("isOpenAccess") == "Y") & (F.upper("inPMC") == "Y")) if require_oa else rows
    every = F.struct(*[F.col(c) for c in rows.columns])
    rows = rows.groupBy(F.col("pmcid").alias("_id")).agg(F.min_by(every, F.struct(-F.col("score"), F.col("pubYear").isNull(), "pubYear", F.to_json(every))).alias("r")).select("r.*")
    rows = rows.orderBy(F.desc("score"), F.col("pubYear").asc_nulls_last(), "pmcid")
    return rows.limit(keep) if keep else rows


class Answer(NamedTuple):
    """What a fetch function gives for a url: HTTP status, headers (lower-case names) and the body in pieces."""

    status: int
    headers: dict[str, str]
    body: Iterable[bytes]


def wait_before(attempt: int, most: float = 60.0) -> float:
    """Seconds before a further attempt: doubling, with a random part, up to `most`."""
    return min(most, 2**attempt + random.random())


def _store(answer: Answer, where: fs.FileSystem, path: str, kind: str, max_bytes: int, max_seconds: float) -> dict:
    """The body to path, through path.part, unless it is not what kind asks for or beyond a cap."""
    began, written, part = time.monotonic(), 0, f"{path}.part"
    stated = answer.headers.get("content-length", "")
    if max_bytes and stated.isdigit() and int(stated) > max_bytes:
        return {"status": "too_large"}
    pieces = iter(answer.body)
    first = next((p for p in pieces if p), b"")
    if not first:
        return {"status": "empty_response"}
    is_html = first.lstrip().lower().startswith((b"<!doctype html", b"<html", b"<head", b"<script"))
    if kind == "pdf" and not first.startswith(b"%PDF"):
        return {"status": "not_pdf"}
    if kind == "binary" and (is_html or "text/html" in answer.headers.get("content-type", "").lower()):
        return {"status": "not_file"}
    state = "downloaded"
    with where.open_output_stream(part, compression=None) as out:
        for piece in chain([first], pieces):
            written += len(piece)
            if max_bytes and written > max_bytes:
                state = "too_large"
            elif max_seconds and time.monotonic() - began > max_seconds:
                state = "timeout_total"
            if state != "downloaded":
                break
            out.write(piece)
    if state != "downloaded":
        where.delete_file(part)
        return {"status": state, "bytes": written}
    where.move(part, path)
    return {"status": state, "bytes": written}


def download(requests: DataFrame, fetch: Callable[[str], Answer], overwrite: bool = False, max_bytes: int = 0, max_seconds: float = 0, retries: int = 2, most_wait: float = 60.0) -> DataFrame:
    """(key, path, status, http_status, bytes, attempts) for rows (key, url, path, kind), kind being pdf, text or binary.

    Files that exist are left alone unless overwrite, so a run that broke off is taken up again. A status of 429 or 5xx, and an OSError, is tried again after
    wait_before(); other statuses are not. A file is written as .part and renamed when whole; one attempt's leftover is overwritten by the next. Paths are those of
    pyarrow's file systems, in a folder that the executors share. Tasks run in parallel: repartition the requests.
    """
    kinds = pa.schema([("key", pa.string()), ("path", pa.string()), ("status", pa.string()), ("http_status", pa.int32()), ("bytes", pa.int64()), ("attempts", pa.int32())])

    def one(row: dict) -> dict:
        where, path = fs.FileSystem.from_uri(row["path"])
        if where.get_file_info(path).type != fs.FileType.NotFound and not overwrite:
            return {"status": "skipped_exists"}
        where.create_dir(path.rpartition("/")[0], recursive=True)
        out: dict = {}
        for n in range(retries + 1):
            try:
                answer = fetch(row["url"])
                out = {"http_status": answer.status, "attempts": n + 1}
                if answer.status == 200:
                    return out | _store(answer, where, path, row["kind"], max_bytes, max_seconds)
                out["status"] = "http_error"
                if answer.status != 429 and answer.status < 500:
                    return out
            except OSError as e:
                out = {"status": f"error: {e}"[:200], "attempts": n + 1}
            if n < retries:
                time.sleep(wait_before(n, most_wait))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a row at a time, as a url may hold its payload
                row = batch.slice(at, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([{"key": row["key"], "path": row["path"]} | one(row)], schema=kinds)

    return requests.select("key", "url", "path", "kind").mapInArrow(run, "key string, path string, status string, http_status int, bytes long, attempts int")
