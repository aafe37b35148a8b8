"""Queries of what is fetched, saved and reported: searches by page, downloads, reports, and models that are saved and scored again."""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import evidential
from tessera.plans.catalog import register
from tessera.plans.corpus import table
from tessera.sources import papers, sinks
from tessera.sources.scratch import scratch_path

# --- searches ------------------------------------------------------------------------------------------------------


def _answer(request: str, cursor: str, size: int) -> dict:
    """A service whose pages are in the request: results and the next cursor by cursor."""
    page = {p["cursor"]: p for p in json.loads(request)}.get(cursor, {"ids": []})
    return {"resultList": {"result": [{"id": i, "isOpenAccess": "Y" if i % 2 else "N"} for i in page["ids"][:size]]}, "nextCursorMark": page.get("then")}


@register(
    "s21_paged_searches",
    """WITH d AS (SELECT DISTINCT coalesce(source, 'none') || '-' || CAST(doc_id // 5000 AS VARCHAR) AS search, doc_id FROM documents WHERE doc_id IS NOT NULL)
SELECT search, row_number() OVER (PARTITION BY search ORDER BY doc_id) - 1 AS nth, dense_rank() OVER (PARTITION BY search ORDER BY doc_id // 500) - 1 AS page, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 <> 0 THEN 'Y' ELSE 'N' END AS is_open FROM d""",
)
def s21_paged_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each source and 5 000 ids, answered in pages of 500 ids at most; what is returned are the pages that a first run, which asks for 150 results, and a second one saved."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.concat_ws("-", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 5000)).alias("search"), F.floor(F.col("doc_id") / 500).alias("part"), "doc_id")
    parts = d.groupBy("search", "part").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    pages = parts.groupBy("search").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("p"))
    cursor = lambda i: F.when(i == 0, "*").otherwise(F.concat(F.lit("at/"), i))
    page = lambda x, i: F.struct(cursor(i).alias("cursor"), x["ids"].alias("ids"), F.when(i + 1 < F.size("p"), cursor(i + 1)).alias("then"))
    searches = pages.select("search", F.to_json(F.transform("p", page)).alias("request"))
    saved = scratch_path(spark, "search-pages")
    papers.searched(searches, _answer, saved, most=150, page_size=500).write.format("noop").mode("overwrite").save()
    return papers.searched(searches, _answer, saved, most=5000, page_size=500).select("search", F.col("nth").cast("long").alias("nth"), F.col("page").cast("long").alias("page"), "id", F.col("isOpenAccess").alias("is_open"))


# --- downloads -----------------------------------------------------------------------------------------------------

#: Bytes of a download at most.
_CAP = 20_000
_MADE = """WITH m AS (SELECT page_id, page_id % 7 AS form, CASE page_id % 7 WHEN 0 THEN '%PDF' WHEN 4 THEN 'PK' ELSE '' END || coalesce(html, '') AS body FROM pages),
s AS (SELECT *, CASE WHEN form = 5 THEN 'http_error' WHEN body = '' THEN 'empty_response' WHEN form = 1 THEN 'not_pdf' WHEN form = 2 THEN 'not_file' WHEN strlen(body) > 20000 THEN 'too_large' ELSE 'stored' END AS status FROM m)"""


def _service():  # noqa: ANN202
    """fetch() for urls <form>,<payload in base64>: form 5 is missing, form 6 is busy at first. Of those that are busy it keeps a digest, until they are answered."""
    busy: set[bytes] = set()

    def fetch(url: str) -> papers.Answer:
        form, _, payload = url.partition(",")
        kind = {"2": "text/html", "4": "application/zip"}.get(form, "application/octet-stream")
        if form == "6":
            digest = hashlib.sha256(url.encode()).digest()
            if digest not in busy:
                busy.add(digest)
                return papers.Answer(429, {}, [])
            busy.discard(digest)
        body = base64.b64decode(payload)
        return papers.Answer(404 if form == "5" else 200, {"content-type": kind}, [body[i : i + 8192] for i in range(0, len(body), 8192)])

    return fetch


@register("s24_downloads", f"{_MADE} SELECT page_id, status, CASE WHEN status = 'stored' THEN sha256(body) END AS sha256 FROM s")
def s24_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages offered as PDF, files and text, some of them missing, busy or not what was asked for; the status of each and the digest of what lies on disk. A second run finds what is there."""
    folder = scratch_path(spark, "downloads")
    form = F.col("page_id") % 7
    payload = F.concat(F.when(form == 0, "%PDF").when(form == 4, "PK").otherwise(""), F.coalesce("html", F.lit("")))
    kind = F.when(form.isin(0, 1), "pdf").when(form.isin(2, 4), "binary").otherwise("text")
    requests = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), F.concat_ws(",", form.cast("string"), F.regexp_replace(F.base64(payload.cast("binary")), r"\s", "")).alias("url"), F.concat(F.lit(f"{folder}/"), F.pmod(F.hash("page_id"), F.lit(256)), F.lit("/"), "page_id").alias("path"), kind.alias("kind"))
    papers.download(requests, _service(), max_bytes=_CAP, most_wait=0.0).write.format("noop").mode("overwrite").save()
    told = papers.download(requests, _service(), max_bytes=_CAP, most_wait=0.0)
    told = told.select("key", F.when(F.col("status").isin("downloaded", "skipped_exists"), "stored").otherwise(F.col("status")).alias("status"))
    there = sinks.file_digests(spark, f"{folder}/*/*").select(F.element_at(F.split("path", "/"), -1).alias("key"), "sha256")
    return told.join(there, "key", "left").select(F.col("key").cast("long").alias("page_id"), "status", "sha256")


# --- reports -------------------------------------------------------------------------------------------------------


@register(
    "k9_report",
    """WITH n AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM n)
SELECT 0 AS line, '# Corpus' AS text UNION ALL SELECT 1, '' UNION ALL SELECT 2, '## Sources' UNION ALL SELECT 3, '- Texts: ' || (SELECT count(*) FROM documents) UNION ALL SELECT 4, ''
UNION ALL SELECT 5, '| name | n |' UNION ALL SELECT 6, '| --- | --- |' UNION ALL SELECT 6 + k, '| x\\|' || source || ' | ' || n || ' |' FROM t WHERE k <= 30 UNION ALL SELECT 7 + least(30, (SELECT count(*) FROM n)), ''""",
)
def k9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of texts by source, a line a row; a report shows 30 rows of a table."""
    d = table(spark, sf_dir, "documents")
    n = d.groupBy("source").agg(F.count("*").alias("n")).select(F.concat(F.lit("x|"), F.coalesce("source", F.lit(""))).alias("name"), "n").orderBy(F.desc("n"), "name")
    lines = sinks.report("Corpus", [("Sources", [f"Texts: {d.count()}", n])]).split("\n")[:-1]
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


# --- saved models --------------------------------------------------------------------------------------------------

_n = lambda v: f"{float(v)!r}::DOUBLE"
_ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def _dirichlet_sql(source: str, key: str) -> str:
    """p_toxic and uncertainty of logits z0 and z1."""
    a = ", ".join(f"greatest(z{k}, 0) + ln(1 + exp(-abs(z{k}))) + 1 AS a{k}" for k in range(2))
    return f"SELECT {key}, round(a1 / (a0 + a1), 7) AS p_toxic, round(2 / (a0 + a1), 7) AS uncertainty FROM (SELECT {key}, {a} FROM {source})"


def _outputs(scored: DataFrame, key: str) -> DataFrame:
    return scored.select(key, F.round("prediction.p_toxic", 7).alias("p_toxic"), F.round("prediction.uncertainty", 7).alias("uncertainty"))


def _reloaded(spark: SparkSession, weights: dict) -> dict:
    path = f"{scratch_path(spark, 'weights')}.json"
    evidential.save_weights(weights, path)
    return evidential.load_weights(path)


def _dense(inputs: list[str], layer: evidential.Layer, name: str, relu: bool = True) -> str:
    """Columns <name>0, <name>1, … of a linear layer over columns."""
    w, b = layer
    lines = [" + ".join([_n(b[j]), *(f"{x} * {_n(w[i, j])}" for i, x in enumerate(inputs))]) for j in range(w.shape[1])]
    return ", ".join(f"greatest(0, {line}) AS {name}{j}" if relu else f"{line} AS {name}{j}" for j, line in enumerate(lines))


def _encoder() -> dict:
    r = np.random.default_rng(11)
    some = lambda *shape: np.round(r.normal(size=shape) / 2, 3)
    return {"embedding": some(len(_ALPHABET) + 1, 2), "kernels": [(some(3, 2, 2), some(2)), (some(5, 2, 1), some(1))], "head": [(some(3, 3), some(3)), (some(3, 2), some(2))]}


def _encoder_sql() -> str:
    """A row a letter, its neighbours by window, and the maxima of the kernels' sums."""
    m = _encoder()
    value = lambda c: "CASE t " + " ".join(f"WHEN '{a}' THEN {_n(m['embedding'][i + 1, c])}" for i, a in enumerate(_ALPHABET)) + f" ELSE 0.0::DOUBLE END AS e{c}"
    near = lambda c, d: f"e{c}" if d == 0 else f"coalesce({'lag' if d < 0 else 'lead'}(e{c}, {abs(d)}) OVER w, 0)"
    sums = [" + ".join([_n(b[j]), *(f"{near(c, i - k.shape[0] // 2)} * {_n(k[i, c, j])}" for i in range(k.shape[0]) for c in range(2))]) for k, b in m["kernels"] for j in range(k.shape[2])]
    f = ", ".join(f"greatest(0, {s}) AS f{i}" for i, s in enumerate(sums))
    top = ", ".join(f"coalesce(max(f{i}), 0) AS f{i}" for i in range(3))
    return f"""WITH u AS (SELECT doc_id, upper(replace(coalesce(text, ''), 'ß', 'SS')) AS s FROM documents), c AS (SELECT doc_id, unnest(string_split(s, '')) AS t, unnest(generate_series(1, length(s))) AS i FROM u WHERE s <> ''),
e AS (SELECT doc_id, i, {value(0)}, {value(1)} FROM c), f AS (SELECT doc_id, {f} FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)), x AS (SELECT u.doc_id, {top} FROM u LEFT JOIN f USING (doc_id) GROUP BY u.doc_id),
h AS (SELECT doc_id, {_dense(["f0", "f1", "f2"], m["head"][0], "h")} FROM x), z AS (SELECT doc_id, {_dense(["h0", "h1", "h2"], m["head"][1], "z", False)} FROM h)
{_dirichlet_sql("z", "doc_id")}"""


@register("n1_sequence_model", _encoder_sql())
def n1_sequence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, A-Z and other letters in upper case, under a convolutional model that was saved and loaded."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.coalesce("text", F.lit(""))).alias("s"))
    return _outputs(evidential.encode_batches(d, "s", _reloaded(spark, _encoder()), _ALPHABET), "doc_id")


def _fusion_weights() -> dict:
    r = np.random.default_rng(12)
    some = lambda *shape: np.round(r.normal(size=shape) / 2, 3)
    norm = lambda: (1 + some(4) / 4, some(4))
    return {"norms": [norm() for _ in range(3)], "adapters": [(some(4, 3), some(3)) for _ in range(3)], "joined": (some(12, 4), some(4)), "head": [(some(4, 3), some(3)), (some(3, 2), some(2))], "extra_norm": norm(), "extra_adapter": (some(4, 4), some(4))}


def _fusion_sql() -> str:
    """Four slices of an embedding, each normalised and adapted; three are joined with their product, the fourth is added."""
    m = _fusion_weights()
    norms, adapters = [*m["norms"], m["extra_norm"]], [*m["adapters"], m["extra_adapter"]]
    x = [[f"embedding[{4 * p + i + 1}]::DOUBLE" for i in range(4)] for p in range(4)]
    mean = [f"(({' + '.join(v)}) / 4)" for v in x]
    spread = [f"sqrt(({' + '.join(f'pow({c} - {a}, 2)' for c in v)}) / 4 + 1e-5::DOUBLE)" for v, a in zip(x, mean, strict=True)]
    normed = ", ".join(f"({x[p][i]} - {mean[p]}) / {spread[p]} * {_n(norms[p][0][i])} + {_n(norms[p][1][i])} AS n{p}_{i}" for p in range(4) for i in range(4))
    adapted = ", ".join(_dense([f"n{p}_{i}" for i in range(4)], adapters[p], f"a{p}_") for p in range(4))
    product = ", ".join(f"a0_{i} * a1_{i} * a2_{i} AS p{i}" for i in range(3))
    joined = _dense([*(f"a{p}_{i}" for p in range(3) for i in range(3)), "p0", "p1", "p2"], m["joined"], "j")
    return f"""WITH n AS (SELECT vec_id, {normed} FROM embeddings), a AS (SELECT vec_id, {adapted} FROM n), p AS (SELECT *, {product} FROM a), j AS (SELECT *, {joined} FROM p),
s AS (SELECT vec_id, {", ".join(f"j{i} + a3_{i} AS s{i}" for i in range(4))} FROM j), h AS (SELECT vec_id, {_dense([f"s{i}" for i in range(4)], m["head"][0], "h")} FROM s), z AS (SELECT vec_id, {_dense(["h0", "h1", "h2"], m["head"][1], "z", False)} FROM h)
{_dirichlet_sql("z", "vec_id")}"""


@register("n4_fused_branches", _fusion_sql())
def n4_fused_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches and a further one, slices of the embeddings, under weights that were saved and loaded."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.slice("embedding", 4 * p + 1, 4).alias(f"b{p}") for p in range(4)])
    return _outputs(evidential.fuse_batches(e, ["b0", "b1", "b2"], _reloaded(spark, _fusion_weights()), "b3"), "vec_id")
