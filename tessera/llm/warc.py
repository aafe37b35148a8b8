"""WARC archives as a Python data source, and duplicate payloads as revisit records.

Archives are sequences of gzip members, a record each, with the skip-length field `sl` in the member's header
(compressed and uncompressed size of the member). The reader inflates the start of a member for the record's headers, tests
the pushed-down predicates, and goes on to the next member without inflating the payload unless it is wanted. Each write leaves
a manifest of its committed files and offsets to cut them at, so large files become several partitions and files of lost or
repeated tasks are never read. Archives of others (.warc, .warc.gz, without manifest or skip lengths) are read file by file.
Damaged records raise, or come as rows that say what is wrong; none is passed over in silence.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from tessera.llm.common import lookup_skewed, materialize, scratch_path, small_batches

MANIFEST = "_warc_manifest"  # and a name of the write's own
#: A file is closed beyond this size, and cut into partitions of about the second.
FILE_BYTES, SPLIT_BYTES = 256_000_000, 32_000_000
CHUNK = 1 << 20
LEVEL = 3
COLUMNS = ["warc_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to"]
_HEADERS = ["WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Refers-To"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", content_length long, payload_length long, file string, offset long, damage string"
WRITE_SCHEMA = "record_id string, warc_type string, target_uri string, refers_to string, payload_sha1 string, payload_length long, payload binary"


def _clean(value: str) -> str:
    """A header value without control characters (percent-encoded)."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_id: str, warc_type: str, target_uri: str | None, refers_to: str | None, payload_sha1: str | None, payload_length: int, payload: bytes | None, date: str) -> bytes:
    """A WARC/1.1 record. Its block is an HTTP response; a revisit has that response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode()
    block = http + (payload or b"" if warc_type != "revisit" else b"")
    head = ["WARC/1.1", f"WARC-Type: {warc_type}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {date}"]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_clean(target_uri)}")
    if payload_sha1:
        head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(payload_sha1)).decode()}")
    if warc_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_clean(refers_to or '')}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with skip lengths, if they fit."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(body)
    if max(size, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own; commit() names in the manifest those of the attempts that count."""

    def __init__(self, options: dict[str, str]):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")
        self.file_bytes, self.split_bytes = int(options.get("filebytes", FILE_BYTES)), int(options.get("splitbytes", SPLIT_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        done, out, entry = Written(), None, None
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        entry = {"name": f"part-{uuid.uuid4().hex}.warc.gz", "size": 0, "splits": [0]}
                        out = where.open_output_stream(f"{root}/{entry['name']}", compression=None)
                    if entry["size"] - entry["splits"][-1] >= self.split_bytes:
                        entry["splits"].append(entry["size"])
                    data = member(record_bytes(**row, date=self.date))
                    out.write(data)
                    entry["size"] += len(data)
                    if entry["size"] >= self.file_bytes:
                        out.close()
                        done.files.append(entry)
                        out = None
        if out is not None:
            out.close()
            done.files.append(entry)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """A manifest of its own for each write: nothing that is read already is replaced."""
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        name = f"{root}/{MANIFEST}-{uuid.uuid4().hex}"
        with where.open_output_stream(name + ".new") as out:
            out.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        where.move(name + ".new", name + ".json")

    def abort(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for entry in (x for m in messages if m for x in m.files):
            where.delete_file(f"{root}/{entry['name']}")


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class _Buffer:
    """A file read ahead in chunks; what is skipped beyond the buffer is not read."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data, self.pos = file, at, b"", 0

    def peek(self, n: int) -> bytes:
        if len(self.data) - self.pos < n:
            self.file.seek(self.at + len(self.data) - self.pos)
            self.data = self.data[self.pos :] + self.file.read(max(CHUNK, n - len(self.data) + self.pos))
            self.pos = 0
        return self.data[self.pos : self.pos + n]

    def skip(self, n: int) -> None:
        self.at += n
        self.pos += n
        if self.pos > len(self.data):
            self.data, self.pos = b"", 0


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if v}


class Damaged(Exception):
    """A record that cannot be read as it should. after: bytes from its start to where the next one may be, if that is known."""

    def __init__(self, what: str, after: int | None = None):
        super().__init__(what)
        self.after = after


def _inflated(buffer: _Buffer, size: int | None) -> Iterator[bytes]:
    """The member at the buffer's place inflated piece by piece, its check sum tested at the end; then the buffer is past it if size is not known."""
    inflate, at = zlib.decompressobj(31), 0
    while not inflate.eof:
        step = 16_384 if at == 0 else CHUNK
        piece = buffer.peek(at + step if size is None else min(size, at + step))[at:]
        if not piece:
            raise Damaged("truncated member", size)
        at += len(piece)
        try:
            got = inflate.decompress(piece)
        except zlib.error as e:
            raise Damaged(str(e), size) from e
        yield got
    if size is None:
        buffer.skip(at - len(inflate.unused_data))


def digest_differs(stated: str | None, payload: bytes) -> bool:
    """If the stated digest (algorithm:value, in base32 or hex) is of another payload; False where it is absent or of an algorithm not known here."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5") or not value:
        return False
    own = hashlib.new(kind.lower(), payload).digest()
    return value.rstrip("=").upper() not in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        said = lambda name: options.get(name, "false").lower() == "true"
        self.path, self.payload, self.verify, self.mode = options["path"].rstrip("/"), said("payload"), said("verify"), options.get("mode", "failfast").lower()
        if self.mode not in ("failfast", "permissive"):
            raise ValueError(f"mode must be failfast or permissive, not {self.mode}")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality, membership, prefix and not-null tests of the header columns are made before a payload is touched."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in COLUMNS and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                self.tests.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            got = row[name]
            if got is None or kind == "EqualTo" and got != value or kind == "In" and got not in value or kind == "StringStartsWith" and not got.startswith(value):
                return False
        return True

    def partitions(self) -> list[Stretch]:
        where, root = fs.FileSystem.from_uri(self.path)
        infos = where.get_file_info(fs.FileSelector(root)) if where.get_file_info(root).type == fs.FileType.Directory else [where.get_file_info(root)]
        manifests = sorted(x.path for x in infos if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))
        if manifests:
            files = [x for m in manifests for x in json.loads(where.open_input_stream(m).read())]
            cut = [(f"{root}/{x['name']}", a, b) for x in files for a, b in zip(x["splits"], [*x["splits"][1:], x["size"]], strict=True)]
        else:
            cut = [(x.path, 0, x.size) for x in infos if re.search(r"\.warc(\.gz)?$", x.path)]
        return [Stretch(*x) for x in cut] or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        names = [*COLUMNS, "content_length", "payload_length", "file", "offset", "damage", *(["payload"] if self.payload else [])]
        kinds = [pa.string()] * len(COLUMNS) + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names) - len(COLUMNS)]
        schema, held, size = pa.schema(list(zip(names, kinds, strict=True))), [], 0
        for row in self.records(partition) if partition.path else ():
            held.append(row)
            size += len(row.get("payload") or b"") + 500
            if size > 8_000_000 or len(held) >= 5_000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    def records(self, p: Stretch) -> Iterator[dict]:
        where, _ = fs.FileSystem.from_uri(self.path)
        with where.open_input_file(p.path) as file:
            buffer = _Buffer(file, p.start)
            while buffer.at < p.end and buffer.peek(2):
                offset, place = buffer.at, {"file": p.path.rpartition("/")[2], "offset": buffer.at}
                try:
                    row = self.gzip_record(buffer) if buffer.peek(2) == b"\x1f\x8b" else self.plain_record(buffer)
                except (Damaged, ValueError) as e:
                    if self.mode == "failfast":
                        raise ValueError(f"damaged record in {p.path} at {offset}: {e}") from e
                    row = dict.fromkeys([*COLUMNS, "content_length", "payload_length"]) | {"damage": str(e)}
                    row = row if self.wanted(row) else None
                    after = getattr(e, "after", None)
                    buffer.skip(offset + after - buffer.at if after else self.next_start(buffer, p.end))
                if row is not None:
                    yield row | place

    @staticmethod
    def next_start(buffer: _Buffer, end: int) -> int:
        """Bytes to the next place that looks like a record's start, or to the end."""
        kinds, at = (b"\x1f\x8b\x08", b"WARC/1."), 1
        while buffer.at + at < end:
            seen = buffer.peek(at + CHUNK)[at:]
            if not seen:
                break
            found = [k for k in (seen.find(kind) for kind in kinds) if k >= 0]
            if found:
                return at + min(found)
            at += max(1, len(seen) - 6)
        return end - buffer.at

    def row(self, head: bytes, more: Callable[[int], bytes]) -> tuple[dict | None, int, int]:
        """The row if it is wanted, the block's length, and the payload's start in it. more(n): the block's first n bytes, at most."""
        if not head.startswith(b"WARC/"):
            raise Damaged("no WARC header")
        fields = _parse(head)
        row: dict = {c: fields.get(h.lower()) for c, h in zip(COLUMNS, _HEADERS, strict=True)}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else row[c]
        length = int(fields.get("content-length", 0))
        row["content_length"] = length
        row["payload_length"], start = length, 0
        if not self.wanted(row):
            return None, length, 0
        if fields.get("content-type", "").startswith("application/http"):
            http, n = b"", 2_048
            while b"\r\n\r\n" not in http and len(http) < length:
                http, n = more(min(n, length)), n * 2
            start = (http.find(b"\r\n\r\n") + 4) if b"\r\n\r\n" in http else length
            stated = _parse(http[:start]).get("content-length", "")
            row["payload_length"] = int(stated) if stated.isdigit() else length - start
        return row, length, start

    def with_payload(self, row: dict, block: bytes, length: int, start: int, after: int | None) -> None:
        if len(block) < length:
            raise Damaged(f"block of {len(block)} bytes, {length} stated", after)
        row["payload"] = block[start:]
        if self.verify and row["warc_type"] != "revisit" and digest_differs(row["payload_digest"], row["payload"]):
            raise Damaged("payload differs from its digest", after)

    def plain_record(self, buffer: _Buffer) -> dict | None:
        n = 4_096
        while (end := (seen := buffer.peek(n)).find(b"\r\n\r\n")) < 0 and len(seen) == n:
            n *= 2
        if end < 0:
            if not seen.strip():  # line ends after the last record
                buffer.skip(len(seen))
                return None
            raise Damaged("no end of header")
        row, length, start = self.row(seen[:end], lambda k: buffer.peek(end + 4 + k)[end + 4 :])
        if row is not None and self.payload:
            self.with_payload(row, buffer.peek(end + 4 + length)[end + 4 :], length, start, end + 4 + length + 4)
        buffer.skip(end + 4 + length)
        if buffer.peek(4) != b"\r\n\r\n":
            buffer.skip(-(end + 4 + length))
            raise Damaged("no end of record")
        buffer.skip(4)
        return row

    def gzip_record(self, buffer: _Buffer) -> dict | None:
        first = buffer.peek(24)
        if len(first) < 18:
            raise Damaged("truncated member")
        size = struct.unpack("<I", first[16:20])[0] if first[3] & 4 and first[12:14] == b"sl" else None
        pieces, data = _inflated(buffer, size), b""

        def upto(n: int) -> bytes:
            nonlocal data
            while len(data) < n and (piece := next(pieces, None)) is not None:
                data += piece
            return data

        n = 4_096
        while (end := upto(n).find(b"\r\n\r\n")) < 0 and len(data) >= n:
            n *= 2
        if end < 0:
            raise Damaged("no end of header", size)
        row, length, start = self.row(data[:end], lambda k: upto(end + 4 + k)[end + 4 : end + 4 + k])
        if row is not None and self.payload:
            block = b"".join([data, *pieces])[end + 4 : end + 4 + length]
            self.with_payload(row, block, length, start, size)
        if size is None:
            for _ in pieces:  # without skip lengths the end is found by inflating
                pass
        else:
            buffer.skip(size)
        return row


class WarcSource(DataSource):
    """format("warc"). Options: path; reading: payload (false: headers only), verify (payloads against their digests), mode; writing: date, filebytes, splitbytes.

    Rows: the header columns (null if absent), content_length, payload_length (as the HTTP headers state it), file, offset, damage, and
    payload if asked for. A record that cannot be read, or whose payload verify finds changed, raises (mode failfast); with mode permissive it is
    a row of nulls with its place and what is wrong in damage. Only what a query reads of a record is tested. Rows to write have WRITE_SCHEMA. An
    empty folder gives no rows. Paths: of the schemes that pyarrow's file systems know (file, hdfs, s3, gs, abfs).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA + (", payload binary" if self.options.get("payload", "false").lower() == "true" else "")

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session. Sets two things in it that stay: filters are pushed to Python sources, and small Arrow batches."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small_batches(spark)
    spark.dataSource.register(WarcSource)


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows of WRITE_SCHEMA, one for each page: of equal payloads of least_bytes or more, the row with the largest id is the response.

    Null payloads are empty. Smaller payloads are all responses. Rows that repeat the largest id are responses too; null ids
    come below all others and, where all are null, are responses. Payloads are equal if SHA-1, SHA-256 and length are. An empty table
    gives an empty result; a payload of any length is one record; columns beside the three named are not read.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("key", F.concat("sha1", F.sha2("payload", 256)))
    groups = rows.where(F.col("length") >= least_bytes).groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    repeated = materialize(groups.where("n > 1"), "warc-groups")  # so payloads are read and hashed twice, not three times
    total = pages.count()
    joined = lookup_skewed(rows, repeated, "key", "n", total)
    revisit = F.col("top").isNotNull() & ((F.col("id") != F.col("top")) | F.col("id").isNull())
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("top"))).alias("refers_to"), F.col("sha1").alias("payload_sha1"), F.col("length").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT DISTINCT x FROM p),
c AS (SELECT x, unnest(generate_series(0, 31)) AS i FROM d),
v AS (SELECT x, i, (instr('0123456789abcdef', substr(x, 5 * i // 4 + 1, 1)) - 1) * 16 + greatest(0, instr('0123456789abcdef', substr(x || '0', 5 * i // 4 + 2, 1)) - 1) AS two FROM c),
b AS (SELECT x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(two // CASE 5 * i % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END % 32 + 1 AS INT), 1), '' ORDER BY i) AS digest FROM v GROUP BY x),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, b.digest AS payload_digest, CASE WHEN p.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> m.top THEN m.top END AS refers_to
FROM p JOIN b ON p.x = b.x JOIN m ON p.h = m.h
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, whose digests are tested; revisits by a pushed predicate, headers only."""
    register(spark)
    path = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive_records(pages).write.format("warc").mode("append").save(path)
    return read_back(spark, path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The query's columns from an archive of pages: of responses by the payload itself, of revisits by the header."""
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*)$", 1), F.lit("")).cast("long")
    read = lambda **options: spark.read.format("warc").options(**options).load(path)
    columns = lambda size: [page("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to")]
    responses = read(payload="true", verify="true").where("warc_type = 'response'").select(*columns(F.octet_length("payload")))
    return responses.unionByName(read().where("warc_type = 'revisit'").select(*columns(F.col("payload_length"))))
