"""Files of records that start with > at a line's start (FASTA, A3M, cluster text) as a Python data source, cut at records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.text import MODEL_ALPHABET
from tessera.operators.running import number_by_place

SPLIT_BYTES = 64_000_000
CHUNK = 1 << 20


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"].rstrip("/"), int(options.get("splitbytes", SPLIT_BYTES))

    def _fs(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if re.match(r"^\w+:/", self.path) else f"file://{self.path}")

    def partitions(self) -> list[_Range]:
        where, root = self._fs()
        info = where.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        cut = [_Range(f.path, a, min(a + self.split, f.size)) for f in files for a in range(0, f.size, self.split)]
        return cut or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = self._fs()
        held: list[tuple] = []
        with where.open_input_file(partition.path) as f:
            for offset, record in self._records(f, partition.start, partition.end):
                header, _, body = record.decode("utf-8", "ignore").partition("\n")
                held.append((partition.path, offset, header.strip(), body))
                if len(held) >= 2000:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "offset", "header", "body"])

    @staticmethod
    def _records(f: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """Records whose > stands in [start, end); what precedes the first one is no record."""
        at = max(0, start - 1)
        f.seek(at)
        data, base = (b"\n" if at == start else b"") + f.read(CHUNK), at - (at == start)
        mark = data.find(b"\n>")
        while True:
            while mark < 0:
                more = f.read(CHUNK)
                if not more:
                    return
                base, data = base + len(data) - 1, data[-1:] + more
                mark = data.find(b"\n>")
            if base + mark + 1 >= end:
                return
            nxt = data.find(b"\n>", mark + 1)
            while nxt < 0:
                more = f.read(CHUNK)
                if not more:
                    break
                seen = len(data)
                data += more
                nxt = data.find(b"\n>", max(mark + 1, seen - 1))
            yield base + mark + 1, data[mark + 2 : nxt if nxt >= 0 else len(data)].replace(b"\r", b"")
            if nxt < 0:
                return
            base, data, mark = base + nxt, data[nxt:], 0


class RecordSource(DataSource):
    """format("records"): file, offset, header, body. Options: path (a file or folder), splitbytes."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "file string, offset long, header string, body string"

    def reader(self, schema: object) -> _Reader:
        return _Reader(dict(self.options))


def read_records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").option("splitbytes", str(split_bytes)).load(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, header, sequence): bodies joined over lines, without white space."""
    return read_records(spark, path).select("file", "offset", "header", F.regexp_replace("body", r"\s+", "").alias("sequence"))


def record_id(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S*)", 1)


#: How a header gives the label, by layout; null where it doesn't.
LABELS = {
    "prefix": lambda h: F.when(F.lower(h).startswith("pos"), 1).when(F.lower(h).startswith("neg"), 0),
    "suffix": lambda h: F.when(F.element_at(F.split(h, r"\|"), -1).isin("0", "1"), F.element_at(F.split(h, r"\|"), -1).try_cast("int")),
    "last_token": lambda h: F.when(F.element_at(F.split(F.trim(h), r"\s+"), -1).isin("0", "1"), F.element_at(F.split(F.trim(h), r"\s+"), -1).try_cast("int")),
}


def load_source(spark: SparkSession, spec: dict) -> DataFrame:
    """Raw records of a source (dataset_id, project, level, split, file_path, label_rule): 8 columns.

    label_rule: csv (columns sequence and label, which must be 0 or 1), prefix, suffix, last_token, or constant:0 / constant:1.
    """
    rule = spec["label_rule"]
    if rule == "csv":
        rows = number_by_place(read_labelled_csv(spark, spec["file_path"]), "_order").select("sequence", "label", F.concat(F.lit("row_"), F.col("number")).alias("source_id"))
    elif rule in LABELS or rule.startswith("constant:"):
        fasta = read_fasta(spark, spec["file_path"])
        label = LABELS[rule](F.col("header")) if rule in LABELS else F.lit(int(rule.partition(":")[2]))
        rows = fasta.select("sequence", label.cast("int").alias("label"), record_id(F.col("header")).alias("source_id"))
    else:
        raise ValueError(f"unknown label rule {rule!r}")
    return rows.select("sequence", "label", F.lit(spec["dataset_id"]).alias("source_dataset"), F.lit(spec["project"]).alias("source_project"), F.lit(spec["level"]).alias("source_level"), F.lit(spec["split"]).alias("source_split"), F.lit(spec["file_path"]).alias("source_file"), "source_id")


def load_sources(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """All sources as one table."""
    out = load_source(spark, specs[0])
    for spec in specs[1:]:
        out = out.unionByName(load_source(spark, spec))
    return out


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def csv_reader(spark: SparkSession, sep: str = ",", multi_line: bool = True) -> DataFrameReader:
    """Cells in double quotes may hold separators and, doubled, quotes. multi_line: also line ends, and then each file is read by one task; without it large files are cut."""
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def read_labelled_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """sequence, label (0 or 1, else an error), _order; other columns as text. multi_line: as for csv_reader()."""
    raw = require_columns(csv_reader(spark, multi_line=multi_line).csv(path), "sequence", "label")
    label = F.col("label").try_cast("int")
    checked = F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.concat(F.lit("label is not 0 or 1: "), F.coalesce("label", F.lit("null")))).cast("int"))
    return raw.withColumn("label", checked).withColumn("_order", F.monotonically_increasing_id())


def read_text_table(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A CSV or TSV of unknown columns: all text, nothing read as null. multi_line: as for csv_reader()."""
    return csv_reader(spark, sep, multi_line).option("inferSchema", False).option("nullValue", "\0").csv(path)


def read_alignment(spark: SparkSession, path: str, most: int = 2048, same_width: bool = True) -> DataFrame:
    """(aln_id, row, aligned) of A3M files: inserted (lower-case) letters and * go, . and unknown letters become -; the first `most` rows, those of the first row's width only if same_width."""
    rows = read_records(spark, path).withColumn("row", F.row_number().over(W.partitionBy("file").orderBy("offset")) - 1).where(F.col("row") < most)
    a = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", r"\s+", ""), "[a-z*]", ""), f"[^{MODEL_ALPHABET}-]", "-")
    out = rows.select(F.col("file").alias("aln_id"), "row", a.alias("aligned"))
    if not same_width:
        return out
    first = F.first(F.length("aligned")).over(W.partitionBy("aln_id").orderBy("row"))
    return out.withColumn("w", first).where(F.length("aligned") == F.col("w")).drop("w")
