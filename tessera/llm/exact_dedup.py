"""Exact dedup by sorting content: ranges from sampled splitters, an external sort in each, neighbours compared.

Rows are ordered by their whole normalised texts in UTF-8. Splitters come from a sample, weighed by size, and cut the order into
ranges; only in a splitter is a text cut, to its first characters, with a hash of the whole and the id to tell apart what
agrees in these. So splitters stay short, and a text with very many copies is cut into several ranges by id. In
a range all rows are sorted by whole text, and neighbours are compared whole. A run of equal texts may go on in another range
only if it agrees with a splitter of its range in first characters and hash; those runs, two a range, are joined by whole text.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tessera.llm.common import materialize, partitions, small_batches, tidied, whole_id

#: Characters of a text in a splitter; rows sampled for each range, and in all: what the driver holds is bounded.
CUT_CHARS = 128
SAMPLED, SAMPLE_ROWS = 40, 200_000
BATCH = 4096
NO_ID = -(2**63)
RUNS = "id long, digest string, part int, run int, lead boolean, keep long, n long, edge_text string"

#: First characters, hash of the whole text, id missing, id.
Splitter = tuple[str, int, bool, int]


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalised(text: Column, how: str) -> Column:
    """how: none, whitespace (runs to one space, trimmed), lower (whitespace and lower case), or nfkc."""
    text = F.coalesce(text, F.lit(""))
    if how == "none":
        return text
    if how == "nfkc":
        return F.pandas_udf(_nfkc, "string")(text)
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.lower(text) if how == "lower" else text


def choose_splitters(sample: list[tuple[Splitter, int]], ranges: int) -> list[Splitter]:
    """Of a sample of keys with their sizes, those that cut it into ranges of about the same size."""
    sample = sorted(sample)
    upto = list(accumulate(size for _, size in sample))
    return sorted({sample[bisect_left(upto, upto[-1] * k / ranges)][0] for k in range(1, ranges)}) if sample else []


def _ranged(rows: DataFrame, ranges: int, cut: int) -> tuple[DataFrame, list[Splitter]]:
    """Rows sorted by text in ranges of the order of texts, and the splitters between these."""
    key = [F.substring("text", 1, cut).alias("cut"), F.xxhash64("text").alias("tie"), F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(NO_ID)).alias("whole")]
    total = rows.count()
    wanted = min(SAMPLED * ranges, SAMPLE_ROWS)
    sample = rows.select(*key, (F.octet_length("text") + 200).alias("size")).sample(min(1.0, wanted / max(1, total)), seed=7).collect() if ranges > 1 else []
    splitters = choose_splitters([(tuple(r)[:4], r[4]) for r in sample], ranges)

    def place(first: pd.Series, tie: pd.Series, unnamed: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(splitters, k) for k in zip(first, tie.tolist(), unnamed.tolist(), whole.tolist(), strict=True)], dtype="int32")

    placed = rows.withColumn("part", F.pandas_udf(place, "int")(*key)) if splitters else rows.withColumn("part", F.lit(0))
    return placed.repartitionById(ranges, F.col("part")), splitters


def _find_runs(batches: Iterator[pa.RecordBatch], carried: pa.DataType | None, splitters: list[Splitter], cut: int) -> Iterator[pa.RecordBatch]:
    """Rows in sort order to rows with their run. Holds one run's ids, one text and one carried row at a time."""
    fields = [("id", pa.int64()), ("digest", pa.string()), ("part", pa.int32()), ("run", pa.int32()), ("lead", pa.bool_()), ("keep", pa.int64()), ("n", pa.int64()), ("edge_text", pa.string())]
    schema = pa.schema(fields + ([("row", carried)] if carried else []))
    out: list[list] = [[] for _ in schema]
    part, run, text, tie, row, ids = -1, -1, None, 0, None, []

    def flush() -> None:
        ends = [s[:2] for s in splitters[max(0, part - 1) : part + 1]]
        edge = (text[:cut], tie) in ends
        kept, digest = ids[0], hashlib.sha256(text.encode()).hexdigest()  # the sort puts the id that stays first, nulls last
        for i, x in enumerate(ids):
            for column, value in zip(out, (x, digest, part, run, i == 0, kept, len(ids), text if edge and i == 0 else None, row if i == 0 else None), strict=False):
                column.append(value)

    def batch_of(n: int) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c[:n], f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        for c in out:
            del c[:n]
        return made

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            rows = piece.column("row").to_pylist() if carried else [None] * piece.num_rows
            for x, t, p, h, r in zip(*(piece.column(k).to_pylist() for k in ("id", "text", "part", "tie")), rows, strict=True):
                if t != text or run < 0:
                    if run >= 0:
                        flush()
                    part, run, text, tie, row, ids = p, run + 1, t, h, r, []
                ids.append(x)
            while len(out[0]) >= BATCH:
                yield batch_of(BATCH)
    if run >= 0:
        flush()
    while out[0]:
        yield batch_of(BATCH)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: str | Callable[[Column], Column] = "none", carry: list[str] | None = None, cut_chars: int = CUT_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8).

    Of rows with equal normalised texts the one with the smallest (or largest) id is kept; where rows repeat
    with the same id and text, one of them; a null id only where all are null. A null text counts as empty.
    Other columns are not read, but those named in carry, which come back as struct `row` where a row leads its run, as
    every kept row does. An empty table gives an empty result. Ids are whole numbers (others are an error). A text of any length is
    compared whole; a task holds one text, its copies' ids and a batch at a time. Copies that share one id, too, stay in one range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    how = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) if callable(normalise) else normalised(F.col(f"`{text_col}`"), normalise)
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(whole_id(docs, id_col).alias("id"), how.alias("text"), *row)
    schema = StructType([*_parse_datatype_string(RUNS).fields, *([StructField("row", rows.schema["row"].dataType)] if carry else [])])
    carried = to_arrow_type(rows.schema["row"].dataType) if carry else None
    ranged, splitters = _ranged(rows, partitions(spark), cut_chars)
    ordered = ranged.sortWithinPartitions("text", F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last())
    runs = ordered.withColumn("tie", F.xxhash64("text")).mapInArrow(tidied(lambda it: _find_runs(it, carried, splitters, cut_chars)), schema)
    runs = materialize(runs, "runs")

    best = F.max if keep == "largest" else F.min
    ends = runs.where("edge_text IS NOT NULL").groupBy("edge_text")
    first = F.struct((F.col("keep") if keep == "smallest" else -F.col("keep")).alias("k"), "part", "run")
    ends = ends.agg(best("keep").alias("end_keep"), F.sum("n").alias("end_n"), F.min(F.when(F.col("keep").isNotNull(), first)).alias("f"), F.min(F.struct("part", "run")).alias("g"), F.collect_list(F.struct("part", "run")).alias("at"))
    ends = ends.select("end_keep", "end_n", F.coalesce("f.part", "g.part").alias("in_part"), F.coalesce("f.run", "g.run").alias("in_run"), F.explode("at").alias("at"))
    # Two runs a range, whatever the input (and such as share first characters and a 64-bit hash with one of them).
    ends = F.broadcast(ends.select(F.col("at.part").alias("part"), F.col("at.run").alias("run"), "end_keep", "end_n", "in_part", "in_run"))
    whole = runs.drop("edge_text").join(ends, ["part", "run"], "left")
    inside = F.col("in_part").isNull()
    return whole.select(
        F.col("id").alias(id_col),
        F.when(inside, F.col("keep")).otherwise(F.col("end_keep")).alias("keep_id"),
        F.when(inside, F.col("n")).otherwise(F.col("end_n")).alias("group_size"),
        (F.col("lead") & (inside | ((F.col("part") == F.col("in_part")) & (F.col("run") == F.col("in_run"))))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def drop_copies(docs: DataFrame, **options: object) -> DataFrame:
    """The kept rows with all their columns. Options as for exact_groups()."""
    return exact_groups(docs, carry=docs.columns, **options).where("kept").select("row.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")
