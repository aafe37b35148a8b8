"""Writers. Spark commits a folder of files atomically; nothing passes through the driver but reports of bounded size."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clip


def _csv(df: DataFrame, mode: str = "errorifexists") -> DataFrameWriter:
    return df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _csv(df, mode).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Each append adds files with a header of their own, which readers skip."""
    write_csv(df, path, "append")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_fasta(df: DataFrame, path: str, id_col: str = "seq_id", seq_col: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("value")).write.text(path)


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    _csv(df).partitionBy(split).csv(path)


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Leaves an existing result alone unless told to overwrite it."""
    write_csv(df, path, "overwrite" if overwrite else "ignore")


def clipped(df: DataFrame, columns: tuple[str, ...] = ("entity", "snippet", "context"), longest: int = 2000) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), longest) for c in columns if c in df.columns})


def write_catalogue(spark: SparkSession, specs: list[dict], path: str) -> None:
    names = ["dataset_id", "project", "level", "split", "file_path", "label_rule"]
    write_csv(spark.createDataFrame([tuple(s[n] for n in names) for s in specs], ", ".join(f"{n} string" for n in names)), path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def stats_json(stats: DataFrame) -> str:
    """A one-row table as JSON with an indent of 2, non-ASCII kept."""
    return json.dumps(stats.first().asDict(recursive=True), indent=2, ensure_ascii=False, default=str)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """The first rows as a Markdown table, | escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(most).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def report(title: str, sections: list[tuple[str, list[str | DataFrame]]], most: int = 30) -> str:
    """Markdown: a heading for each section, and below it lines, and tables of `most` rows at most."""
    out = [f"# {title}"]
    for name, parts in sections:
        out += ["", f"## {name}"]
        for part in parts:
            out += [f"- {part}"] if isinstance(part, str) else ["", markdown_table(part, most), ""]
    return "\n".join(out) + "\n"


def save_index(postings: DataFrame, idf: DataFrame, path: str) -> None:
    """A retrieval index as Parquet, postings sorted by gram for pruning."""
    postings.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/postings")
    idf.write.parquet(f"{path}/idf")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/idf")


def save_bucketed(df: DataFrame, path: str, by: str, buckets: int) -> None:
    """Parquet below a path, dealt to buckets by the hash of `by` and sorted in each, so that joins on `by` need not move it. What is there already is an error."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", f"{path}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files have a path of their own
    # Written last: a folder without it is of a run that broke off.
    spark.sql(f"SELECT '{by}' AS by, {int(buckets)} AS buckets").coalesce(1).write.json(f"{path}/about")


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """What save_bucketed() wrote, in any session, known to Spark as bucketed: a table of a new name over the same files."""
    about = spark.read.schema("by string, buckets int").json(f"{path}/about").first()
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema.fields)
    location = f"{path}/rows".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{about['by']}`) SORTED BY (`{about['by']}`) INTO {about['buckets']} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def save_search_index(postings: DataFrame, idf: DataFrame, path: str, buckets: int = 64) -> None:
    """A retrieval index for lookups of new queries: postings and idf bucketed by gram."""
    save_bucketed(postings, f"{path}/postings", "gram", buckets)
    save_bucketed(idf, f"{path}/idf", "gram", buckets)


def open_search_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return open_bucketed(spark, f"{path}/postings"), open_bucketed(spark, f"{path}/idf")
