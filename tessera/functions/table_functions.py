"""Table functions for SQL: measurements, tables of HTML, records of transposed tables.

register(spark) makes them known to a session. Each takes a table and says its own schema: the table's columns but the one that it reads,
followed by what it found. A row that holds nothing gives no row; null and empty texts hold nothing. A column that the function needs and
that is not there, or one with the name of a result's, is an error of the query's analysis.

    SELECT * FROM measurements(TABLE(notes), text_col => 'note', unit => 'mg/mL')
    SELECT * FROM html_rows(TABLE(pages), html_col => 'html')
    SELECT * FROM transposed_values(TABLE(SELECT doc, table_id, row_no, cells FROM t), known => 'pepa,pepb')
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tessera.functions.measure import parse_measurements
from tessera.operators.tables import html_tables, transposed_records


def _fields(**types: object) -> list[StructField]:
    return [StructField(name, kind) for name, kind in types.items()]


#: Columns that the functions add. Types are written out, as the workers of the analysis have no session to read them from text.
TEXT, NUMBER = StringType(), DoubleType()
FOUND = _fields(raw=TEXT, endpoint=TEXT, cmp=TEXT, value=NUMBER, error=NUMBER, range_low=NUMBER, range_high=NUMBER, unit=TEXT)
CELLS = _fields(table_no=IntegerType(), row_no=IntegerType(), cells=ArrayType(TEXT))
VALUES = _fields(norm_id=TEXT, condition=TEXT, endpoint=TEXT, cmp=TEXT, value=NUMBER, unit=TEXT)


def _schema(table: AnalyzeArgument, needed: list[str], dropped: list[str], found: list[StructField]) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    missing = [n for n in needed if n not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    kept = [f for f in table.dataType.fields if f.name not in dropped]
    clash = {f.name.lower() for f in kept} & {f.name for f in found}
    if clash:
        raise ValueError(f"columns named as the result's: {', '.join(sorted(clash))}")
    return StructType(kept + found)


def _constant(argument: AnalyzeArgument | None, name: str) -> str:
    if argument is None or not isinstance(argument.value, str):
        raise ValueError(f"{name} must be a constant text")
    return argument.value


def _kept(row: Row, dropped: str) -> list:
    return [v for n, v in zip(row.__fields__, row, strict=True) if n != dropped]


class Measurements:
    """A row for each measurement of a text column; endpoint and unit are hints where the text names none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text_col: AnalyzeArgument, endpoint: AnalyzeArgument | None = None, unit: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = _constant(text_col, "text_col")
        return AnalyzeResult(_schema(table, [name], [name], FOUND))

    def eval(self, table: Row, text_col: str, endpoint: str = "", unit: str = "") -> Iterator[tuple]:
        found = parse_measurements(table[text_col], endpoint or "", unit or "")
        if found:
            kept = _kept(table, text_col)
            for m in found:
                yield (*kept, *m.values())


class HtmlRows:
    """A row for each row of each HTML table: table_no and row_no from 0, cells with spans written out."""

    @staticmethod
    def analyze(table: AnalyzeArgument, html_col: AnalyzeArgument) -> AnalyzeResult:
        name = _constant(html_col, "html_col")
        return AnalyzeResult(_schema(table, [name], [name], CELLS))

    def eval(self, table: Row, html_col: str) -> Iterator[tuple]:
        kept = _kept(table, html_col)
        for n, matrix in enumerate(html_tables(table[html_col] or "")):
            for i, cells in enumerate(matrix):
                yield (*kept, n, i, cells)


class TransposedValues:
    """Values of tables with ids in columns and conditions in rows; known: the ids, comma-separated.

    Takes doc, table_id, row_no and cells, and no other columns. The function itself asks for all rows of a (doc, table_id) in one task,
    by row_no; a table is held whole there. Tables with a null doc or table_id are tables like any other.
    """

    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.key: tuple | None = None
        self.known: set[str] = set()

    @staticmethod
    def analyze(table: AnalyzeArgument, known: AnalyzeArgument) -> AnalyzeResult:
        _constant(known, "known")
        names = ["doc", "table_id", "row_no", "cells"]
        schema = _schema(table, names, ["row_no", "cells"], VALUES)
        if schema.names[:2] != names[:2] or len(table.dataType.names) != 4:
            raise ValueError(f"the table's columns must be {', '.join(names)}, in this order")
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc"), PartitioningColumn("table_id")], orderBy=[OrderingColumn("row_no")])

    def eval(self, table: Row, known: str) -> None:
        self.key, self.known = (table["doc"], table["table_id"]), set(known.split(","))
        self.rows.append([c or "" for c in table["cells"] or []])

    def terminate(self) -> Iterator[tuple]:
        if self.key is None:
            return
        width = max(map(len, self.rows))
        rows = [r + [""] * (width - len(r)) for r in self.rows]
        t = {"doc": self.key[0], "table_id": self.key[1], "label": "", "caption": "", "foot": "", "rows": rows}
        for x in transposed_records(t, self.known):
            yield (*self.key, *(x.get(n) for n in ("norm_id", "condition", "endpoint", "cmp", "value", "unit")))


def register(spark: SparkSession) -> None:
    """Make measurements(), html_rows() and transposed_values() known to the session; registering again changes nothing."""
    for name, handler in (("measurements", Measurements), ("html_rows", HtmlRows), ("transposed_values", TransposedValues)):
        spark.udtf.register(name, udtf(handler))
