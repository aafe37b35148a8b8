"""Table functions in SQL: schemas, edge rows, errors of analysis, whole tables in one task."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import measure, table_functions


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return lambda text, **tables: spark.sql(text, **tables)


def test_measurements_as_the_column_function_gives_them(spark, sql):
    rows = [(1, "LC50 3 µM and 4-5 mg/mL at pH 7"), (2, None), (3, ""), (4, "no number"), (4, "MIC <0.5 nM"), (4, "MIC <0.5 nM"), (5, "x " * 20_000 + "MIC 7 µM")]
    t = spark.createDataFrame(rows, "id long, note string")
    got = sql("SELECT * FROM measurements(TABLE({t}), text_col => 'note')", t=t)
    want = t.select("id", F.inline(measure.measurements(F.col("note"))))
    assert got.schema.names == want.schema.names
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert sql("SELECT * FROM measurements(TABLE({t}), text_col => 'note')", t=t.limit(0)).count() == 0


def test_errors_at_analysis(spark, sql):
    t = spark.createDataFrame([(1, "x", 2.0)], "id long, note string, value double")
    for call in ("text_col => 'nothing'", "text_col => 'note'"):  # no such column; value would be there twice
        with pytest.raises(AnalysisException):
            sql("SELECT * FROM measurements(TABLE({t}), " + call + ")", t=t).schema  # noqa: B018
    with pytest.raises(AnalysisException):
        sql("SELECT * FROM transposed_values(TABLE({t}), known => 'a')", t=t).schema  # noqa: B018


def test_html_rows(spark, sql):
    t = spark.createDataFrame([(1, "<table><tr><td>a<td>b</table>"), (2, None), (3, "<p>text"), (4, "<table><tr><th colspan=2>h</th></tr><tr><td>1</td><td>2</td></tr></table>")], "id long, html string")
    got = sql("SELECT * FROM html_rows(TABLE({t}), html_col => 'html')", t=t).collect()
    assert {(r.id, r.table_no, r.row_no, *r.cells) for r in got} == {(1, 0, 0, "a", "b"), (4, 0, 0, "h", "h"), (4, 0, 1, "1", "2")}


def test_transposed_values_by_table(spark, sql):
    cells = [["Strain", "Pep-A", "Pep-B"], ["MIC (µM)", "1", "<2"], ["TI", "9", "9"]]
    rows = [(d, t, i, c) for d in ("x", None) for t in ("t1", "t2") for i, c in enumerate(cells)] + [("x", "t3", 0, None), ("y", "t1", 0, ["one", None])]
    t = spark.createDataFrame(rows, "doc string, table_id string, row_no int, cells array<string>").repartition(4)
    got = sql("SELECT * FROM transposed_values(TABLE({t}), known => 'pepa,pepb')", t=t).collect()
    want = [(d, t, n, c, v) for d in ("x", None) for t in ("t1", "t2") for n, c, v in (("pepa", "", 1.0), ("pepb", "<", 2.0))]
    assert sorted(((r.doc, r.table_id, r.norm_id, r.cmp, r.value) for r in got), key=repr) == sorted(want, key=repr)
