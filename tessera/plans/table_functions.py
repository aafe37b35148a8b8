"""Table functions called from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import table_functions
from tessera.operators.tables import dealt
from tessera.plans.catalog import register


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    table_functions.register(spark)
    return spark.sql(text, part=dealt(spark.read.parquet(f"{sf_dir}/part.parquet")))  # a small file, but much work a row


@register(
    "f9_table_function",
    """SELECT p_partkey, 'IC50 ' || p_size || ' ± 2 µM' AS raw, 'IC50' AS endpoint, '' AS cmp, p_size::DOUBLE AS value, 2.0::DOUBLE AS error, NULL::DOUBLE AS range_low, NULL::DOUBLE AS range_high, 'µM' AS unit FROM part
UNION ALL SELECT p_partkey, '5-' || p_size + 6, 'MIC', '', NULL, NULL, 5.0, (p_size + 6)::DOUBLE, 'mg/L' FROM part WHERE p_size % 2 = 0""",
)
def f9_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with hints, of rows that hold one, two and (nulls) none."""
    notes = "SELECT p_partkey, concat('IC50 ', p_size, ' ± 2 µM') AS note FROM {part} UNION ALL SELECT p_partkey, if(p_size % 2 = 0, concat('seen: 5-', p_size + 6, '; x1'), NULL) AS note FROM {part}"
    return _sql(spark, sf_dir, f"SELECT * FROM measurements(TABLE({notes}), text_col => 'note', endpoint => 'MIC', unit => 'mg/L')")


@register(
    "t1_table_function",
    """SELECT p_partkey, unnest([0, 0, 1])::INT AS table_no, unnest([0, 1, 0])::INT AS row_no, unnest(['a' || p_size || '|b|b', 'a' || p_size || '|c|d', p_name || '|' || p_brand]) AS cells FROM part""",
)
def t1_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables a page, one of them with spans."""
    pages = """SELECT p_partkey, concat('<table><tr><td rowspan=2>a', p_size, '</td><td colspan=2>b</td></tr><tr><td>c</td><td> d </td></tr></table><table><tr><td>', p_name, '</td><td>', p_brand, '</td></tr></table>') AS html FROM {part}"""
    return _sql(spark, sf_dir, f"SELECT p_partkey, table_no, row_no, array_join(cells, '|') AS cells FROM html_rows(TABLE({pages}), html_col => 'html')")


@register(
    "t3_table_function",
    """SELECT p_partkey AS doc, 't' AS table_id, unnest(['pepa', 'pepb', 'pepa', 'pepb']) AS norm_id, unnest(['MIC (µM)', 'MIC (µM)', 'MBC (µM)', 'MBC (µM)']) AS condition, unnest(['MIC', 'MIC', 'MBC', 'MBC']) AS endpoint, '' AS cmp,
unnest([p_size, p_size + 1, p_size + 2, p_size + 3])::DOUBLE AS value, 'µM' AS unit FROM part""",
)
def t3_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables given row by row, in no order: the function asks for them by table."""
    cells = "array('Strain', 'Pep-A', 'Pep-B'), array('MIC (µM)', string(p_size), string(p_size + 1)), array('Geometric mean', string(p_size), string(p_size)), array('MBC (µM)', string(p_size + 2), string(p_size + 3))"
    rows = f"SELECT p_partkey AS doc, 't' AS table_id, row_no, cells FROM {{part}} LATERAL VIEW posexplode(array({cells})) r AS row_no, cells"
    return _sql(spark, sf_dir, f"SELECT * FROM transposed_values(TABLE({rows}), known => 'pepa,pepb')")
