"""Every query of the library runs on the smallest tables, and those with SQL agree with it."""

import math
import os

import pytest

from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "is_finite") else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    import duckdb

    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert got
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["t1_span_matrices", "t1_table_function", "t3_table_function", "s27_absolute_links"])
def test_work_on_a_small_file_is_dealt(spark, name):
    """Rows of one small file that cost much Python each are not one task's."""
    assert "RoundRobinPartitioning" in catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
