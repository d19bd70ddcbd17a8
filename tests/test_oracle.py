"""Every query of the library against its DuckDB SQL on the smallest tables; queries without SQL must run."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from newsgrid.plans import ORACLE_SQL, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    order = sorted(df.columns)
    got = Counter(str([plain(r[c]) for c in order]) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    result = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == order
    want = Counter(str([plain(r[columns.index(c)]) for c in order]) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
