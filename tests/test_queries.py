"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from corpusmill.plans.oracles import ORACLES
from corpusmill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def cells(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in (row[i] for i in at)) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(got.columns)
        assert cells(rows, got.columns, columns) == cells(found.fetchall(), columns, columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {r["split"] for r in entry.entry(spark).collect()} == {"train", "validation"}
