"""Every registered query of the rule engine against its SQL, at the smallest scale."""

import glob
import os

import pytest

import __spark_entry__
from emberline import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    number = lambda v: round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(number, r)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["o", "l", "p"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
