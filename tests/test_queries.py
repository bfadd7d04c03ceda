"""Every registered reference query against its SQL on the smallest tables, and the driver contract."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from ledgerloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


def cell(v):
    """Comparable form of a value: nested values by their parts, floats rounded, NaN as null."""
    if isinstance(v, dict):
        return {k: cell(x) for k, x in v.items()}
    if isinstance(v, list):
        return [cell(x) for x in v]
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v if v is None else str(v)


def comparable(found):
    """Rows of an Arrow table as sorted texts; Arrow keeps nullable integers whole and nulls apart from NaN."""
    names = sorted(found.column_names)
    return sorted(repr([cell(row[c]) for c in names]) for row in found.to_pylist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    found = QUERIES[name](spark, SF).toArrow()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.sql(ORACLES[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(expected.column_names)
    assert comparable(found) == comparable(expected)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_llm():
    code = "import sys; sys.modules['ledgerloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op1_') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), "False", "False"]
    users = [p for p in (ROOT / "ledgerloom").rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
    assert users == []
