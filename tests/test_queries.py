"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def normal(table):
    cols = sorted(table.column_names)
    text = lambda x: "∅" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return cols, sorted(tuple(map(text, r)) for r in zip(*[table.column(c).to_pylist() for c in cols]))


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, str(SF))
    assert normal(df.toArrow()) == normal(con.sql(SQL[name]).to_arrow_table())
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SQL))
def test_runs(spark, name):
    df = entry.queries()[name](spark, str(SF))
    assert len(df.schema) > 0
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_imports_llm():
    root = Path(entry.__file__).parent / "chronolake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"chronolake\.llm|from \.llm|import llm", p.read_text()), p
