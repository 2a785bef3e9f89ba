"""Every registered query that has SQL gives the SQL's rows at the smallest scale; the entry points work without the optional folders."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "events", "labels", "conversations", "benchmark")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def rows_of(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def names():
    from tagloom.plans.oracles import oracle_sql

    return sorted(oracle_sql())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from tagloom.plans.oracles import oracle_sql
    from tagloom.plans.queries import queries

    df = queries()[name](spark, DATA)
    r = duck.execute(oracle_sql()[name])
    columns = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(r.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4


def test_import_needs_no_session_and_no_llm():
    code = "import sys; sys.modules['tagloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    n, m = map(int, done.stdout.split())
    assert n >= m > 40
