"""Every query against its DuckDB SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__
from weftline import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(key([r[i] for i in at]) for r in rel.fetchall())
    assert sorted(key(r) for r in df.select(*cols).collect()) == want and want


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).columns == ["word", "n"]
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_outside_imports_llm():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, names in os.walk(os.path.join(root, "weftline")):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert "weftline.llm" not in f.read(), n
