"""Every registered reference query against the SQL that states its result."""

import os

import duckdb
import pytest

from termweave import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    rel = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())


def test_the_library_stands_without_the_removable_parts():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(here, "termweave")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "termweave.llm" not in open(os.path.join(folder, f)).read()
