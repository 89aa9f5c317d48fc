"""Every core query against its SQL on the smallest tables; those without SQL have to run and give rows."""

import pytest
from oracle import connect, rows

from strainspark.queries import MODULES

QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    got = QUERIES[name](spark, data)
    assert len(set(map(str.lower, got.columns))) == len(got.columns)
    if name not in SQL:
        assert got.count() > 0
    else:
        assert rows(got.toPandas()) == rows(con.execute(SQL[name]).df())


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_found_queries_have_the_given_columns(spark, data):
    assert QUERIES["p3_found"](spark, data).dtypes == [("axis", "string"), ("key_a", "string"), ("key_b", "string"), ("kind", "string"), ("lo", "bigint"), ("hi", "bigint")]
    assert QUERIES["p5_found"](spark, data).dtypes == [("sample", "string"), ("gene", "string")]


def test_core_stands_alone():
    """Without the llm folder the entry still gives the core's queries, and nothing in the core imports it."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "strainspark"
    own = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not any(re.search(r"strainspark[.]llm|from [.]+llm", p.read_text()) for p in own)
