"""Every query of the subpackage against its SQL on the smallest tables; those without SQL have to run and give rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, rows  # noqa: E402

from strainspark.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    got = QUERIES[name](spark, data)
    if name in SQL:
        assert rows(got.toPandas()) == rows(con.execute(SQL[name]).df())
    else:
        assert got.count() > 0


def test_found_queries_have_the_given_columns(spark, data):
    want = {
        "p1_found": [("gene_a", "string"), ("gene_b", "string")],
        "p2_found": [("table_name", "string"), ("qseqid", "string"), ("row_id", "bigint")],
        "p4_found": [("seqid", "string"), ("field", "string"), ("entry_id", "bigint")],
        "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p7_found": [("source", "string")],
        "p8_found": [("doc_id", "bigint"), ("language", "string")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, data).dtypes == columns
